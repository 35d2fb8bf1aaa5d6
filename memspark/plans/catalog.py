"""Registered queries over the conversation tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import memory as m
from ..functions import text as t
from ..functions.policy import BudgetPolicy, ExtractPolicy, MergePolicy, ScorePolicy
from ..operators import blocks, changes, duplicates, evaluate, extract, insight, retrieve, store, summary
from ..sources import memories as src
from ..sources.durable import durable
from .oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The tables' texts are invented, so the queries bring words that are frequent in them as markers.
LEXICON = ExtractPolicy(
    preference=["the th", "que la"], preference_patterns=[], preference_patterns_cased=[], profile=["ation "], profile_patterns=[], relationship=["ing the", "ment "], temporal=["erth"],
    event=["ight", "lich "], plans=["ent la"], conflict=["thon"],
)
SCORING = ScorePolicy(keywords=64, threshold=0.05)


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def as_of() -> Column:
    return F.lit(src.AS_OF).cast("timestamp")


def joined(c: str | Column) -> Column:
    return F.array_join(c, ",")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))


@query
def normalize_text(spark, sf_dir):
    x = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", F.sha2(t.normalize_content(x), 256).alias("content_key"), F.sha2(t.normalize_similarity(x), 256).alias("similarity_key"), F.sha2(t.normalize_report(x), 256).alias("report_key")
    )


@query
def extract_keywords(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", joined(t.keywords(F.col("text"))).alias("keywords"))


@query
def extract_entities(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", joined(t.entities(F.col("text"))).alias("entities"))


@query
def token_features(spark, sf_dir):
    x = F.col("text")
    rows = src.messages_from_conversations(spark, sf_dir)
    detail = t.scene_detail(x, F.size(t.keywords(x)), F.size(t.entities(x)))
    return rows.select(
        "request_id", "msg_idx", t.is_question_like(x).alias("question_like"), t.is_scene_query(x).alias("scene_query"), joined(t.relationship_cues(x)).alias("cues"), joined(t.durable_cues(x)).alias("durable"),
        F.round(detail, 6).alias("detail"), t.truncate_at_blank(x, 120).alias("short"), t.preview(x).alias("preview"),
    )


@query
def classify_messages(spark, sf_dir):
    got = extract.classify(src.messages_from_conversations(spark, sf_dir), LEXICON)
    return got.select("request_id", "msg_idx", "type", "layer", "importance")


@query
def extract_memories(spark, sf_dir):
    got = extract.extract(src.messages_from_conversations(spark, sf_dir), LEXICON)
    return got.select("request_id", "msg_idx", "id", "type", "layer", "importance", "content", joined("metadata.keywords").alias("keywords"))


@query
def quality_gate(spark, sf_dir):
    got = extract.quality_gate(src.memories_from_conversations(spark, sf_dir))
    return got.select("id", "gate_reason", "gate_ok")


@query
def list_filtered_page(spark, sf_dir):
    got = insight.list_memories(src.memories_from_conversations(spark, sf_dir), limit=40, offset=10, layer="episodic", archived=False, source="auto")
    return got.select("id", "updated_at", "total")


@query
def search_memories(spark, sf_dir):
    return insight.search(src.memories_from_conversations(spark, sf_dir), " THE  th ").select("id", "content")


@query
def validate_memories(spark, sf_dir):
    rows = src.memories_from_conversations(spark, sf_dir).withColumn("importance", F.col("importance") * 1.2).withColumn("layer", F.when(F.col("pinned"), F.lit("odd")).otherwise(F.col("layer")))
    return src.violations(rows).select("id", joined("violations").alias("violations"), src.clamp_importance(F.col("importance")).alias("clamped"))


@query
def resolve_scopes(spark, sf_dir):
    c = F.col("conv_id")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
    rows = rows.select("conv_id", F.when(c % 3 == 0, c.cast("string")).alias("chatId"), F.when(c % 2 == 0, F.concat(F.lit("g"), c)).alias("groupId"), F.when(c % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("x"), c % 4)).alias("characterId"))
    return src.resolve_scope(rows).select("conv_id", "chat_id", "character_id", "chat_scope_source", "character_scope_source", "scope_key")


@query
def message_lines(spark, sf_dir):
    rows = src.message_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"), F.max("line_no").cast("int").alias("last_line"))


def used_memories(spark, sf_dir) -> DataFrame:
    return changes.apply_usage(src.memories_from_conversations(spark, sf_dir), src.access_log_from_events(spark, sf_dir))


@query
def usage_counts(spark, sf_dir):
    return changes.usage_counts(src.access_log_from_events(spark, sf_dir))


@query
def freshness_activity(spark, sf_dir):
    got = m.cards(used_memories(spark, sf_dir), as_of())
    return got.select("id", "access_count", "last_accessed_at", "updated_days", "accessed_days", "freshness", "activity", "touch_state", F.round(m.recency(F.col("updated_at"), as_of()), 6).alias("recency"))


@query
def chat_groups(spark, sf_dir):
    got = insight.chat_groups(src.memories_from_conversations(spark, sf_dir), as_of())
    return got.select("chat_id", "character_id", "total_count", "summary_count", "stable_count", "episodic_count", "last_updated", "last_updated_days")


@query
def latest_episodic_window(spark, sf_dir):
    return summary.episodic_window(src.memories_from_conversations(spark, sf_dir), 3).select("chat_id", "id", "nth")


@query
def recent_context_frame(spark, sf_dir):
    got = insight.recent_context(src.messages_from_conversations(spark, sf_dir), 3)
    return got.select("chat_id", "msg_idx", F.array_join("recent", "|").alias("recent"), "last_user")


@query
def exact_duplicates(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.xxhash64(t.normalize_content(F.col("text"))).alias("k1"), F.sha2(t.normalize_content(F.col("text")), 256).alias("k2"))
    groups = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"))
    return rows.join(groups, ["k1", "k2"]).select("doc_id", "first_id", "n_copies")


def soft_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = src.memories_from_conversations(spark, sf_dir).withColumn("chat_id", F.lit("all"))
    late = F.split("id", "-")[1].cast("int") >= 2
    return rows.filter(late), rows.filter(~late)


@query
def soft_matches(spark, sf_dir):
    # All chats are one scope here, so the limit on a chat's newest memories doesn't apply.
    new, old = soft_sides(spark, sf_dir)
    return duplicates.soft_matches(new, old, MergePolicy(newest=None)).select("candidate_id", "existing_id", "n_entities", "n_keywords")


@query
def near_duplicates(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang", "text")
    got = duplicates.overlap_report(rows, ["lang"], t.token_set(t.normalize_report(F.col("text"))), 85)
    return got.select("id", "class_id", "n_links")


@query
def shadowed_by_stable(spark, sf_dir):
    rows = m.cards(insight.list_position(used_memories(spark, sf_dir)), as_of())
    return duplicates.shadowed_by_stable(rows)


@query
def consolidation_candidates(spark, sf_dir):
    return insight.consolidation_candidates(used_memories(spark, sf_dir), as_of())


@query
def consolidation_summary(spark, sf_dir):
    return insight.consolidation_summary(insight.consolidation_candidates(used_memories(spark, sf_dir), as_of(), pairs=False))


@query
def browse_page(spark, sf_dir):
    got = insight.browse(used_memories(spark, sf_dir), as_of(), freshness="stale", activity="never_used", sort="stalest_first", limit=25, offset=5, newest=None)
    return got.select("id", "updated_days", "touch_state")


def requests_from_conversations(spark, sf_dir, recent: int = 0, top: int = 5, rows: DataFrame | None = None, archived: bool = True) -> tuple[DataFrame, DataFrame]:
    """Each conversation's last user turn as a request, and the turns before it as memories. rows: turns in place of the table's."""
    messages = src.messages_from_conversations(spark, sf_dir, rows)
    last = messages.filter("role = 'user'").groupBy("chat_id", "character_id").agg(F.max("msg_idx").alias("q_turn"), F.max_by("text", "msg_idx").alias("user_input"))
    asked = last.select(
        F.concat(F.lit("q-"), F.col("chat_id")).alias("request_id"), "chat_id", "character_id", "q_turn", "user_input", F.lit(top).alias("limit"), F.lit(archived).alias("include_archived"),
        F.array().cast("array<struct<role:string,text:string>>").alias("recent_messages"),
    )
    if recent:
        before = messages.join(asked.select("chat_id", "q_turn"), "chat_id").filter((F.col("msg_idx") < F.col("q_turn")) & (F.col("msg_idx") >= F.col("q_turn") - recent))
        said = before.groupBy("chat_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("said"))
        asked = asked.join(said, "chat_id", "left").withColumn("recent_messages", F.coalesce("said", "recent_messages")).drop("said")
    known = src.memories_from_conversations(spark, sf_dir, 64, rows).withColumn("turn", F.split("id", "-")[1].cast("int"))
    known = known.join(asked.select("chat_id", "q_turn"), "chat_id").filter(F.col("turn") < F.col("q_turn")).drop("q_turn", "turn")
    return asked, known


def scored(spark, sf_dir, p: ScorePolicy, recent: int = 0) -> DataFrame:
    asked, known = requests_from_conversations(spark, sf_dir, recent)
    return retrieve.score(retrieve.query_features(asked, p), retrieve.memory_features(known), as_of(), p)


@query
def score_candidates(spark, sf_dir):
    r6 = lambda c: F.round(c, 6).alias(c)
    return scored(spark, sf_dir, SCORING).filter("matched").select("request_id", "id", r6("keyword_overlap"), r6("entity_overlap"), r6("recency"), r6("score"))


@query
def retrieve_plain_topk(spark, sf_dir):
    got = retrieve.plain_top(scored(spark, sf_dir, SCORING).filter("score > 0"), 1)
    return got.select("request_id", "id", "rank", F.round("score", 6).alias("score"))


def layered(spark, sf_dir) -> DataFrame:
    asked, known = requests_from_conversations(spark, sf_dir, recent=3)
    return retrieve.retrieve(asked, known, as_of(), SCORING)


@query
def retrieve_layered(spark, sf_dir):
    return layered(spark, sf_dir).select("request_id", "id", "ret_layer", F.round("score", 6).alias("score"), "selected", "rank", "filtered_by_diversity", "reason")


@query
def retrieve_metrics(spark, sf_dir):
    got = insight.retrieve_metrics(layered(spark, sf_dir))
    return got.withColumn("top_score", F.round("top_score", 6)).withColumn("avg_selected_score", F.round("avg_selected_score", 6))


def ranked_items(spark, sf_dir) -> DataFrame:
    """Each chat's memories as ranked items, newest first."""
    rows = src.memories_from_conversations(spark, sf_dir).withColumn("ret_layer", m.retrieval_layer())
    return rows.select(F.col("chat_id").alias("request_id"), F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("updated_at"), F.desc("id"))).alias("rank"), "id", "content", "pinned", "ret_layer")


@query
def format_blocks(spark, sf_dir):
    return blocks.format_blocks(ranked_items(spark, sf_dir))


@query
def budget_blocks(spark, sf_dir):
    got = blocks.budget_blocks(ranked_items(spark, sf_dir), BudgetPolicy(items=3, chars=300))
    return got.select("request_id", "block", "actual_chars", "retrieved_items", "injected_items", "trimmed_items", joined("trim_reasons").alias("trim_reasons"), "injected_summary", "trimmed_episodic")


@query
def anchor_blocks(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    raw = pages.select(
        F.concat(F.lit("r"), F.col("page_id") % 50).alias("request_id"), F.col("page_id").alias("pos"), F.col("page_id").cast("string").alias("uid"), F.when(F.col("page_id") % 3 == 0, F.lit("memory-anchor, page")).otherwise(F.lit("page")).alias("tags"),
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("@memory-anchor: "), title)).alias("comment"), title.alias("content"),
    )
    return blocks.anchor_blocks(src.lore_entries(raw), max_items=2, max_chars=120)


@query
def rolling_summary_inputs(spark, sf_dir):
    got = summary.summary_inputs(src.memories_from_conversations(spark, sf_dir))
    return got.select("chat_id", joined("source_ids").alias("source_ids"), "summarized_count", "new_input_count", "summary_id")


@query
def rolling_summaries(spark, sf_dir):
    got = summary.rolling_summary(src.memories_from_conversations(spark, sf_dir), as_of())
    return got.select("chat_id", "character_id", "action", "summary_memory_id", "summary_text", joined("source_ids").alias("source_ids"), "summarized_count", "new_input_count", joined("metadata.keywords").alias("keywords"))


def stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A chat's first three turns as the store, later turns and repeats of the first as candidates."""
    rows = durable(src.memories_from_conversations(spark, sf_dir))
    turn = F.split("id", "-")[1].cast("int")
    old = rows.filter(turn < 3)
    again = rows.filter(turn < 2).withColumn("id", F.concat("id", F.lit("-again"))).withColumn("content", F.concat("content", F.lit(" !!!")))
    new = rows.filter(turn >= 3).unionByName(again).withColumn("source", F.lit("auto"))
    new = new.withColumn("request_id", F.concat(F.lit("s-"), F.col("chat_id"))).withColumn("seq", F.split("id", "-")[1].cast("long")).drop("normalized_content")
    return store.store(old, new, as_of())


@query
def store_batch(spark, sf_dir):
    snapshot, _ = stored(spark, sf_dir)
    return snapshot.select("id", "chat_id", "type", F.round("importance", 6).alias("importance"), F.sha2("content", 256).alias("content"), joined("metadata.keywords").alias("keywords"), "updated_at")


@query
def store_decisions(spark, sf_dir):
    _, decided = stored(spark, sf_dir)
    return decided.select("id", "decision", "reason", "branch", "matched_id")


@query
def store_metrics(spark, sf_dir):
    return store.store_metrics(stored(spark, sf_dir)[1])


@query
def store_counters(spark, sf_dir):
    return store.store_counters(stored(spark, sf_dir)[1])


def change_feed(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    action = F.when(kind == "error", F.lit("delete")).when(kind == "signup", F.lit("toggle_pinned")).when(kind == "click", F.lit("toggle_archived")).otherwise(F.lit("update"))
    value = F.when(kind == "purchase", F.round(F.col("value") % 1, 6))
    content = F.when(kind == "view", F.concat(F.lit("Changed: "), F.col("event_id").cast("string"), F.lit(" times!")))
    return rows.select(
        F.concat_ws("-", F.col("user_id"), F.col("event_id") % 8).alias("id"), F.col("event_id").alias("seq"), (F.col("ts") + F.expr("interval 790 days")).alias("ts"),
        F.when((action == "delete") & (F.col("event_id") % 10 > 0), F.lit("update")).otherwise(action).alias("action"), value.alias("importance"), content.alias("content"),
    )


@query
def apply_changes(spark, sf_dir):
    got = changes.apply_changes(src.memories_from_conversations(spark, sf_dir), change_feed(spark, sf_dir))
    return got.select("id", "importance", F.sha2("content", 256).alias("content"), F.sha2("normalized_content", 256).alias("normalized"), "pinned", "archived", "updated_at")


@query
def apply_reviews(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type").isin("view", "purchase", "signup"))
    action = F.when(F.col("event_type") == "view", F.lit("mark_reviewed_keep")).when(F.col("event_type") == "purchase", F.lit("mark_consolidated_archive")).otherwise(F.lit("look_again"))
    reviews = rows.select(
        F.concat_ws("-", F.col("user_id"), F.col("event_id") % 8).alias("id"), F.col("event_id").alias("seq"), (F.col("ts") + F.expr("interval 790 days")).alias("ts"), action.alias("action"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("rel"), F.col("event_id"))).otherwise(F.lit(" ")).alias("related_memory_id"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("note "), F.col("event_id"))).alias("note"),
    )
    got = changes.apply_reviews(src.memories_from_conversations(spark, sf_dir), reviews)
    return got.select("id", "archived", F.col("metadata.review_status").alias("review_status"), F.col("metadata.related_memory_id").alias("related_id"), F.col("metadata.consolidation_note").alias("note"), F.size("metadata.consolidation_history").alias("n_history"), "updated_at")


@query
def evaluate_cases(spark, sf_dir):
    asked, known = requests_from_conversations(spark, sf_dir)
    best = retrieve.plain_top(scored(spark, sf_dir, SCORING).filter("passed"), 1).select("request_id", F.col("id").alias("best"))
    cases = asked.join(best, "request_id").select(
        F.col("chat_id").alias("name"), F.col("user_input").alias("query"), F.col("recent_messages").alias("recent"), F.lit(5).alias("limit"), F.array("best").alias("top_ids"), F.array("best").alias("contains_ids"),
        F.array(F.lit("none")).alias("forbidden_ids"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("layer_counts"),
    )
    got = evaluate.evaluate(cases, known.withColumn("name", F.col("chat_id")), as_of(), replace(SCORING, band=0.0))
    return got.select("name", "passed", joined("missing_top_ids").alias("missing_top"), joined("missing_contains_ids").alias("missing"))


@query
def audit_records(spark, sf_dir):
    messages = src.messages_from_conversations(spark, sf_dir)
    asked = messages.select("request_id", F.col("chat_id").alias("chatId"), F.lit(None).cast("string").alias("groupId"), F.col("character_id").alias("characterId")).distinct()
    block = blocks.budget_blocks(ranked_items(spark, sf_dir)).withColumn("request_id", F.regexp_replace("request_id", "^chat-", "r"))
    got = block.select("request_id", F.lit("pre_generation").alias("stage"), F.col("retrieved_items").alias("returned_item_count"), F.col("block").alias("memory_block"))
    put = block.select("request_id", F.lit("pre_generation").alias("stage"), (F.col("actual_chars") > 100).alias("applied"), F.col("trimmed_items").alias("trimmed_item_count"), F.lit(False).alias("lore_anchor_applied"))
    rows = insight.audit_records(src.resolve_scope(asked), None, got, put, as_of())
    return rows.select("request_id", "interaction_id", "chat_scope_source", F.col("retrieve.memory_block_item_count").alias("block_items"), F.col("retrieve.memory_block_preview").alias("preview"), joined("notes").alias("notes"))
