"""Reports over the memory store: groups, metrics, consolidation candidates, browsing, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import memory as m
from ..functions import text as t
from ..sources.durable import durable
from .duplicates import near_duplicate_candidates, near_duplicate_pairs, shadowed_by_stable

SCOPE = ["chat_id", "character_id"]
CANDIDATE_TYPES = ("near_duplicate", "stale_low_value_episode", "shadowed_by_stable")


def list_memories(memories: DataFrame, limit: int | None = 50, offset: int = 0, **equal) -> DataFrame:
    """Rows that equal all given values (None: any), newest first, with the total before paging."""
    for name, value in equal.items():
        if value is not None:
            memories = memories.filter(F.col(name) == F.lit(value))
    total = memories.agg(F.count("*").alias("total"))
    page = memories.orderBy(F.desc("updated_at"), F.desc("id")).offset(offset)
    page = page.limit(limit) if limit is not None else page
    return page.join(F.broadcast(total))  # one row


def by_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id").distinct(), "id", "left_semi")


def haystack() -> Column:
    """What a search looks through, as it is written."""
    return F.concat_ws(" ", "id", "content", "normalized_content", "type", "source", "layer", F.array_join("metadata.entities", " "), F.array_join("metadata.keywords", " "))


def search(memories: DataFrame, query: str) -> DataFrame:
    """Memories that hold the query, up to case and blanks, in their texts or signals."""
    needle = " ".join(query.lower().split())
    if not needle:
        return memories
    return memories.filter(F.lower(haystack()).contains(needle))


def chat_groups(memories: DataFrame, as_of: Column) -> DataFrame:
    """A row per scope: counts by layer, last update and its age, labels for display."""
    layer = m.retrieval_layer()
    counts = [F.count_if(layer == x).alias(f"{x}_count") for x in m.LAYERS]
    groups = memories.groupBy(*SCOPE).agg(F.count("*").alias("total_count"), *counts, F.max("updated_at").alias("last_updated"))
    label = t.friendly_label(F.col("chat_id"))
    return groups.withColumns(
        {"last_updated_days": m.whole_days(F.col("last_updated"), as_of), "display_label": label, "display_character_label": t.friendly_label(F.col("character_id")), "has_friendly_label": label != F.col("chat_id")}
    )


def select_group(groups: DataFrame, chat_id: str | None, character_id: str | None, view: str = "chat") -> DataFrame:
    """The requested group if there is one, else the most recently updated; none for view 'all'."""
    if view == "all":
        return groups.limit(0)
    asked = (F.col("chat_id") == chat_id) & (F.col("character_id") == character_id) if chat_id and character_id else F.lit(False)
    best = groups.orderBy(F.when(asked, 0).otherwise(1), F.desc("last_updated"), F.desc("chat_id"), F.desc("character_id"))
    return best.limit(1)


def layer_counts(items: DataFrame, key: str = "request_id", layer: Column | None = None) -> DataFrame:
    layer = m.retrieval_layer() if layer is None else layer
    return items.groupBy(key).agg(*[F.count_if(layer == x).alias(x) for x in m.LAYERS])


def retrieve_metrics(retrieved: DataFrame) -> DataFrame:
    """Per request: candidates, selected, best and mean selected score, what was dropped and why, counts by layer."""
    chosen = F.when(F.col("selected"), F.col("score"))
    reasons = ("below_threshold", "filtered_near_duplicate", "not_in_top_limit", "selected_top")
    layers = [F.count_if(F.col("ret_layer") == x).alias(f"{x}_candidates") for x in m.LAYERS] + [F.count_if((F.col("ret_layer") == x) & F.col("selected")).alias(f"selected_{x}") for x in m.LAYERS]
    return retrieved.groupBy("request_id").agg(
        F.count("*").alias("total_candidates"), F.count_if("selected").alias("selected_count"), F.max(chosen).alias("top_score"), F.avg(chosen).alias("avg_selected_score"),
        F.count_if("filtered_by_diversity").alias("filtered_by_diversity"), *[F.count_if(F.col("reason") == r).alias(f"reason_{r}") for r in reasons], *layers,
    )


def list_position(memories: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """memories with pos, the place in its scope's list, newest first."""
    scope = SCOPE if scope is None else scope
    return memories.withColumn("pos", F.row_number().over(W.partitionBy(*scope).orderBy(F.desc("updated_at"), F.desc("id"))))


# The reasons of candidates.
REASONS = {
    "near_duplicate": "Near-duplicate content cluster.", "stale_low_value_episode": "Stale episodic memory with low retrieval activity.", "shadowed_by_stable": "Similar topic already represented by a stable memory.",
}


def consolidation_candidates(memories: DataFrame, as_of: Column, percent: int = 85, scope: list[str] | None = None, pairs: bool = True) -> DataFrame:
    """id, type, reason, related_id: near duplicates, stale episodes of low use, episodes covered by a stable memory.

    pairs: a row for each near duplicate of a memory, as the report of one chat lists them; else one row a memory, whatever the size of its group.
    """
    scope = SCOPE if scope is None else scope
    # Written once, with no more than what the three kinds look at, so that texts are read and rows are listed once.
    memories = memories.withColumn("norm", t.normalize_report(F.col("content"))).drop("content", "normalized_content")
    signals = F.struct("metadata.entities", "metadata.keywords", "metadata.review_status").alias("metadata")
    rows = durable(m.cards(list_position(memories, scope), as_of).select(*scope, "id", "norm", "pinned", "layer", "pos", "freshness", "activity", signals))
    named = lambda c: (F.lit(c).alias("type"), F.lit(REASONS[c]).alias("reason"))
    if pairs:
        near = near_duplicate_pairs(rows, percent, scope).select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("related_id")), F.struct(F.col("b").alias("id"), F.col("a").alias("related_id")))).alias("p"))
        near = near.select("p.id", *named("near_duplicate"), "p.related_id")
    else:
        near = near_duplicate_candidates(rows, percent, scope).select("id", *named("near_duplicate"), "related_id")
    open_ = rows.filter(~F.col("pinned") & (F.coalesce("metadata.review_status", F.lit("")) != "reviewed_keep"))
    stale = open_.filter((F.col("layer") == "episodic") & (F.col("freshness") == "stale") & F.col("activity").isin("never_used", "low_use"))
    stale = stale.select("id", *named("stale_low_value_episode"), F.lit(None).cast("string").alias("related_id"))
    shadow = shadowed_by_stable(rows, scope=scope).select("id", *named("shadowed_by_stable"), "related_id")
    return near.unionByName(stale).unionByName(shadow)


def consolidation_summary(candidates: DataFrame) -> DataFrame:
    """One row: memories with any candidate, and with each type."""
    each = candidates.filter("id is not null").groupBy("id").agg(*[F.bool_or(F.col("type") == x).alias(x) for x in CANDIDATE_TYPES])
    return each.agg(F.count("*").alias("total_candidates"), *[F.count_if(x).alias(x) for x in CANDIDATE_TYPES])


def sorted_memories(memories: DataFrame, sort: str, as_of: Column) -> DataFrame:
    orders = {
        "updated_desc": [F.desc_nulls_last("updated_at")],
        "last_accessed_desc": [F.desc_nulls_last("last_accessed_at"), F.desc_nulls_last("updated_at")],
        "access_count_desc": [F.desc("access_count"), F.desc_nulls_last("last_accessed_at")],
        "stalest_first": [F.coalesce("updated_at", as_of).asc(), F.coalesce("last_accessed_at", as_of).asc()],
    }
    return memories.orderBy(*orders.get(sort, orders["updated_desc"]), F.desc("id"))


def browse(
    memories: DataFrame, as_of: Column, *, text: str | None = None, freshness: str | None = None, activity: str | None = None, consolidation: str | None = None,
    sort: str = "updated_desc", limit: int = 50, offset: int = 0, newest: int | None = 2000,
) -> DataFrame:
    """A page of memory cards under the filters. newest: only so many of the newest rows are looked at (None: all)."""
    if newest is not None:
        memories = memories.orderBy(F.desc("updated_at"), F.desc("id")).limit(newest)
    rows = m.cards(search(memories, text or ""), as_of)
    if freshness:
        rows = rows.filter(F.col("freshness") == freshness)
    if activity:
        rows = rows.filter(F.col("activity") == activity)
    if consolidation:
        found = consolidation_candidates(memories, as_of, pairs=False)
        rows = by_ids(rows, found if consolidation == "candidates_only" else found.filter(F.col("type") == consolidation))
    return sorted_memories(rows, sort, as_of).offset(offset).limit(limit)


def recent_context(messages: DataFrame, n: int = 8) -> DataFrame:
    """messages with the last n texts up to each one in order, and the last user text so far."""
    order = W.partitionBy("chat_id").orderBy("msg_idx")
    return messages.withColumns(
        {"recent": F.collect_list("text").over(order.rowsBetween(-n + 1, 0)), "last_user": F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))}
    )


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    latest = W.partitionBy("chat_id").orderBy(F.desc("msg_idx"))
    return messages.withColumn("back", F.row_number().over(latest)).filter(F.col("back") <= n)


def newest_audits(records: DataFrame, n: int = 20) -> DataFrame:
    latest = W.partitionBy(*SCOPE).orderBy(F.desc("timestamp"), F.desc("interaction_id"))
    return records.withColumn("nth", F.row_number().over(latest)).filter(F.col("nth") <= n).drop("nth")


def message_audit(messages: DataFrame, chars: int = 240) -> DataFrame:
    """request_id, message_count, and per message its role, length and preview."""
    entry = F.struct("msg_idx", F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown")).alias("role"), F.char_length(F.coalesce("text", F.lit(""))).alias("text_length"), t.preview(F.col("text"), chars).alias("text_preview"))
    return messages.groupBy("request_id").agg(F.count("*").alias("message_count"), F.array_sort(F.collect_list(entry)).alias("messages"))


# Fixed value: the name of the loop that records come from.
LOOP = "pre_generation_retrieve_current_turn"


def audit_records(requests: DataFrame, store: DataFrame | None, retrieve: DataFrame | None, insertion: DataFrame | None, ts: Column) -> DataFrame:
    """One record a request, joined from its stages, with notes on what is missing or odd.

    requests: request_id and the columns of resolve_scope(); store: stored, updated, skipped; retrieve: stage, returned_item_count, memory_block;
    insertion: stage, applied, trimmed_item_count, lore_anchor_applied. A stage that is None was called for no request.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = requests.select(
        "request_id", F.concat_ws(":", "chat_id", F.unix_millis(ts)).alias("interaction_id"), ts.alias("timestamp"), some("chat_id").alias("chat_id"), some("character_id").alias("character_id"),
        some("groupId").alias("group_id"), "chat_scope_source", "character_scope_source", F.lit(LOOP).alias("loop_pattern"),
    )
    shapes = {
        "store": "struct<stored:bigint,updated:bigint,skipped:bigint>",
        "retrieve": "struct<stage:string,returned_item_count:int,memory_block_length:int,memory_block_item_count:int,memory_block_preview:string>",
        "prompt_insertion": "struct<stage:string,applied:boolean,trimmed_item_count:int,lore_anchor_applied:boolean>",
    }
    block = F.coalesce("memory_block", F.lit(""))
    parts = {
        "store": store and store.select("request_id", F.struct("stored", "updated", "skipped").cast(shapes["store"]).alias("store")),
        "retrieve": retrieve and retrieve.select("request_id", F.struct("stage", "returned_item_count", F.char_length(block), t.count_block_items(block), t.preview(block)).cast(shapes["retrieve"]).alias("retrieve")),
        "prompt_insertion": insertion and insertion.select("request_id", F.struct("stage", "applied", "trimmed_item_count", "lore_anchor_applied").cast(shapes["prompt_insertion"]).alias("prompt_insertion")),
    }
    for name, part in parts.items():
        rows = rows.withColumn(name, F.lit(None).cast(shapes[name])) if part is None else rows.join(part, "request_id", "left")
    # The stage that counts, and the notes.
    pre = lambda c: F.coalesce(F.col(f"{c}.stage") == "pre_generation", F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    notes = {
        "store_not_called": F.col("store").isNull(),
        "retrieve_not_called": F.col("retrieve").isNull(),
        "prompt_insertion_not_observed": F.col("prompt_insertion").isNull(),
        "retrieve_not_confirmed_pre_generation": ~pre("retrieve"),
        "prompt_not_confirmed_current_turn": ~pre("prompt_insertion"),
        "empty_memory_block": yes(F.col("retrieve.memory_block_length") == 0),
        "retrieved_items_but_prompt_not_applied": yes((F.col("retrieve.returned_item_count") > 0) & ~F.col("prompt_insertion.applied")),
        "memory_block_trimmed_by_budget": yes(F.col("prompt_insertion.trimmed_item_count") > 0),
        "lore_anchor_applied": yes(F.col("prompt_insertion.lore_anchor_applied")),
    }
    return rows.withColumn("notes", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in notes.items()])))
