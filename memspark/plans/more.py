"""Further registered queries, each with its SQL: over turns in which people say things (see dialogue), and over reports and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import memory as m
from ..functions import policy
from ..functions import text as t
from ..functions.policy import ExtractPolicy, MergePolicy
from ..operators import blocks, changes, duplicates, evaluate, extract, insight, lemmas, retrieve, search, store, summary
from ..sources import memories as src
from ..sources.durable import checkpoint_dir, durable
from ..streaming import store as streams
from . import folds as f
from . import oracles as o
from .catalog import ORACLES as CATALOG_SQL
from .catalog import as_of, change_feed, joined, requests_from_conversations
from .dialogue import SQL as SAID
from .dialogue import dialogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SCORING = f.SCORING
#: Forms of words in the sentences and their lemmas.
LEMMAS = {"анне": "анна", "анну": "анна", "борису": "борис", "решили": "решить", "решила": "решить", "встречу": "встреча", "помирились": "помириться", "доверяют": "доверять", "работают": "работать", "работе": "работа", "loves": "love", "maps": "map"}


def query(sql: str | None) -> Callable:
    """Registers a query with its SQL (None: none)."""

    def wrap(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def said_messages(spark, sf_dir) -> DataFrame:
    return src.messages_from_conversations(spark, sf_dir, dialogue(spark, sf_dir))


def said_memories(spark, sf_dir) -> DataFrame:
    return src.memories_from_conversations(spark, sf_dir, rows=dialogue(spark, sf_dir))


# Text rules

QUESTION = f"(ends_with(trim(text), '?') OR {o.found('lower(trim(text))', policy.QUESTION_PREFIXES)})"
SCENE = o.found("lower(text)", policy.SCENE_QUERY)
DURABLE_CUES, CUES = f.cues("text", policy.DURABLE_STATES), f.cues("text", policy.RELATIONSHIP_CUES)
DURABLE = f"({' OR '.join(o.found('lower(text)', p) for p in policy.DURABLE_STATES.values())}) AND NOT {o.found('lower(text)', policy.EPISODE_BLOCKERS)}"


@query(f"""WITH {SAID}, {o.TURNS} SELECT request_id, msg_idx, {QUESTION} AS question_like, {SCENE} AS scene_query, {o.joined(CUES)} AS cues, {o.joined(DURABLE_CUES)} AS durable, {DURABLE} AS durable_statement,
  {QUESTION} AND (len({DURABLE_CUES}) > 0 OR len({CUES}) > 0) AS relationship_question, {QUESTION} AND {SCENE} AS scene_question, round({o.detail('text')}, 6) AS detail FROM turns""")
def said_features(spark, sf_dir):
    x = F.col("text")
    detail = t.scene_detail(x, F.size(t.keywords(x)), F.size(t.entities(x)))
    return said_messages(spark, sf_dir).select(
        "request_id", "msg_idx", t.is_question_like(x).alias("question_like"), t.is_scene_query(x).alias("scene_query"), joined(t.relationship_cues(x)).alias("cues"), joined(t.durable_cues(x)).alias("durable"),
        t.is_durable_statement(x).alias("durable_statement"), t.is_relationship_question(x).alias("relationship_question"), t.is_scene_question(x).alias("scene_question"), F.round(detail, 6).alias("detail"),
    )


P = ExtractPolicy()
EVENTLIKE = f"({o.any_of('l', P.event)} OR {o.any_of('l', P.temporal)} OR {o.any_of('l', P.plans)})"
PREFERS = f"({o.any_of('l', P.preference)} OR {o.found('l', P.preference_patterns)} OR {o.found('text', P.preference_patterns_cased)})"
PROFILES = f"({o.any_of('l', P.profile)} OR {o.found('l', P.profile_patterns)})"
RELATES = o.any_of("l", P.relationship)
BLOCKED = f"(role = 'user' AND {QUESTION} AND (len({DURABLE_CUES}) > 0 OR len({CUES}) > 0 OR {SCENE} OR {RELATES}))"
TYPED = f"""{SAID}, {o.TURNS}, lowered AS (SELECT *, lower(text) AS l FROM turns),
ruled AS (SELECT *, {BLOCKED} AS blocked, {EVENTLIKE} AS ev, {PREFERS} AS pr, {PROFILES} AS pf, {RELATES} AS re, {DURABLE} AS du FROM lowered),
typed AS (SELECT *, CASE WHEN length(trim(text)) < 10 OR blocked THEN NULL WHEN du THEN 'relationship' WHEN ev THEN 'event' WHEN re THEN 'relationship' WHEN pr OR pf THEN 'profile' END AS type FROM ruled),
classified AS (SELECT *, CASE WHEN type IS NULL THEN NULL WHEN type = 'event' THEN 'episodic' WHEN type = 'relationship' AND du THEN 'stable' WHEN ev THEN 'episodic' WHEN pr OR pf THEN 'stable'
  WHEN type = 'relationship' AND ({o.any_of('l', P.conflict)} OR {o.any_of('l', P.temporal)}) THEN 'episodic' ELSE 'stable' END AS layer, CASE type WHEN 'profile' THEN 0.7 WHEN 'relationship' THEN 0.8 WHEN 'event' THEN 0.6 END::DOUBLE AS importance FROM typed)"""


@query(f"WITH {TYPED} SELECT request_id, msg_idx, blocked, pr AS preference, pf AS profile, re AS relationship, ev AS event, type, layer, importance FROM classified")
def said_types(spark, sf_dir):
    x = F.col("text")
    got = extract.classify(said_messages(spark, sf_dir), P)
    return got.select(
        "request_id", "msg_idx", extract.blocked_question(F.col("role"), x, P).alias("blocked"), t.looks_like_preference(x, P).alias("preference"), t.looks_like_profile(x, P).alias("profile"),
        t.looks_like_relationship(x, P).alias("relationship"), t.looks_like_event(x, P).alias("event"), "type", "layer", "importance",
    )


@query(f"""WITH {TYPED}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY msg_idx) AS nth FROM classified WHERE type IS NOT NULL)
SELECT request_id, msg_idx, sha256(request_id || '#' || msg_idx) AS id, type, layer, importance, {o.CUT} AS content, {o.joined(o.keywords('text'))} AS keywords, {o.joined(o.entities('text'))} AS entities FROM r WHERE nth <= 3""")
def said_extracts(spark, sf_dir):
    got = extract.extract(said_messages(spark, sf_dir), P)
    return got.select("request_id", "msg_idx", "id", "type", "layer", "importance", "content", joined("metadata.keywords").alias("keywords"), joined("metadata.entities").alias("entities"))


_LEMMA_MAP = "MAP {" + ", ".join(f"{o.quoted(k)}: {o.quoted(v)}" for k, v in LEMMAS.items()) + "}"
_WORDS = "[w for w in " + o.words(r"regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g')") + f" if length(w) >= 3 AND NOT list_contains({o.listed(policy.STOPWORDS)}, w)]"
_MARKED = r"regexp_split_to_array(regexp_replace(text, '([.!?]\s)([A-ZА-Я])', '\1_\2', 'g'), '[^\p{L}\p{N}_]+')"
_NAMES = f"[w for w in {_MARKED} if regexp_matches(w, '^[A-ZА-Я][a-zа-яё]+$') AND NOT list_contains({o.listed(policy.PRONOUNS)}, lower(w))]"


@query(f"""WITH {SAID}, {o.TURNS}, w AS (SELECT *, {_WORDS} AS ws, {_NAMES} AS ns, {_LEMMA_MAP} AS lem FROM turns),
l AS (SELECT *, [coalesce(lem[x], x) for x in ws] AS ks, [CASE WHEN regexp_matches(lower(x), '[а-яё]') THEN upper(coalesce(lem[lower(x)], lower(x))[1]) || coalesce(lem[lower(x)], lower(x))[2:] ELSE x END for x in ns] AS es FROM w),
d AS (SELECT *, [lower(x) for x in es] AS el FROM l)
SELECT request_id, msg_idx, array_to_string(list_filter(ks, lambda x, i: list_position(ks, x) = i)[1:8], ',') AS keywords, array_to_string(list_filter(es, lambda x, i: list_position(el, lower(x)) = i)[1:10], ',') AS entities FROM d""")
def lemma_features(spark, sf_dir):
    x = F.col("text")
    return said_messages(spark, sf_dir).select("request_id", "msg_idx", joined(t.keywords(x, lemmas=LEMMAS)).alias("keywords"), joined(t.entities(x, lemmas=LEMMAS)).alias("entities"))


@query(ORACLES["lemma_features"])
def lemma_table_features(spark, sf_dir):
    """lemma_features with the lemmas as a table, here a small one; the tests use one of 300,000 forms."""
    table = spark.createDataFrame(list(LEMMAS.items()), "word string, lemma string")
    rows, x = lemmas.with_forms(said_messages(spark, sf_dir), ["text"], table), F.col("text")
    return rows.select("request_id", "msg_idx", joined(t.keywords(x, lemmas=F.col("forms"))).alias("keywords"), joined(t.entities(x, lemmas=F.col("forms"))).alias("entities"))


_CASES = {
    0: ("''", 0, 0), 1: ("'!?! ... ' || repeat('-', 9)", 2, 1), 2: ("'  OK '", 2, 1), 3: ("'ab cd ef'", 2, 1), 4: ("'considerable ' || id", 2, 1), 5: ("'some words that stand for ' || id", 2, 0), 6: ("'some words that stand for ' || id", 1, 1),
    7: ("'some words that stand for ' || id", 1, 0), 8: ("'considerable words here'", 1, 0), 9: ("''", 0, 0),
}
_case = lambda i: "CASE (conv_id * 7 + turn) % 10 " + " ".join(f"WHEN {k} THEN {v[i]}" for k, v in _CASES.items()) + " END"


@query(rf"""WITH m AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, (conv_id * 7 + turn) % 10 = 9 AS manual FROM conversations), c AS (SELECT id, manual, {_case(0)} AS content, {_case(1)} AS n_keywords, {_case(2)} AS n_entities FROM m),
s AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS z FROM c), n AS (SELECT *, {o.similarity('z')} AS sim FROM s)
SELECT id, CASE WHEN manual THEN 'non_auto_bypass' WHEN z = '' THEN 'empty_content' WHEN sim = '' THEN 'empty_after_normalization' WHEN list_contains({o.listed(policy.LOW_VALUE)}, sim) THEN 'low_value_pattern' WHEN length(z) < 12 THEN 'content_too_short'
  WHEN len({o.words('sim')}) < 3 THEN 'too_few_words' WHEN n_keywords >= 2 THEN 'has_keywords' WHEN n_entities >= 1 THEN 'has_entities' WHEN len({o.words('sim')}) >= 5 THEN 'rich_content' ELSE 'insufficient_retrieval_signal' END AS gate_reason FROM n""")
def gate_reasons(spark, sf_dir):
    """The gate over contents and signals made from each turn's ids, so that all of its reasons occur."""
    part = F.split("id", "-")
    ids = src.memories_from_conversations(spark, sf_dir).select("id", *[part[i].cast("long").alias(c) for i, c in ((0, "conv_id"), (1, "turn"))])
    some = lambda i, word: F.slice(F.array(F.lit(f"{word}1"), F.lit(f"{word}2")), 1, F.expr(_case(i)))
    source = F.when((F.col("conv_id") * 7 + F.col("turn")) % 10 == 9, F.lit("manual")).otherwise(F.lit("auto"))
    rows = ids.select("id", source.alias("source"), F.expr(_case(0)).alias("content"), src.metadata(keywords=some(1, "word"), entities=some(2, "Name")).alias("metadata"))
    return extract.quality_gate(rows).select("id", "gate_reason")


# Retrieval


def said_requests(spark, sf_dir, recent: int, top: int = 5) -> tuple[DataFrame, DataFrame]:
    return requests_from_conversations(spark, sf_dir, recent, top, dialogue(spark, sf_dir), archived=False)


@query(f"""WITH {SAID}, {f.scored(3, False)} SELECT request_id, id, round(ko, 6)::DOUBLE AS keyword_overlap, round(eo, 6)::DOUBLE AS entity_overlap, round(co, 6)::DOUBLE AS cue_overlap, scene, echo, round(d, 6) AS detail, score >= 0.05 AS passed, round(score, 6) AS score FROM scored""")
def said_scores(spark, sf_dir):
    asked, known = said_requests(spark, sf_dir, 3)
    features = retrieve.query_features(asked, SCORING)
    got = retrieve.score(features, retrieve.memory_features(known), as_of(), SCORING).filter("matched")
    query_tokens = t.token_set(F.col("query_norm"))
    echo = (F.col("norm") != "") & (F.col("query_norm") != "") & (F.col("query_norm").contains(F.col("norm")) | (t.overlap_ratio(F.col("tokens"), query_tokens) >= SCORING.echo))
    r6 = lambda c: F.round(c, 6).alias(c)
    return got.select("request_id", "id", r6("keyword_overlap"), r6("entity_overlap"), r6("cue_overlap"), F.col("scene_query").alias("scene"), echo.alias("echo"), r6("detail"), "passed", r6("score"))


@query(f"WITH {SAID}, {f.scored(3, False)}, passing AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, updated_at DESC, id DESC)::INTEGER AS rank FROM scored WHERE score >= 0.3) SELECT request_id, id, rank, round(score, 6) AS score FROM passing WHERE rank <= 5")
def said_passing(spark, sf_dir):
    """The five best memories with a score of at least 0.3; pairs that can't reach it are dropped by bounds before memories are met."""
    asked, known = said_requests(spark, sf_dir, 3)
    got = retrieve.score(retrieve.query_features(asked, SCORING), retrieve.memory_features(known), as_of(), SCORING, at_least=0.3)
    return retrieve.plain_top(got, 5).select("request_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {SAID}, {f.layered(3, False)} {f.LAYERED}")
def said_layered(spark, sf_dir):
    asked, known = said_requests(spark, sf_dir, 3)
    got = retrieve.retrieve(asked, known, as_of(), SCORING)
    return got.select("request_id", "id", "ret_layer", F.round("score", 6).alias("score"), "selected", "rank", "filtered_by_diversity", "reason")


@query(f"WITH RECURSIVE {SAID}, {f.layered(3, False, 3)} {f.METRICS}")
def said_metrics(spark, sf_dir):
    asked, known = said_requests(spark, sf_dir, 3, 3)
    got = insight.retrieve_metrics(retrieve.retrieve(asked, known, as_of(), SCORING))
    return got.withColumn("top_score", F.round("top_score", 6)).withColumn("avg_selected_score", F.round("avg_selected_score", 6))


@query(f"WITH RECURSIVE {SAID}, {f.layered(3, False)} SELECT request_id, count(*) FILTER (ret_layer = 'summary') AS summary, count(*) FILTER (ret_layer = 'stable') AS stable, count(*) FILTER (ret_layer = 'episodic') AS episodic FROM reasoned WHERE selected GROUP BY request_id")
def selected_layers(spark, sf_dir):
    asked, known = said_requests(spark, sf_dir, 3)
    return insight.layer_counts(retrieve.retrieve(asked, known, as_of(), SCORING).filter("selected"), layer=F.col("ret_layer"))


EVAL = f.evaluated("ids[len(ids):len(ids)]", "ids[1:1]", "ids[2:2]", {"summary": 1}, 4, SCORING)


def said_evaluation(spark, sf_dir) -> DataFrame:
    """Each conversation's last user turn should find the turn before it first, the first turn, not the second, and one summary: expectations that fail often, so mistakes show."""
    asked, known = said_requests(spark, sf_dir, 0, 4)
    turn = F.split("id", "-")[1].cast("int")
    ids = known.groupBy("chat_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(turn.alias("turn"), "id"))), lambda x: x["id"]).alias("ids"))
    cases = asked.join(ids, "chat_id").select(
        F.col("chat_id").alias("name"), F.col("user_input").alias("query"), F.col("recent_messages").alias("recent"), F.lit(4).alias("limit"), F.slice("ids", -1, 1).alias("top_ids"), F.slice("ids", 1, 1).alias("contains_ids"),
        F.slice("ids", 2, 1).alias("forbidden_ids"), F.create_map(F.lit("summary"), F.lit(1)).alias("layer_counts"),
    )
    return evaluate.evaluate(cases, known.withColumn("name", F.col("chat_id")), as_of(), SCORING)


@query(f"""WITH RECURSIVE {SAID}, {EVAL} SELECT name, passed, array_to_string(ids, ',') AS retrieved, array_to_string(missing_top, ',') AS missing_top, array_to_string(missing, ',') AS missing, array_to_string(present, ',') AS forbidden, array_to_string(layers, ',') AS layers FROM verdicts""")
def evaluate_expected(spark, sf_dir):
    got = said_evaluation(spark, sf_dir)
    return got.select(
        "name", "passed", joined("retrieved_ids").alias("retrieved"), joined("missing_top_ids").alias("missing_top"), joined("missing_contains_ids").alias("missing"), joined("forbidden_present").alias("forbidden"), joined("layer_mismatches").alias("layers")
    )


@query(f"WITH RECURSIVE {SAID}, {EVAL} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM verdicts")
def evaluation_summary(spark, sf_dir):
    return evaluate.summary(said_evaluation(spark, sf_dir))


@query(f"""WITH RECURSIVE {SAID}, {EVAL}, r AS (SELECT *, list_filter([CASE WHEN len(missing_top) > 0 THEN 'missing at rank: ' || array_to_string(missing_top, ', ') END, CASE WHEN len(missing) > 0 THEN 'missing: ' || array_to_string(missing, ', ') END,
  CASE WHEN len(present) > 0 THEN 'forbidden: ' || array_to_string(present, ', ') END, CASE WHEN len(layers) > 0 THEN 'layers: ' || array_to_string(layers, ', ') END], lambda x: x IS NOT NULL) AS parts FROM verdicts WHERE contains(lower(name), '-1'))
SELECT name, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status, array_to_string(ids, ', ') AS retrieved, array_to_string(parts, '; ') AS details FROM r""")
def evaluation_report(spark, sf_dir):
    return evaluate.report(evaluate.matching_cases(said_evaluation(spark, sf_dir), "-1"))


# Store

SAID_STORE = f"{SAID}, {o.STORE}"


def said_store(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A chat's first three turns as the store; later turns, repeats and longer forms as candidates."""
    rows = durable(said_memories(spark, sf_dir))
    turn = F.split("id", "-")[1].cast("int")
    again = rows.filter(turn < 2).withColumn("id", F.concat("id", F.lit("-again"))).withColumn("content", F.concat("content", F.lit(" !!!")))
    new = rows.filter(turn >= 3).unionByName(again).withColumn("source", F.lit("auto"))
    new = new.withColumn("request_id", F.concat(F.lit("s-"), F.col("chat_id"))).withColumn("seq", F.split("id", "-")[1].cast("long")).drop("normalized_content")
    return store.store(rows.filter(turn < 3), new, as_of())


@query(f"WITH {f.snapshot(SAID_STORE)}")
def said_snapshot(spark, sf_dir):
    got = said_store(spark, sf_dir)[0]
    return got.select("id", "chat_id", "type", F.round("importance", 6).alias("importance"), F.sha2("content", 256).alias("content"), joined("metadata.keywords").alias("keywords"), "updated_at")


@query(f"WITH {SAID_STORE} SELECT id, decision, reason, branch, matched_id FROM decided")
def said_decisions(spark, sf_dir):
    return said_store(spark, sf_dir)[1].select("id", "decision", "reason", "branch", "matched_id")


@query("WITH " + SAID + ", " + CATALOG_SQL["soft_matches"].removeprefix("WITH "))
def said_soft_matches(spark, sf_dir):
    """Soft matches over the dialogue; all chats are one scope, so the limit on a chat's newest memories doesn't apply."""
    rows = durable(said_memories(spark, sf_dir).withColumn("chat_id", F.lit("all")))
    late = F.split("id", "-")[1].cast("int") >= 2
    return duplicates.soft_matches(rows.filter(late), rows.filter(~late), MergePolicy(newest=None)).select("candidate_id", "existing_id", "n_entities", "n_keywords")


# Reports

SAID_USED = f"{SAID}, {o.USED}"


def said_cards(spark, sf_dir) -> DataFrame:
    used = changes.apply_usage(said_memories(spark, sf_dir), src.access_log_from_events(spark, sf_dir))
    return m.cards(insight.list_position(used), as_of())


@query(f"""WITH {SAID_USED}, g AS (SELECT *, list_distinct([lower(x) for x in list_concat(entities, keywords)]) AS sig FROM cards),
p AS (SELECT a.id, b.id AS related_id, b.pos FROM g a JOIN g b ON a.chat_id = b.chat_id AND a.character_id = b.character_id AND a.layer = 'episodic' AND a.activity <> 'active' AND NOT a.pinned AND b.layer = 'stable' AND len(list_intersect(a.sig, b.sig)) >= 2)
SELECT id, arg_min(related_id, pos) AS related_id FROM p GROUP BY id""")
def said_shadowed(spark, sf_dir):
    return duplicates.shadowed_by_stable(said_cards(spark, sf_dir))


SAID_FOUND = f"{SAID}, {o.CONSOLIDATION}"


@query(f"WITH {SAID_FOUND} SELECT * FROM found")
def said_consolidation(spark, sf_dir):
    used = changes.apply_usage(said_memories(spark, sf_dir), src.access_log_from_events(spark, sf_dir))
    return insight.consolidation_candidates(used, as_of())


@query(f"WITH {SAID_FOUND} SELECT DISTINCT id, type, reason FROM found")
def consolidation_ids(spark, sf_dir):
    """One row a candidate and type, without listing its partners."""
    used = changes.apply_usage(said_memories(spark, sf_dir), src.access_log_from_events(spark, sf_dir))
    return insight.consolidation_candidates(used, as_of(), pairs=False).select("id", "type", "reason")


@query(f"WITH {SAID_FOUND} SELECT id, freshness, activity FROM cards WHERE id IN (SELECT id FROM found WHERE type = 'shadowed_by_stable') AND freshness = 'stale' ORDER BY access_count DESC, last_accessed_at DESC NULLS LAST, id DESC LIMIT 30")
def browse_candidates(spark, sf_dir):
    used = changes.apply_usage(said_memories(spark, sf_dir), src.access_log_from_events(spark, sf_dir))
    got = insight.browse(used, as_of(), consolidation="shadowed_by_stable", freshness="stale", sort="access_count_desc", limit=30, newest=None)
    return got.select("id", "freshness", "activity")


@query(f"WITH {SAID_USED} SELECT id, last_accessed_at, touch_state FROM cards WHERE contains(lower(concat_ws(' ', id, content, normalized_content, type, source, layer, array_to_string(entities, ' '), array_to_string(keywords, ' '))), 'анна') ORDER BY last_accessed_at DESC NULLS LAST, updated_at DESC NULLS LAST, id DESC LIMIT 25")
def browse_accessed(spark, sf_dir):
    used = changes.apply_usage(said_memories(spark, sf_dir), src.access_log_from_events(spark, sf_dir))
    return insight.browse(used, as_of(), text="Анна", sort="last_accessed_desc", limit=25, newest=None).select("id", "last_accessed_at", "touch_state")


#: Times spread over two months, so that memories of all ages occur.
SPREAD_USED = SAID_USED.replace("to_hours(conv_id) AS updated_at", "to_hours(conv_id) + to_days(((conv_id * 7 + turn) % 5 * 12)::INTEGER) AS updated_at")


def spread_memories(spark, sf_dir) -> DataFrame:
    part = F.split("id", "-")
    k = part[0].cast("long") * 7 + part[1].cast("long")
    later = F.timestamp_micros(F.unix_micros("updated_at") + k % 5 * 12 * 86_400_000_000)
    return changes.apply_usage(said_memories(spark, sf_dir).withColumn("updated_at", later), src.access_log_from_events(spark, sf_dir))


@query(f"WITH {SPREAD_USED} SELECT id, updated_days, accessed_days, freshness, activity, touch_state, round(1.0::DOUBLE / (1 + updated_days), 6) AS recency FROM cards")
def card_ages(spark, sf_dir):
    got = m.cards(spread_memories(spark, sf_dir), as_of())
    return got.select("id", "updated_days", "accessed_days", "freshness", "activity", "touch_state", F.round(m.recency(F.col("updated_at"), as_of()), 6).alias("recency"))


@query(f"WITH {SPREAD_USED} SELECT id, updated_days, activity FROM (SELECT * FROM cards ORDER BY updated_at DESC, id DESC LIMIT 200) WHERE freshness = 'warm' ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 40 OFFSET 3")
def browse_updated(spark, sf_dir):
    got = insight.browse(spread_memories(spark, sf_dir), as_of(), freshness="warm", limit=40, offset=3, newest=200)
    return got.select("id", "updated_days", "activity")


_LABEL = r"""CASE WHEN {c} = '' THEN 'Unnamed chat' ELSE (SELECT CASE WHEN length(z) <= 36 THEN z ELSE rtrim(substring(z, 1, 33)) || '...' END FROM (SELECT CASE WHEN y <> {c} AND NOT regexp_matches(y, '\p{Lu}')
  THEN array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(y, ' ')], ' ') ELSE y END AS z FROM (SELECT trim(regexp_replace(regexp_replace({c}, '[-_/]+', ' ', 'g'), '\s+', ' ', 'g')) AS y))) END"""
LABELS = _LABEL.replace("{c}", "chat_id"), _LABEL.replace("{c}", "character_id")


@query(f"""WITH {o.MEM}, n AS (SELECT *, CASE conv_id % 4 WHEN 0 THEN 'Room ' || conv_id WHEN 1 THEN 'My_' || chat_id WHEN 2 THEN '' ELSE chat_id || '/' || repeat('long-name_', 4) END AS named FROM memories),
g AS (SELECT DISTINCT named AS chat_id, character_id FROM n) SELECT chat_id, character_id, {LABELS[0]} AS display_label, {LABELS[1]} AS display_character_label, {LABELS[0]} <> chat_id AS has_friendly_label FROM g""")
def chat_labels(spark, sf_dir):
    rows = src.memories_from_conversations(spark, sf_dir).withColumn("c", F.split("id", "-")[0].cast("long"))
    c = F.col("chat_id")
    named = F.when(F.col("c") % 4 == 0, F.concat(F.lit("Room "), F.col("c"))).when(F.col("c") % 4 == 1, F.concat(F.lit("My_"), c)).when(F.col("c") % 4 == 2, F.lit("")).otherwise(F.concat(c, F.lit("/" + "long-name_" * 4)))
    got = insight.chat_groups(rows.withColumn("chat_id", named), as_of())
    return got.select("chat_id", "character_id", "display_label", "display_character_label", "has_friendly_label")


@query(f"WITH {o.MEM}, g AS (SELECT chat_id, character_id, count(*) AS total_count, max(updated_at) AS last_updated FROM memories GROUP BY ALL) SELECT * FROM g ORDER BY CASE WHEN chat_id = 'chat-3' AND character_id = 'char-3' THEN 0 ELSE 1 END, last_updated DESC, chat_id DESC, character_id DESC LIMIT 1")
def selected_group(spark, sf_dir):
    groups = insight.chat_groups(src.memories_from_conversations(spark, sf_dir), as_of())
    return insight.select_group(groups, "chat-3", "char-3").select("chat_id", "character_id", "total_count", "last_updated")


@query(f"WITH {o.MEM}, {o.LOG} SELECT id, content FROM memories WHERE id IN (SELECT id FROM log)")
def memories_by_id(spark, sf_dir):
    return insight.by_ids(src.memories_from_conversations(spark, sf_dir), src.access_log_from_events(spark, sf_dir)).select("id", "content")


@query(f"WITH {o.TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY msg_idx DESC)::INTEGER AS back FROM turns) SELECT chat_id, msg_idx, back FROM r WHERE back <= 3")
def last_three_messages(spark, sf_dir):
    return insight.last_messages(src.messages_from_conversations(spark, sf_dir), 3).select("chat_id", "msg_idx", "back")


@query(f"""WITH {o.TURNS}, p AS (SELECT request_id, msg_idx, CASE WHEN role = '' OR role IS NULL THEN 'unknown' ELSE role END AS role, text, (SELECT CASE WHEN length(x) <= 60 THEN x ELSE substring(x, 1, 60) || '...' END FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x)) AS shown FROM turns)
SELECT request_id, count(*) AS message_count, string_agg(role || ':' || length(text) || ':' || shown, '|' ORDER BY msg_idx) AS messages FROM p GROUP BY request_id""")
def message_audits(spark, sf_dir):
    got = insight.message_audit(src.messages_from_conversations(spark, sf_dir), 60)
    line = F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["text_length"], F.lit(":"), x["text_preview"]))
    return got.select("request_id", "message_count", F.array_join(line, "|").alias("messages"))


@query("""WITH e AS (SELECT 'u' || user_id AS chat_id, 'c' || (user_id % 3) AS character_id, event_id::VARCHAR AS interaction_id, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY chat_id, character_id ORDER BY ts DESC, interaction_id DESC) AS nth FROM e)
SELECT chat_id, interaction_id FROM r WHERE nth <= 20""")
def audit_ring(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    records = rows.select(F.concat(F.lit("u"), F.col("user_id")).alias("chat_id"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("character_id"), F.col("event_id").cast("string").alias("interaction_id"), F.col("ts").alias("timestamp"))
    return insight.newest_audits(records, 20).select("chat_id", "interaction_id")


# Full audit records: stages missing for some requests, stages too late for others.
AUDIT_STAGES = """b AS (SELECT m.request_id, m.conv_id, m.chat_id, budget.* EXCLUDE (request_id) FROM (SELECT DISTINCT 'r' || conv_id AS request_id, conv_id, 'chat-' || conv_id AS chat_id FROM conversations) m JOIN budget ON budget.request_id = m.chat_id),
n AS (SELECT request_id, conv_id % 5 = 0 AS no_store, conv_id % 7 = 0 AS no_get, conv_id % 4 = 1 AS no_put, conv_id % 6 = 2 AS late_get, conv_id % 6 = 3 AS late_put, CASE WHEN conv_id % 9 = 0 THEN '' ELSE block END AS block, retrieved_items, trimmed_items, conv_id % 2 = 0 AS applied, conv_id % 8 = 1 AS anchored FROM b)"""


@query(f"""WITH {o.budget(3, 300)}, {AUDIT_STAGES} SELECT request_id, CASE WHEN NOT no_get THEN length(block) END::INTEGER AS block_length, array_to_string(list_filter([CASE WHEN no_store THEN 'store_not_called' END, CASE WHEN no_get THEN 'retrieve_not_called' END,
  CASE WHEN no_put THEN 'prompt_insertion_not_observed' END, CASE WHEN no_get OR late_get THEN 'retrieve_not_confirmed_pre_generation' END, CASE WHEN no_put OR late_put THEN 'prompt_not_confirmed_current_turn' END, CASE WHEN NOT no_get AND block = '' THEN 'empty_memory_block' END,
  CASE WHEN NOT no_get AND NOT no_put AND retrieved_items > 0 AND NOT applied THEN 'retrieved_items_but_prompt_not_applied' END, CASE WHEN NOT no_put AND trimmed_items > 0 THEN 'memory_block_trimmed_by_budget' END, CASE WHEN NOT no_put AND anchored THEN 'lore_anchor_applied' END], lambda x: x IS NOT NULL), ',') AS notes FROM n""")
def audit_notes(spark, sf_dir):
    from .catalog import ranked_items

    asked = src.messages_from_conversations(spark, sf_dir).select("request_id", F.col("chat_id").alias("chatId"), F.lit(None).cast("string").alias("groupId"), F.col("character_id").alias("characterId")).distinct()
    block = blocks.budget_blocks(ranked_items(spark, sf_dir), policy.BudgetPolicy(items=3, chars=300)).withColumn("request_id", F.regexp_replace("request_id", "^chat-", "r")).withColumn("c", F.substring("request_id", 2, 20).cast("long"))
    c = F.col("c")
    stage = lambda late: F.when(late, F.lit("post_generation")).otherwise(F.lit("pre_generation")).alias("stage")
    kept = block.filter(c % 5 != 0).select("request_id", F.lit(1).alias("stored"), F.lit(0).alias("updated"), F.lit(2).alias("skipped"))
    got = block.filter(c % 7 != 0).select("request_id", stage(c % 6 == 2), F.col("retrieved_items").alias("returned_item_count"), F.when(c % 9 == 0, F.lit("")).otherwise(F.col("block")).alias("memory_block"))
    put = block.filter(c % 4 != 1).select("request_id", stage(c % 6 == 3), (c % 2 == 0).alias("applied"), F.col("trimmed_items").alias("trimmed_item_count"), (c % 8 == 1).alias("lore_anchor_applied"))
    rows = insight.audit_records(src.resolve_scope(asked), kept, got, put, as_of())
    return rows.select("request_id", F.col("retrieve.memory_block_length").alias("block_length"), joined("notes").alias("notes"))


# Summaries and anchors


@query(f"WITH {SAID}, {o.ROLLING}, {f.SUMMARIES}")
def said_summaries(spark, sf_dir):
    got = summary.rolling_summary(said_memories(spark, sf_dir), as_of())
    return got.select("chat_id", "character_id", "action", "summary_memory_id", "summary_text", joined("source_ids").alias("source_ids"), "summarized_count", "new_input_count", joined("metadata.keywords").alias("keywords"))


#: Whole pages as lore: markup and scripts go, the first two blocks of a page are known already.
PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
KNOWN_ENTRIES = f"SELECT 'r' || (page_id % 20) AS request_id, page_id AS pos, page_id % 3 = 0 AS tagged, CASE WHEN page_id % 5 = 0 THEN '[memory-anchor]' END AS comment, CASE WHEN page_id % 6 = 1 THEN '@memory-anchor: place ' || (page_id % 4) || chr(10) || {PLAIN} ELSE {PLAIN} END AS content FROM pages"
KNOWN_BLOCKS = f"SELECT 'r' || (page_id % 20) AS request_id, string_agg('- ' || {PLAIN}, chr(10) ORDER BY page_id) || chr(10) || '- Place  1' AS block FROM pages WHERE page_id % 2 = 0 GROUP BY page_id % 20"


def plain_pages(spark, sf_dir) -> DataFrame:
    html = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>", " ")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.array(t.collapse(F.regexp_replace(html, "<[^>]*>", " ")))).alias("plain"), F.concat(F.lit("r"), F.col("page_id") % 20).alias("request_id"))


def lore(spark, sf_dir) -> DataFrame:
    p = F.col("page_id")
    raw = plain_pages(spark, sf_dir).select(
        "request_id", p.alias("pos"), p.cast("string").alias("id"), F.when(p % 3 == 0, F.lit("Page MEMORY-ANCHOR,x")).otherwise(F.lit("page")).alias("tags"), F.when(p % 5 == 0, F.lit("[memory-anchor]")).alias("label"),
        F.when(p % 6 == 1, F.concat(F.lit("@memory-anchor: place "), p % 4, F.lit("\n"), F.col("plain"))).otherwise(F.col("plain")).alias("entry"),
    )
    return src.lore_entries(raw)


@query(f"WITH {f.anchors(KNOWN_ENTRIES, 4, 2000, KNOWN_BLOCKS)}")
def anchors_beside_blocks(spark, sf_dir):
    even = plain_pages(spark, sf_dir).filter("page_id % 2 = 0")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "plain"))), lambda x: F.concat(F.lit("- "), x["plain"]))
    known = even.groupBy("request_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n- Place  1")).alias("block"))
    return blocks.anchor_blocks(lore(spark, sf_dir), known, max_items=4, max_chars=2000)


@query(f"""WITH e AS ({KNOWN_ENTRIES}) SELECT pos::VARCHAR AS lore_id, coalesce(comment, '') AS lore_comment, sha256(content) AS lore_content, CASE WHEN tagged THEN 'page,memory-anchor,x' ELSE 'page' END AS lore_tags,
  tagged OR regexp_matches(coalesce(comment, ''), {o.quoted(f.MARKER)}) OR regexp_matches(content, {o.quoted(f.MARKER)}) AS allowed FROM e""")
def lore_allowed(spark, sf_dir):
    entries = lore(spark, sf_dir)
    allowed = blocks.anchor_candidates(entries).select("lore_id", F.lit(True).alias("allowed"))
    rows = entries.select("lore_id", "lore_comment", F.sha2("lore_content", 256).alias("lore_content"), joined("lore_tags").alias("lore_tags"))
    return rows.join(allowed, "lore_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT doc_id, [trim(x) for x in string_split(text, ',') if trim(x) <> ''] AS parts FROM d) SELECT doc_id, len(parts)::INTEGER AS n_parts, sha256(array_to_string(parts, '|')) AS parts FROM p""")
def comma_lists(spark, sf_dir):
    parts = src.parse_list(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(parts).alias("n_parts"), F.sha2(F.array_join(parts, "|"), 256).alias("parts"))


@query(f"WITH {o.TURNS} SELECT request_id, msg_idx, chat_id || '::' || character_id || '::' || length(text) || '::' || text AS turn_key FROM turns")
def turn_keys(spark, sf_dir):
    rows = src.messages_from_conversations(spark, sf_dir)
    return rows.select("request_id", "msg_idx", m.turn_key(F.col("chat_id"), F.col("character_id"), F.char_length("text"), F.col("text")).alias("turn_key"))


# Sources and sinks

_MEMORY = "id, chat_id, type, content, source, layer, importance, updated_at, pinned, archived, array_to_string(keywords, ',') AS keywords, array_to_string(entities, ',') AS entities, is_summary"


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "chat_id", "type", "content", "source", "layer", "importance", "updated_at", "pinned", "archived", joined("metadata.keywords").alias("keywords"), joined("metadata.entities").alias("entities"), F.col("metadata.is_summary").alias("is_summary"))


@query(f"WITH {o.MEM} SELECT {_MEMORY} FROM memories")
def memory_table(spark, sf_dir):
    """Memories appended to a table in two parts and scanned again."""
    rows, path = src.memories_from_conversations(spark, sf_dir), f"{checkpoint_dir(spark)}/memories-{uuid.uuid4().hex}"
    src.append_memories(rows.filter("pinned"), path)
    src.append_memories(rows.filter("not pinned"), path)
    return shown(src.read_memories(spark, path))


def stored(spark, sf_dir) -> str:
    """The path of a table of all memories, by bucket."""
    path = f"{checkpoint_dir(spark)}/memories-{uuid.uuid4().hex}"
    src.append_memories(src.memories_from_conversations(spark, sf_dir), path)
    return path


@query(CATALOG_SQL["apply_changes"])
def changed_table(spark, sf_dir):
    """apply_changes on a stored table, whose touched buckets are rewritten."""
    path = stored(spark, sf_dir)
    src.rewrite_memories(spark, path, change_feed(spark, sf_dir), changes.apply_changes)
    return src.read_memories(spark, path).select("id", "importance", F.sha2("content", 256).alias("content"), F.sha2("normalized_content", 256).alias("normalized"), "pinned", "archived", "updated_at")


@query(CATALOG_SQL["search_memories"])
def search_by_trigrams(spark, sf_dir):
    """search_memories on a stored table, through trigram postings."""
    path = stored(spark, sf_dir)
    table = spark.read.schema(f"{src.MEMORY}, bucket int").parquet(path)
    search.write_postings(table, f"{path}-postings")
    return search.search_postings(spark, table, f"{path}-postings", " THE  th ").select("id", "content")


@query(f"WITH {o.MEM} SELECT id, updated_at, (SELECT count(*) FROM memories) AS total FROM memories ORDER BY updated_at DESC, id DESC LIMIT 40 OFFSET 60")
def page_by_directory(spark, sf_dir):
    """A page of all memories, newest first, read from the ranges that it lies in."""
    path, order = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}", [F.desc("updated_at"), F.desc("id")]
    search.write_pages(src.memories_from_conversations(spark, sf_dir).select("id", "updated_at"), order, path)
    return search.read_page(spark, path, order, 60, 40)


@query(f"WITH {o.MEM} SELECT {_MEMORY} FROM memories")
def flat_memories(spark, sf_dir):
    """Memories in the flat form, with JSON metadata, and back."""
    return shown(src.decode_flat(src.encode_flat(src.memories_from_conversations(spark, sf_dir))))


@query(f"WITH {o.MEM} SELECT id, trim(content) AS content, {o.content_key('content')} AS normalized_content, TIMESTAMP '{src.AS_OF}' AS created_at, 0::BIGINT AS access_count FROM memories")
def created_memories(spark, sf_dir):
    got = src.create(src.memories_from_conversations(spark, sf_dir).drop("normalized_content", "created_at", "updated_at", "last_accessed_at", "access_count"), as_of())
    return got.select("id", "content", "normalized_content", "created_at", "access_count")


@query(f"WITH {o.MEM} SELECT id, CASE WHEN turn > 0 THEN pinned END AS pinned, CASE WHEN turn > 0 THEN 'v2' END AS grade FROM memories")
def widened_memories(spark, sf_dir):
    rows = src.memories_from_conversations(spark, sf_dir).select("id", "pinned")
    first = F.split("id", "-")[1] == "0"
    return src.widen(rows.filter(first).drop("pinned"), rows.filter(~first).withColumn("grade", F.lit("v2"))).select("id", "pinned", "grade")


@query(f"WITH {o.MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY chat_id, character_id, type ORDER BY updated_at, id) AS nth FROM memories) SELECT chat_id, type, id, content FROM r WHERE nth = 1")
def oldest_by_type(spark, sf_dir):
    return duplicates.first_by_content(src.memories_from_conversations(spark, sf_dir), ["chat_id", "character_id", "type"]).select("chat_id", "type", "id", "content")


# Streams. The tables are read as streams; each query runs one until it has caught up and returns what it wrote.


def caught_up(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    else:
        writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, its times as timestamps. A table that is one file is found in its folder by name, as streams read folders."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    files = table.inputFiles()
    source = spark.readStream.schema(table.schema)
    one = len(files) == 1 and files[0].endswith(f"/{name}.parquet")
    rows = source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one else source.parquet(path)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in table.dtypes if kind == "timestamp_ntz"})


@query(f"WITH {o.LOG} SELECT id, count(*) AS uses, max(ts) AS last_use FROM log GROUP BY id")
def usage_from_stream(spark, sf_dir):
    log = src.access_log_from_events(spark, sf_dir, streamed(spark, sf_dir, "events"))
    return caught_up(streams.usage_stream(log), spark, "complete").withColumn("last_use", F.col("last_use").cast("timestamp_ntz"))


@query(f"""WITH {o.TURNS} SELECT chat_id, msg_idx, string_agg(text, '|') OVER (PARTITION BY chat_id ORDER BY msg_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM turns""")
def context_from_stream(spark, sf_dir):
    with streams.state_in_rocksdb(spark):
        rows = src.messages_from_conversations(spark, sf_dir, streamed(spark, sf_dir, "conversations"))
        return caught_up(streams.recent_context_stream(rows, 3), spark).select("chat_id", "msg_idx", F.array_join("recent", "|").alias("recent"))


@query("SELECT user_id || '-' || event_type AS turn_key, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def once_per_key_from_stream(spark, sf_dir):
    rows = streamed(spark, sf_dir, "events").select("ts", F.concat_ws("-", "user_id", "event_type").alias("turn_key"))
    return caught_up(streams.once_per_turn(rows, delay="3650 days"), spark).groupBy("turn_key").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts) AS day, event_type AS decision, count(*) AS n FROM events GROUP BY ALL")
def decisions_per_day_from_stream(spark, sf_dir):
    rows = streamed(spark, sf_dir, "events").select("ts", F.col("event_type").alias("decision"))
    return caught_up(streams.decision_counts(rows, width="1 day"), spark, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "decision", "n")


@query(f"""WITH {SAID}, {o.MEM}, c AS (SELECT m.*, {o.similarity("regexp_replace(content, '^\\s+|\\s+$', '', 'g')")} AS sim FROM memories m),
g AS (SELECT *, source <> 'auto' OR (sim <> '' AND NOT list_contains({o.listed(policy.LOW_VALUE)}, sim) AND length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 12 AND len({o.words('sim')}) >= 3 AND (len(keywords) >= 2 OR len(entities) >= 1 OR len({o.words('sim')}) >= 5)) AS ok FROM c)
SELECT chat_id, count(*) AS decided, count(DISTINCT normalized_content) AS contents FROM g WHERE ok GROUP BY chat_id""")
def store_from_stream(spark, sf_dir):
    """Decisions of the sequential store, counted per chat; the decisions themselves are held against the rule in the tests."""
    with streams.state_in_rocksdb(spark):
        rows = src.memories_from_conversations(spark, sf_dir, rows=dialogue_stream(spark, sf_dir)).withColumn("seq", F.split("id", "-")[1].cast("long"))
        got = caught_up(streams.store_stream(rows, merge=MergePolicy()), spark)
    keys = said_memories(spark, sf_dir).select("id", "normalized_content")
    return got.join(keys, "id").groupBy("chat_id").agg(F.count("*").alias("decided"), F.count_distinct("normalized_content").alias("contents"))


@query(f"WITH {SAID}, {o.ROLLING}, {f.SUMMARIES}")
def summaries_from_stream(spark, sf_dir):
    """Summaries of the scopes that each batch of a stream of memories touches, written per batch."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = streams.summary_batches(lambda: said_memories(spark, sf_dir), streams.replace_batch(f"{base}/out"), as_of, by_batch=True)
    rows = src.memories_from_conversations(spark, sf_dir, rows=dialogue_stream(spark, sf_dir))
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(run).start().awaitTermination()
    got = spark.read.schema(summary.rolling_summary(said_memories(spark, sf_dir), as_of()).schema).parquet(f"{base}/out")
    return got.select("chat_id", "character_id", "action", "summary_memory_id", "summary_text", joined("source_ids").alias("source_ids"), "summarized_count", "new_input_count", joined("metadata.keywords").alias("keywords"))


# Streams of several batches: a table comes in parts, one after another; part of it comes again; the query is stopped and goes on from its checkpoint.


def fed(spark: SparkSession, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], keys: list[str], order: list[str], mode: str = "append") -> DataFrame:
    """What make() writes of a stream that gets the parts one after another. A part is one batch, whatever number of files it has; the query ends after each and goes on from its checkpoint with the next. A key's rows of a part lie in order."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    for part in parts:
        part.repartition(*keys).sortWithinPartitions(*keys, *order).write.mode("append").parquet(f"{base}/feed")
        out = make(spark.readStream.schema(parts[0].schema).parquet(f"{base}/feed"))
        writer = out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").outputMode(mode)
        if mode == "append":
            writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        else:
            writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def in_turns(rows: DataFrame, *cuts: int, turn: str = "turn") -> list[DataFrame]:
    """rows cut by turn."""
    ends = [None, *cuts, None]
    within = lambda lo, hi: (F.lit(True) if lo is None else F.col(turn) >= lo) & (F.lit(True) if hi is None else F.col(turn) < hi)
    return [rows.filter(within(lo, hi)) for lo, hi in zip(ends, ends[1:], strict=False)]


_SHARED = "len(list_intersect(list_distinct([lower(x) for x in {a}.entities]), list_distinct([lower(x) for x in {b}.ents]))) >= 1 AND len(list_intersect(list_distinct({a}.keywords), list_distinct({b}.kws))) >= 2"
_STATE = "STRUCT(touched BIGINT, id VARCHAR, type VARCHAR, norm VARCHAR, content VARCHAR, imp DOUBLE, ents VARCHAR[], kws VARCHAR[], safe BOOLEAN)[]"
_UNION = "list_concat({old}, list_filter({new}, lambda x: NOT list_contains({old}, x)))"
_LONGER = "length(content) > length(hit.content) + 10"


@query(rf"""WITH RECURSIVE {SAID}, {o.MEM}, c AS (SELECT m.*, {o.similarity("regexp_replace(content, '^\\s+|\\s+$', '', 'g')")} AS sim FROM memories m),
gated AS (SELECT *, source <> 'auto' OR pinned OR archived AS safe, row_number() OVER (PARTITION BY chat_id, character_id ORDER BY turn) AS step FROM c WHERE source <> 'auto' OR (sim <> '' AND NOT list_contains({o.listed(policy.LOW_VALUE)}, sim) AND length(regexp_replace(content, '^\s+|\s+$', '', 'g')) >= 12
  AND len({o.words('sim')}) >= 3 AND (len(keywords) >= 2 OR len(entities) >= 1 OR len({o.words('sim')}) >= 5))),
walk AS (SELECT DISTINCT chat_id, character_id, 0::BIGINT AS step, NULL::VARCHAR AS id, NULL::VARCHAR AS decision, NULL::VARCHAR AS branch, NULL::VARCHAR AS matched_id, NULL::DOUBLE AS importance, NULL::VARCHAR AS content, []::{_STATE} AS mems FROM gated
  UNION ALL SELECT chat_id, character_id, step, id, CASE WHEN hit IS NULL THEN 'stored' WHEN exact AND hit.safe THEN 'skipped_exact_protected' ELSE 'updated' END, CASE WHEN hit IS NULL THEN 'new' WHEN exact THEN 'exact' ELSE 'soft' END, hit.id,
    CASE WHEN hit IS NULL THEN importance WHEN exact AND hit.safe THEN hit.imp ELSE least(hit.imp + CASE WHEN exact THEN 0.05 ELSE 0.03 END, 1)::DOUBLE END, CASE WHEN hit IS NULL OR (NOT (exact AND hit.safe) AND {_LONGER}) THEN content ELSE hit.content END,
    CASE WHEN hit IS NOT NULL AND exact AND hit.safe THEN mems WHEN hit IS NULL THEN list_append(mems, {{'touched': turn, 'id': id, 'type': type, 'norm': normalized_content, 'content': content, 'imp': importance, 'ents': entities, 'kws': keywords, 'safe': safe}})
      ELSE list_append(list_filter(mems, lambda m: m.id <> hit.id), {{'touched': turn, 'id': hit.id, 'type': hit.type, 'norm': CASE WHEN {_LONGER} THEN normalized_content ELSE hit.norm END, 'content': CASE WHEN {_LONGER} THEN content ELSE hit.content END,
        'imp': least(hit.imp + CASE WHEN exact THEN 0.05 ELSE 0.03 END, 1)::DOUBLE, 'ents': {_UNION.format(old="hit.ents", new="entities")}, 'kws': {_UNION.format(old="hit.kws", new="keywords")}, 'safe': hit.safe}}) END
  FROM (SELECT *, coalesce(same, near) AS hit, same IS NOT NULL AS exact FROM (SELECT g.* EXCLUDE (step), g.step, w.mems, list_filter(w.mems, lambda m: m.norm = g.normalized_content)[1] AS same,
    list_reverse_sort(list_filter(w.mems, lambda m: NOT m.safe AND m.type = g.type AND {_SHARED.format(a="g", b="m")}))[1] AS near FROM walk w JOIN gated g ON g.chat_id = w.chat_id AND g.character_id = w.character_id AND g.step = w.step + 1)))
SELECT id, decision, branch, matched_id, round(importance, 6) AS importance, sha256(content) AS content FROM walk WHERE step > 0""")
def decisions_from_stream(spark, sf_dir):
    """Decisions of the sequential store over three parts of the turns, the query being stopped after each."""
    with streams.state_in_rocksdb(spark):
        rows = durable(said_memories(spark, sf_dir).withColumn("seq", F.split("id", "-")[1].cast("long")))
        got = fed(spark, in_turns(rows, 3, 5, turn="seq"), lambda x: streams.store_stream(x, merge=MergePolicy()), ["chat_id", "character_id"], ["seq", "id"])
        return got.select("id", "decision", "branch", "matched_id", F.round("importance", 6).alias("importance"), F.sha2("content", 256).alias("content"))


_NEW = "len(list_filter(ids, lambda x: NOT list_contains(known, x)))"
_AGAIN = f.SUMMARIES.replace("WHEN summary_id IS NULL THEN 'created'", f"WHEN summary_id IS NOT NULL AND {_NEW} < 3 THEN 'skipped_not_enough_new_inputs' WHEN summary_id IS NULL THEN 'created'").replace("len(ids)::INTEGER AS new_input_count", f"{_NEW}::INTEGER AS new_input_count")
_WINDOW = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, character_id ORDER BY updated_at DESC, id DESC) AS nth FROM {rows} WHERE layer = 'episodic' AND NOT archived) WHERE nth <= 8 AND NOT is_summary"
_OLD = "SELECT chat_id, character_id, arg_min(id, nth) AS summary_id FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, character_id ORDER BY updated_at DESC, id DESC) AS nth FROM {rows} WHERE NOT archived) WHERE nth <= 50 AND (type = 'summary' OR is_summary) GROUP BY ALL"
_MADE = "sha256(chat_id || '#' || character_id || '#rolling_v1')"


@query(f"""WITH {SAID}, {o.MEM}, a AS (SELECT * FROM memories WHERE turn < 5), w1 AS ({_WINDOW.format(rows="a")}), o1 AS ({_OLD.format(rows="a")}),
i1 AS (SELECT chat_id, character_id, list(id ORDER BY nth DESC) AS known FROM w1 GROUP BY ALL HAVING count(*) >= 3), wrote AS (SELECT chat_id, character_id, known, coalesce(summary_id, {_MADE}) AS wrote_id FROM i1 LEFT JOIN o1 USING (chat_id, character_id)),
b AS (SELECT m.* REPLACE (CASE WHEN wrote_id = m.id THEN TIMESTAMP '{src.AS_OF}' ELSE m.updated_at END AS updated_at) FROM memories m LEFT JOIN wrote USING (chat_id, character_id)),
made AS (SELECT chat_id, character_id, id, type, is_summary, archived, updated_at FROM b UNION ALL SELECT chat_id, character_id, wrote_id, 'summary', true, false, TIMESTAMP '{src.AS_OF}' FROM wrote ANTI JOIN o1 USING (chat_id, character_id)), win AS ({_WINDOW.format(rows="b")}), o2 AS ({_OLD.format(rows="made")}),
inputs AS (SELECT chat_id, character_id, list(id ORDER BY nth DESC) AS ids, list(content ORDER BY nth) AS contents, list(keywords ORDER BY nth DESC) AS kws FROM win GROUP BY ALL),
rolled AS (SELECT chat_id, character_id, coalesce(ids, []::VARCHAR[]) AS ids, contents, kws, summary_id, NULL::VARCHAR AS summary_text, CASE WHEN summary_id = wrote_id THEN known ELSE []::VARCHAR[] END AS known FROM inputs FULL JOIN o2 USING (chat_id, character_id) LEFT JOIN wrote USING (chat_id, character_id)), {_AGAIN}""")
def resumed_summaries(spark, sf_dir):
    """Summaries after the fifth turn are written to the store; later turns then meet a scope's newest summary, which knows its sources if it is a written one. The text is shown where it is written."""
    rows = durable(said_memories(spark, sf_dir))
    parts = in_turns(rows.withColumn("turn", F.split("id", "-")[1].cast("int")), 5)
    first, later = (x.select(*src.COLUMNS) for x in parts)
    snapshot = summary.apply_summaries(first, durable(summary.rolling_summary(first, as_of())), as_of())
    return shown_summaries(summary.rolling_summary(snapshot.unionByName(later), as_of()))


def shown_summaries(got: DataFrame) -> DataFrame:
    text = F.when(F.col("action").isin("created", "updated"), F.col("summary_text")).otherwise(F.lit(""))
    return got.select("chat_id", "character_id", "action", "summary_memory_id", text.alias("summary_text"), joined("source_ids").alias("source_ids"), "summarized_count", "new_input_count", joined("metadata.keywords").alias("keywords"))


@query(f"""WITH RECURSIVE {SAID}, {o.MEM}, usable AS (SELECT *, CASE WHEN turn < 3 THEN 0 WHEN turn < 5 THEN 1 ELSE 2 END AS part, type = 'summary' OR is_summary AS rolling FROM memories WHERE NOT archived AND (layer = 'episodic' OR type = 'summary' OR is_summary)),
touched AS (SELECT DISTINCT chat_id, character_id, part FROM usable), seen AS (SELECT t.part AS upto, u.*, row_number() OVER (PARTITION BY t.part, u.chat_id, u.character_id, u.layer = 'episodic' ORDER BY updated_at DESC, id DESC) AS nth FROM touched t JOIN usable u ON t.chat_id = u.chat_id AND t.character_id = u.character_id AND u.part <= t.part),
lists AS (SELECT upto, chat_id, character_id, coalesce(list(id ORDER BY nth DESC) FILTER (layer = 'episodic' AND nth <= 8 AND NOT is_summary), []::VARCHAR[]) AS ids, list(content ORDER BY nth) FILTER (layer = 'episodic' AND nth <= 8 AND NOT is_summary) AS contents,
  list(keywords ORDER BY nth DESC) FILTER (layer = 'episodic' AND nth <= 8 AND NOT is_summary) AS kws, arg_max(id, (updated_at, id)) FILTER (rolling) AS own_id FROM seen GROUP BY ALL),
steps AS (SELECT *, row_number() OVER (PARTITION BY chat_id, character_id ORDER BY upto) AS step FROM lists),
walk AS (SELECT DISTINCT chat_id, character_id, 0::BIGINT AS step, []::VARCHAR[] AS known, NULL::VARCHAR AS wrote_id, []::VARCHAR[] AS before, NULL::VARCHAR AS summary_id FROM steps
  UNION ALL SELECT chat_id, character_id, step, CASE WHEN writes THEN ids ELSE known END, CASE WHEN writes THEN coalesce(summary_id, {_MADE}) ELSE wrote_id END, known, summary_id
  FROM (SELECT s.*, w.known, w.wrote_id, coalesce(w.wrote_id, s.own_id) AS summary_id, len(s.ids) >= 3 AND (coalesce(w.wrote_id, s.own_id) IS NULL OR len(list_filter(s.ids, lambda x: NOT list_contains(w.known, x))) >= 3) AS writes
    FROM walk w JOIN steps s ON s.chat_id = w.chat_id AND s.character_id = w.character_id AND s.step = w.step + 1)),
win AS (SELECT upto || '@' || chat_id AS chat_id, character_id, nth, content FROM seen WHERE layer = 'episodic' AND nth <= 8 AND NOT is_summary),
rolled AS (SELECT s.upto || '@' || chat_id AS chat_id, character_id, ids, contents, kws, w.summary_id, NULL::VARCHAR AS summary_text, w.before AS known FROM walk w JOIN steps s USING (chat_id, character_id, step)), {_AGAIN.replace("SELECT chat_id, character_id, action", "SELECT string_split(chat_id, '@')[2] AS chat_id, character_id, action").replace(_MADE, _MADE.replace("chat_id", "string_split(chat_id, '@')[2]", 1))}""")
def summaries_from_state(spark, sf_dir):
    """Incremental summaries over three parts of the turns, from state alone, the query being stopped after each: what each batch decides for each scope it touches."""
    micros = spark.sql(f"SELECT unix_micros(TIMESTAMP '{src.AS_OF}') AS t").first()["t"]
    with streams.state_in_rocksdb(spark):
        rows = durable(said_memories(spark, sf_dir).withColumn("turn", F.split("id", "-")[1].cast("int")))
        return shown_summaries(fed(spark, in_turns(rows, 3, 5), lambda x: streams.summary_stream(x, as_of=micros, skips=True), ["chat_id", "character_id"], ["turn"]))


@query(f"""WITH {o.TURNS} SELECT chat_id, msg_idx, string_agg(text, '|') OVER (PARTITION BY chat_id ORDER BY msg_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM turns""")
def context_from_batches(spark, sf_dir):
    """Recent context over three parts of the turns, the query being stopped after each."""
    with streams.state_in_rocksdb(spark):
        parts = in_turns(src.messages_from_conversations(spark, sf_dir), 2, 4, turn="msg_idx")
        return fed(spark, parts, lambda x: streams.recent_context_stream(x, 3), ["chat_id"], ["msg_idx"]).select("chat_id", "msg_idx", F.array_join("recent", "|").alias("recent"))


@query(f"WITH {o.LOG}, again AS (SELECT * FROM log UNION ALL SELECT * FROM log WHERE ts < (SELECT min(ts) + INTERVAL 3 DAY FROM log)) SELECT id, count(*) AS uses, max(ts) AS last_use FROM again GROUP BY id")
def usage_from_batches(spark, sf_dir):
    """Uses over three parts of the log, of which the third brings the first days' rows once more, late; the query is stopped after each part."""
    log = src.access_log_from_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    start = log.agg(F.min("ts").alias("t")).first()["t"]
    after = lambda days: F.lit(start) + F.make_dt_interval(F.lit(days))
    late = log.filter(F.col("ts") < after(3))
    parts = [log.filter(F.col("ts") < after(8)), log.filter((F.col("ts") >= after(8)) & (F.col("ts") < after(16))), log.filter(F.col("ts") >= after(16)).unionByName(late)]
    return fed(spark, parts, streams.usage_stream, ["id"], ["ts"], "complete").withColumn("last_use", F.col("last_use").cast("timestamp_ntz"))


#: Turns of a part have one time, ten days after the part before. A key's state goes when the watermark is past its time and the delay.
_PARTED = "e AS (SELECT user_id || '-' || event_type AS turn_key, least((day(ts) - 1) // 8, 3) AS part FROM events WHERE event_id % 3 = 0 OR event_type IN ('error', 'purchase'))"


@query(f"""WITH RECURSIVE {_PARTED}, k AS (SELECT DISTINCT turn_key, part FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY turn_key ORDER BY part) AS nth FROM k),
w AS (SELECT turn_key, part, nth, true AS emitted, part AS held FROM n WHERE nth = 1 UNION ALL SELECT n.turn_key, n.part, n.nth, n.part - w.held >= 2, CASE WHEN n.part - w.held >= 2 THEN n.part ELSE w.held END FROM w JOIN n ON n.turn_key = w.turn_key AND n.nth = w.nth + 1)
SELECT turn_key, (part)::INTEGER AS part FROM w WHERE emitted""")
def evicted_keys_from_batches(spark, sf_dir):
    """Each key once within a watermark that evicts: four parts, each ten days later than the one before, repeated rows within each and late rows of the first part in the last."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter((F.col("event_id") % 3 == 0) | F.col("event_type").isin("error", "purchase"))
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)).cast("int")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    keyed = durable(rows.select(F.concat_ws("-", "user_id", "event_type").alias("turn_key"), part.alias("part")).withColumn("ts", start + F.make_dt_interval(F.col("part") * 10)))
    parts = [keyed.filter(F.col("part") == i) for i in range(4)]
    parts[3] = parts[3].unionByName(parts[0])
    got = fed(spark, parts, lambda x: streams.once_per_turn(x, delay="1 day"), ["turn_key"], ["ts"])
    return got.select("turn_key", "part")


def dialogue_stream(spark, sf_dir) -> DataFrame:
    return dialogue(spark, sf_dir, streamed(spark, sf_dir, "conversations"))
