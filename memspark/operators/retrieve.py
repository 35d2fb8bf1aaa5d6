"""Scored, layered and diverse retrieval of memories for many requests at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import memory as m
from ..functions import policy
from ..functions import text as t
from ..functions.policy import ScorePolicy
from ..sources.durable import durable
from .overlap import in_cells

SCOPE = ["chat_id", "character_id"]


def query_features(requests: DataFrame, p: ScorePolicy | None = None, lemmas: dict[str, str] | None = None) -> DataFrame:
    """requests (request_id, chat_id, character_id, user_input, recent_messages, limit, include_archived) with the query's features.

    Recent messages add their keywords and entities; their relationship cues count only if the query has cues itself.
    """
    p = p or ScorePolicy()
    q = F.col("user_input")
    recent = F.coalesce(F.transform("recent_messages", lambda x: x["text"]), F.array().cast("array<string>"))
    rows = requests.withColumns(
        {
            "query_keywords": t.keywords(q, p.keywords, lemmas), "query_entities": t.entities(q, p.entities, lemmas), "query_cues": t.relationship_cues(q),
            "recent_keywords": F.flatten(F.transform(recent, lambda x: t.keywords(x, p.keywords, lemmas))), "recent_entities": F.flatten(F.transform(recent, lambda x: t.entities(x, p.entities, lemmas))),
            "recent_cues": F.flatten(F.transform(F.transform(recent, lambda x: F.lower(F.coalesce(x, F.lit("")))), lambda x: t.cues_in(x, policy.RELATIONSHIP_CUES))), "scene_query": t.is_scene_query(q),
        }
    )
    related = F.size("query_cues") > 0
    return rows.withColumns(
        {
            "relationship_query": related,
            "in_keywords": F.array_distinct(F.concat("query_keywords", "recent_keywords")),
            "in_entities": F.array_distinct(F.transform(F.concat("query_entities", "recent_entities"), F.lower)),
            "in_cues": F.when(related, F.array_distinct(F.concat("query_cues", "recent_cues"))).otherwise(F.col("query_cues")),
            "query_norm": t.normalize_similarity(q), "n_in_entities": F.size(F.array_distinct(F.concat("query_entities", "recent_entities"))),
        }
    )


def memory_features(memories: DataFrame) -> DataFrame:
    """memories with the columns that scoring reads; computed once a row, so worth keeping in the table."""
    norm = t.normalize_similarity(F.col("content"))
    return memories.withColumns(
        {
            "ret_layer": m.retrieval_layer(), "norm": norm, "tokens": t.token_set(norm), "cues": t.relationship_cues(F.col("content")),
            "detail": t.scene_detail(F.col("content"), F.size(t.keywords(F.col("content"))), F.size(t.entities(F.col("content")))),
            "asks": F.rtrim(F.col("content")).endswith("?"),
        }
    )


def _share(shared: Column, total: Column) -> Column:
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def _met(asked: DataFrame, kept: DataFrame, as_of: Column, p: ScorePolicy, at_least: float | None) -> DataFrame:
    """request_id, id of pairs that share a term, and with at_least only of those whose score may reach it.

    A memory's postings carry its impact, the parts of the score that it brings whatever is asked. Counts of shared terms give the overlaps themselves, so
    the bound is the score without the penalty for echoes, and pairs below it go before a memory's row is met. Frequent terms are met in cells.
    """
    tag = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind), x))
    related = F.when(F.col("relationship_query"), tag("c:", "in_cues")).otherwise(F.array().cast("array<string>"))
    q_terms = asked.select("request_id", *SCOPE, F.explode(F.array_distinct(F.concat(tag("k:", "in_keywords"), tag("e:", "in_entities"), related))).alias("term"))
    impact = F.col("importance") * p.importance + m.recency(F.col("updated_at"), as_of) * p.recency + F.when(F.col("pinned"), F.lit(p.pinned)).otherwise(F.lit(0.0))
    detailed = (F.col("layer") == "episodic") & (F.col("detail") >= p.detail)
    parts = [impact.alias("impact"), m.by_layer(F.col("ret_layer"), p.support).alias("support"), detailed.alias("detailed")] if at_least is not None else []
    m_terms = kept.select("id", *SCOPE, *parts, F.explode(F.array_distinct(F.concat(tag("k:", "keywords"), tag("e:", "entities"), tag("c:", "cues")))).alias("term"))
    met = in_cells(q_terms, m_terms, [*SCOPE, "term"], "request_id", "id")
    if at_least is None:
        return met.select("request_id", "id").distinct()
    n = lambda kind, name: F.count_if(F.col("term").startswith(kind)).alias(name)
    pairs = met.groupBy("request_id", "id").agg(n("k:", "nk"), n("e:", "ne"), n("c:", "nc"), *[F.max(c).alias(c) for c in ("impact", "support", "detailed")])
    sizes = asked.select("request_id", "scene_query", *[F.size(f"in_{c}").alias(c) for c in ("keywords", "entities", "cues")])
    pairs = pairs.join(sizes, "request_id")
    kw, ent, cue = _share(F.col("nk"), F.col("keywords")), _share(F.col("ne"), F.col("entities")), _share(F.col("nc"), F.col("cues"))
    bonus = F.when(cue > 0, F.col("support")).otherwise(F.lit(0.0)) + F.when(F.col("scene_query") & F.col("detailed"), F.lit(p.specificity)).otherwise(F.lit(0.0))
    most = p.keyword * kw + p.entity * ent + p.cue * cue + F.when((kw > 0) & (ent > 0), F.lit(p.both)).otherwise(F.lit(0.0)) + bonus + _weight(kw, ent) * F.col("impact")
    return pairs.filter(F.coalesce(most >= at_least - 1e-9, F.lit(True))).select("request_id", "id")


def _weight(kw: Column, ent: Column) -> Column:
    """How much importance, age and pins count, by how much of the query's content is met."""
    content = 0.65 * kw + 0.35 * ent
    return F.when(content >= 0.60, F.lit(1.0)).when(content >= 0.30, F.lit(0.6)).otherwise(F.lit(0.25))


def score(requests: DataFrame, memories: DataFrame, as_of: Column, p: ScorePolicy | None = None, prune: bool = True, at_least: float | None = None) -> DataFrame:
    """One row per request and memory of its scope with the parts of its score.

    requests: from query_features(); memories: from memory_features(). prune drops pairs that share no term, whose score is 0: these
    are found by a join on terms, so a request meets only memories it has something in common with. prune=False scores all of the scope.
    at_least: with prune, only pairs with this score are wanted, so others are dropped by bounds before memories are met; all rows that stay have their full score.
    """
    p = p or ScorePolicy()
    asked = requests.select(
        "request_id", *SCOPE, "in_keywords", "in_entities", "n_in_entities", "in_cues", "relationship_query", "scene_query", "query_norm",
        F.coalesce("include_archived", F.lit(False)).alias("include_archived"), F.col("limit").alias("top"),
    )
    kept = memories.select(
        "id", *SCOPE, "content", "pinned", "archived", "importance", "updated_at", "layer", "ret_layer", "norm", "tokens", "cues", "detail", "asks",
        F.array_distinct(F.col("metadata.keywords")).alias("keywords"), F.array_distinct(F.transform("metadata.entities", F.lower)).alias("entities"),
    )
    if prune:
        asked, kept = durable(asked), durable(kept)  # features are read for terms and for pairs
        pairs = _met(asked, kept, as_of, p, at_least).join(asked, "request_id").join(kept.drop(*SCOPE), "id")
    else:
        pairs = asked.join(kept, SCOPE)
    pairs = pairs.filter(F.col("include_archived") | ~F.col("archived"))
    n = lambda a, b: F.size(F.array_intersect(a, b))
    pairs = pairs.withColumns(
        {
            "keyword_overlap": _share(n("keywords", "in_keywords"), F.size("in_keywords")),
            "entity_overlap": _share(n("entities", "in_entities"), F.size("in_entities")),
            "cue_overlap": F.when(F.col("relationship_query"), _share(n("cues", "in_cues"), F.size("in_cues"))).otherwise(F.lit(0.0)),
        }
    )
    kw, ent, cue = F.col("keyword_overlap"), F.col("entity_overlap"), F.col("cue_overlap")
    query_tokens = t.token_set(F.col("query_norm"))
    echo = (F.col("norm") != "") & (F.col("query_norm") != "") & (F.col("query_norm").contains(F.col("norm")) | (t.overlap_ratio(F.col("tokens"), query_tokens) >= p.echo))
    episodic = F.col("layer") == "episodic"
    pairs = pairs.withColumns(
        {
            "matched": (kw > 0) | (ent > 0) | (cue > 0),
            "support_bonus": F.when(F.col("relationship_query") & (cue > 0), m.by_layer(F.col("ret_layer"), p.support)).otherwise(F.lit(0.0)),
            "specificity_bonus": F.when(episodic & F.col("scene_query") & (F.col("detail") >= p.detail), F.lit(p.specificity)).otherwise(F.lit(0.0)),
            "low_value_penalty": F.when(episodic & F.col("asks") & echo & (F.col("detail") < p.detail), F.lit(p.low_value)).otherwise(F.lit(0.0)),
            "recency": F.when((kw > 0) | (ent > 0) | (cue > 0), m.recency(F.col("updated_at"), as_of)).otherwise(F.lit(0.0)),
        }
    )
    weight = _weight(kw, ent)
    side = F.col("importance") * p.importance + F.col("recency") * p.recency + F.when(F.col("pinned"), F.lit(p.pinned)).otherwise(F.lit(0.0))
    both = F.when((kw > 0) & (ent > 0), F.lit(p.both)).otherwise(F.lit(0.0))
    raw = p.keyword * kw + p.entity * ent + p.cue * cue + both + F.col("support_bonus") + F.col("specificity_bonus") + weight * side - F.col("low_value_penalty")
    total = F.when(F.col("matched"), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    scored = pairs.withColumn("score", total).withColumn("passed", F.col("score") >= p.threshold)
    return scored if at_least is None else scored.filter(F.col("score") >= at_least)


def plain_top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each request by score, time and id."""
    order = W.partitionBy("request_id").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


CHOSEN = "array<struct<score:double,id:string,layer:string>>"
#: Layers by priority within a band, the first one first.
PRIORITY = ("summary", "stable", "episodic")


#: Entries of a layer that a request's selection begins with, and how much more it gets when it needs deeper ones.
FRONTIER, DEEPER = 63, 16


class NeedsDeeper(Exception):
    """A selection asks for entries below those it was given."""


def banded(entries: list[dict], band: float, cut: float | None = None) -> Iterator[dict]:
    """Entries by score; those within `band` of a band's best go by layer priority, time and id, all descending.

    A band opens at its best score, so unlike comparing neighbours this is a total order and doesn't depend on the input's order.
    Bands are made as they are asked for, so a pass that stops early sorts no more. cut: entries up to this score may be missing; asking for a
    band that reaches it raises NeedsDeeper.
    """
    by_score, at = sorted(entries, key=lambda e: -e["score"]), 0
    while at < len(by_score):
        best, end = by_score[at]["score"], at
        if cut is not None and best - cut <= band:
            raise NeedsDeeper
        while end < len(by_score) and best - by_score[end]["score"] <= band:
            end += 1
        own = sorted(by_score[at:end], key=lambda e: (e["updated_at"], e["id"]), reverse=True)
        yield from sorted(own, key=lambda e: PRIORITY.index(e["layer"]))
        at = end
    if cut is not None:
        raise NeedsDeeper


def select_entries(entries: list[dict], top: int, p: ScorePolicy, cuts: dict[str, float] | None = None) -> tuple[list[dict], list[str]]:
    """What is chosen of one request's passing entries, best first, and the ids that were tried and too similar. See select_layered().

    cuts: for each layer of which entries are missing, the score from which on downwards they may be. NeedsDeeper is raised where they could matter.
    """
    chosen, taken, dropped, cuts = [], set(), {}, cuts or {}

    def similar(e: dict) -> bool:
        for s in chosen:
            smaller = min(len(s["tokens"]), len(e["tokens"]))
            if s["norm"] == e["norm"] or (smaller and len(s["tokens"] & e["tokens"]) / smaller >= p.similar):
                return True
        return e["norm"] == ""

    def fits(e: dict) -> bool:
        """Takes e unless it is too similar."""
        if similar(e):
            dropped[e["id"]] = True
            return False
        chosen.append(e)
        taken.add(e["id"])
        return True

    if top >= 3:
        for layer in PRIORITY:
            if len(chosen) < top:
                next((e for e in banded([e for e in entries if e["layer"] == layer], p.band, cuts.get(layer)) if e["id"] not in taken and fits(e)), None)
    for capped in (True, False):
        if len(chosen) >= top:
            break
        for e in banded(entries, p.band, max(cuts.values(), default=None)):
            if e["id"] not in taken and not (capped and sum(s["layer"] == e["layer"] for s in chosen) >= p.caps[e["layer"]]):
                fits(e)
            if len(chosen) >= top:
                break
    best = sorted(chosen, key=lambda e: (e["score"], e["updated_at"], e["id"]), reverse=True)
    return best, list(dropped)


def select_layered(scored: DataFrame, p: ScorePolicy | None = None, frontier: int = FRONTIER) -> DataFrame:
    """request_id, selected array (ranked), filtered_ids: three greedy passes over each request's passing entries.

    From a limit of 3 on the best of each layer comes first; then the best under the layers' caps; then the best without caps.
    An entry too similar to one already chosen is skipped. The passes of a request run in one small function over a frontier: the best entries of each
    layer, kept by a limit that tasks apply before rows move. Where a pass could take a deeper entry, that request alone runs again with a
    frontier DEEPER times as long. So a request gathers all its entries only if nearly all of them are too similar to what is chosen.
    """
    p = p or ScorePolicy()
    entry = F.struct("score", F.unix_micros("updated_at").alias("updated_at"), "id", F.col("ret_layer").alias("layer"), F.when(F.col("norm") == "", F.lit("")).otherwise(F.sha2("norm", 256)).alias("norm"), F.transform("tokens", lambda x: F.xxhash64(x)).alias("tokens"))
    passing = scored.filter("passed").select("request_id", F.coalesce("top", F.lit(5)).alias("top"), "ret_layer", "score", entry.alias("entry"))
    kind = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.string()), ("layer", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            selected, filtered, more = [], [], []
            for top, entries in zip(batch.column("top").to_pylist(), batch.column("entries"), strict=True):
                listed = [e | {"tokens": set(e["tokens"]), "updated_at": -(2**62) if e["updated_at"] is None else e["updated_at"]} for e in entries.as_py()]
                scores = {x: [e["score"] for e in listed if e["layer"] == x] for x in PRIORITY}
                try:
                    best, dropped = select_entries(listed, top, p, {x: min(s) for x, s in scores.items() if len(s) > size})
                    more.append(False)
                except NeedsDeeper:
                    best, dropped = [], []
                    more.append(True)
                selected.append([{k: e[k] for k in ("score", "id", "layer")} for e in best])
                filtered.append(dropped)
            yield pa.record_batch([batch.column("request_id"), pa.array(selected, kind), pa.array(filtered, pa.list_(pa.string())), pa.array(more, pa.bool_())], ["request_id", "selected", "filtered_ids", "more"])

    done, size = None, frontier
    while True:
        # One entry more than the frontier tells whether a layer has deeper ones.
        nth = F.row_number().over(W.partitionBy("request_id", "ret_layer").orderBy(F.desc("score"), F.col("entry.id")))
        kept = passing.withColumn("nth", nth).filter(F.col("nth") <= size + 1)
        gathered = kept.groupBy("request_id").agg(F.max("top").alias("top"), F.collect_list("entry").alias("entries"))
        got = durable(gathered.mapInArrow(lambda b, n=size: run(b, n), f"request_id string, selected {CHOSEN}, filtered_ids array<string>, more boolean"))
        ready = got.filter("not more").drop("more")
        done = ready if done is None else done.unionByName(ready)
        again = got.filter("more").select("request_id")
        if again.isEmpty():
            return done
        passing, size = passing.join(again, "request_id", "left_semi"), size * DEEPER


def retrieve(requests: DataFrame, memories: DataFrame, as_of: Column, p: ScorePolicy | None = None, lemmas: dict[str, str] | None = None, prune: bool = True) -> DataFrame:
    """One row per request and scored candidate: the parts of its score, selected, rank, filtered_by_diversity, reason."""
    p = p or ScorePolicy()
    # Scores are read by the selection and by the result, so they are written once.
    scored = durable(score(query_features(requests, p, lemmas), memory_features(memories), as_of, p, prune))
    chosen = durable(select_layered(scored, p))
    ranks = chosen.select("request_id", F.posexplode("selected").alias("i", "s")).select("request_id", F.col("s.id").alias("id"), (F.col("i") + 1).alias("rank"))
    dropped = chosen.select("request_id", F.explode("filtered_ids").alias("id"), F.lit(True).alias("filtered_by_diversity"))
    out = scored.join(ranks, ["request_id", "id"], "left").join(dropped, ["request_id", "id"], "left")
    reason = (
        F.when(~F.col("passed"), F.lit("below_threshold")).when(F.col("rank").isNotNull(), F.lit("selected_top")).when(F.col("filtered_by_diversity"), F.lit("filtered_near_duplicate")).otherwise(F.lit("not_in_top_limit"))
    )
    return out.withColumns({"selected": F.col("rank").isNotNull(), "filtered_by_diversity": F.coalesce("filtered_by_diversity", F.lit(False)) & F.col("rank").isNull()}).withColumn("reason", reason)


def access_log(retrieved: DataFrame, ts: Column) -> DataFrame:
    """id, ts: one use per returned item."""
    return retrieved.filter("selected").select("id", ts.alias("ts"))
