"""Storing candidates: quality gate, exact and soft matches, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import memory as m
from ..functions import text as t
from ..functions.policy import GatePolicy, MergePolicy
from ..sources.durable import durable
from ..sources.memories import COLUMNS, create, metadata
from .duplicates import exact_matches, soft_matches
from .extract import quality_gate

KEYS = ["chat_id", "character_id", "normalized_content"]


def decide(memories: DataFrame, candidates: DataFrame, gate: GatePolicy | None = None, merge: MergePolicy | None = None) -> DataFrame:
    """candidates (id, request_id, msg_idx, memory columns, seq for their order) with decision, reason, branch and matched_id.

    The batch rule: matches are looked for among the memories as they were before the batch. Candidates of the batch with equal
    content in a scope follow the first of them: it is matched or stored, the others count as exact hits of the same memory.
    """
    # Gated candidates and their exact hits are read several times, so they are written once.
    gated = durable(quality_gate(candidates, gate).withColumn("normalized_content", t.normalize_content(F.col("content"))))
    bad = gated.filter("not gate_ok").select("*", F.lit(None).cast("string").alias("matched_id"), F.lit(False).alias("protected"), F.lit("quality_gate").alias("branch"))
    good = gated.filter("gate_ok")
    exact = durable(exact_matches(good, memories))
    state = memories.select(F.col("id").alias("existing_id"), (~m.can_auto_update()).alias("protected"))
    known = exact.filter("existing_id is not null").join(state, "existing_id").withColumn("branch", F.lit("exact")).withColumnRenamed("existing_id", "matched_id")
    rest = exact.filter("existing_id is null").drop("existing_id")
    first = rest.groupBy(*KEYS).agg(F.min(F.struct("seq", "id")).alias("f")).select(*KEYS, F.col("f.id").alias("leader"))
    rest = rest.join(first, KEYS)
    soft = soft_matches(rest.filter("id = leader"), memories, merge).select(F.col("candidate_id").alias("leader"), F.col("existing_id").alias("soft_id"))
    rest = rest.join(soft, "leader", "left")
    leads = F.col("id") == F.col("leader")
    branch = F.when(~leads, F.lit("exact")).when(F.col("soft_id").isNotNull(), F.lit("soft")).otherwise(F.lit("new"))
    rest = rest.withColumn("branch", branch).withColumn("matched_id", F.coalesce("soft_id", F.when(~leads, F.col("leader")))).withColumn("protected", F.lit(False))
    cols = [*gated.columns, "matched_id", "protected", "branch"]
    rows = bad.select(*cols).unionByName(known.select(*cols)).unionByName(rest.select(*cols))
    # Names of branches, decisions and reasons.
    decision = (
        F.when(F.col("branch") == "quality_gate", F.lit("skipped_low_value")).when(F.col("protected"), F.lit("skipped_exact_protected")).when(F.col("branch") == "new", F.lit("stored")).otherwise(F.lit("updated"))
    )
    reason = (
        F.when(F.col("branch") == "quality_gate", F.col("gate_reason")).when(F.col("protected"), F.lit("exact_match_not_auto_updatable"))
        .when(F.col("branch") == "new", F.lit("new_memory_created")).when(F.col("branch") == "soft", F.lit("soft_match_auto_updated")).otherwise(F.lit("exact_match_auto_updated"))
    )
    return rows.withColumn("decision", decision).withColumn("reason", reason)


def merge(memories: DataFrame, hits: DataFrame, as_of, p: MergePolicy | None = None) -> DataFrame:
    """memories with the hits (matched_id, branch, seq, content, metadata) folded in, in their order.

    Importance grows per hit, lists are united, content gives way to clearly longer content. Hits with equal content are
    combined before they are gathered, so a content that is repeated a million times is one element of the fold.
    """
    p = p or MergePolicy()
    lists = [F.coalesce(f"metadata.{c}", F.array().cast("array<string>")).alias(c) for c in ("entities", "keywords")]
    rows = hits.select("matched_id", "seq", "content", (F.col("branch") == "exact").alias("exact"), *lists)
    variants = rows.groupBy("matched_id", "content", "entities", "keywords").agg(F.min("seq").alias("seq"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_soft"))
    folded = variants.groupBy("matched_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "content", "entities", "keywords"))).alias("vs"), F.sum("n_exact").alias("n_exact"), F.sum("n_soft").alias("n_soft")
    )
    both = memories.join(folded, memories["id"] == folded["matched_id"], "left")
    hit = F.col("matched_id").isNotNull()
    content = F.aggregate("vs", F.col("content"), lambda acc, v: F.when(m.better_content(v["content"], acc, p.longer_by), v["content"]).otherwise(acc))
    empty = F.array().cast("array<string>")

    def united(field: str):
        return F.aggregate("vs", F.coalesce(f"metadata.{field}", empty), lambda acc, v: m.ordered_union(acc, v[field]))

    meta = F.col("metadata").withField("entities", united("entities")).withField("keywords", united("keywords")) if p.preserve_metadata else metadata(entities=united("entities"), keywords=united("keywords"))
    new = {
        "importance": F.least(F.col("importance") + F.col("n_exact") * p.exact_boost + F.col("n_soft") * p.soft_boost, F.lit(1.0)),
        "normalized_content": t.normalize_content(content), "content": content, "metadata": meta, "updated_at": as_of,
    }
    return both.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}).select(*COLUMNS)


def store(memories: DataFrame, candidates: DataFrame, as_of, gate: GatePolicy | None = None, merge_policy: MergePolicy | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshot after the batch, decisions). See decide() for the batch rule."""
    decided = durable(decide(memories, candidates, gate, merge_policy))
    made = create(decided.filter("decision = 'stored'"), as_of)
    every = memories.select(*COLUMNS).unionByName(made)
    return merge(every, decided.filter("decision = 'updated'"), as_of, merge_policy), decided


def store_counters(decided: DataFrame) -> DataFrame:
    """request_id, stored, updated, skipped."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    d = F.col("decision")
    return decided.groupBy("request_id").agg(n(d == "stored", "stored"), n(d == "updated", "updated"), n(d.startswith("skipped"), "skipped"))


def store_metrics(decided: DataFrame) -> DataFrame:
    """dimension (decision, reason, branch), label, n over all rows; one pass by grouping sets."""
    sets = decided.groupingSets([["decision"], ["reason"], ["branch"]], "decision", "reason", "branch").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, F.lit("decision")).when(F.col("g") == 5, F.lit("reason")).otherwise(F.lit("branch"))
    return sets.select(name.alias("dimension"), F.coalesce("decision", "reason", "branch").alias("label"), "n")


