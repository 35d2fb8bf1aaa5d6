"""Rolling summaries of the newest episodic memories of every scope, in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import policy
from ..functions import text as t
from ..functions.policy import SummaryPolicy
from ..sources.memories import metadata

SCOPE = ["chat_id", "character_id"]


def _newest() -> W:
    return W.partitionBy(*SCOPE).orderBy(F.desc("updated_at"), F.desc("id"))


def existing_summaries(memories: DataFrame, p: SummaryPolicy | None = None) -> DataFrame:
    """Each scope's newest rolling summary among its p.newest newest unarchived memories (None: all)."""
    p = p or SummaryPolicy()
    ranked = memories.filter("not archived").withColumn("nth", F.row_number().over(_newest()))
    if p.newest is not None:
        ranked = ranked.filter(F.col("nth") <= p.newest)
    rolling = (F.col("type") == "summary") | (F.coalesce("metadata.is_summary", F.lit(False)) & F.coalesce(F.col("metadata.summary_kind") == p.kind, F.lit(False)))
    latest = ranked.filter(rolling).withColumn("first", F.row_number().over(W.partitionBy(*SCOPE).orderBy("nth"))).filter("first = 1")
    return latest.select(*SCOPE, F.col("id").alias("summary_id"), F.col("content").alias("summary_text"), F.coalesce("metadata.summary_source_memory_ids", F.array().cast("array<string>")).alias("known_ids"))


def episodic_window(memories: DataFrame, window: int = 8) -> DataFrame:
    """The newest `window` unarchived episodic memories of each scope, of which summaries are then left out. nth counts from the newest."""
    ranked = memories.filter("layer = 'episodic' and not archived").withColumn("nth", F.row_number().over(_newest()))
    return ranked.filter(F.col("nth") <= max(window, 1)).filter(~F.coalesce("metadata.is_summary", F.lit(False)))


def summary_inputs(memories: DataFrame, p: SummaryPolicy | None = None) -> DataFrame:
    """A row per scope that has inputs: source_ids from old to new, counts, the existing summary if any, and the contents from new to old."""
    p = p or SummaryPolicy()
    item = F.struct("nth", "id", "content", F.col("metadata.entities").alias("entities"), F.col("metadata.keywords").alias("keywords"))
    grouped = episodic_window(memories, p.window).groupBy(*SCOPE).agg(F.array_sort(F.collect_list(item)).alias("newest_first"))
    joined = grouped.join(existing_summaries(memories, p), SCOPE, "full")
    items = F.coalesce("newest_first", F.expr("array()").cast(grouped.schema["newest_first"].dataType))
    ids = F.reverse(F.transform(items, lambda x: x["id"]))
    joined = joined.withColumn("newest_first", items).withColumn("source_ids", ids)
    new = F.when(F.col("summary_id").isNull(), F.size("source_ids")).otherwise(F.size(F.filter("source_ids", lambda x: ~F.array_contains("known_ids", x))))
    return joined.withColumn("summarized_count", F.size("source_ids")).withColumn("new_input_count", new)


def _segments(items: Column, hints: list[str], most: int) -> Column:
    """The newest distinct contents that hold a hint, cut short."""
    flat = lambda x: t.collapse(F.lower(x["content"]))
    hit = F.filter(items, lambda x: t.contains_any(F.lower(x["content"]), hints)) if hints else items
    keys = F.transform(hit, flat)
    first = F.filter(hit, lambda x, i: F.array_position(keys, flat(x)) == i + 1)
    return F.slice(F.transform(first, lambda x: t.truncate_at_blank(x["content"], 120, dots="", strip_stops=True)), 1, most)


# The frame around a summary's parts.
HEAD, EVENTS, RELATED, GOALS = "Краткая сводка последних эпизодов (", "Недавние события: ", "Изменения в отношениях: ", "Текущие цели и состояние: "


def summary_text(items: Column, p: SummaryPolicy) -> Column:
    """The fixed Russian frame around up to three events, one relationship change and two goals or states."""
    events, related, goals = _segments(items, [], p.segments), _segments(items, policy.SUMMARY_RELATIONSHIP, 1), _segments(items, policy.SUMMARY_GOALS, 2)
    part = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(name), F.array_join(xs, "; "), F.lit(".")))
    head = F.concat(F.lit(HEAD), F.size(items).cast("string"), F.lit("):"))
    text = F.concat_ws(" ", head, part(EVENTS, events), part(RELATED, related), part(GOALS, goals))
    return F.when(F.size(items) > 0, text).otherwise(F.lit(""))


def summary_metadata(text: Column, items: Column, source_ids: Column, count: Column, as_of: Column, p: SummaryPolicy, lemmas: dict[str, str] | None = None) -> Column:
    """A summary's metadata: features of its text united with those of its inputs (newest first), and what it covers."""
    union = lambda first, field, most: F.slice(F.array_distinct(F.concat(first, F.flatten(F.transform(F.reverse(items), lambda x: F.coalesce(x[field], F.array().cast("array<string>")))))), 1, most)
    return metadata(
        entities=union(t.entities(text, lemmas=lemmas), "entities", 10), keywords=union(t.keywords(text, lemmas=lemmas), "keywords", 12), is_summary=F.lit(True),
        summary_kind=F.lit(p.kind), summary_generated_at=as_of, summary_source_memory_ids=source_ids, summarized_memory_count=count,
    )


def rolling_summary(memories: DataFrame, as_of: Column, p: SummaryPolicy | None = None, lemmas: dict[str, str] | None = None) -> DataFrame:
    """One result per scope: action (created, updated or a reason for neither), the summary's id, text and metadata, source_ids, counts."""
    p = p or SummaryPolicy()
    rows = summary_inputs(memories, p)
    action = (
        F.when(F.col("summarized_count") < p.min_inputs, F.lit("skipped_not_enough_inputs"))
        .when(F.col("summary_id").isNotNull() & (F.col("new_input_count") < p.min_new), F.lit("skipped_not_enough_new_inputs"))
        .when(F.col("summary_id").isNull(), F.lit("created"))
        .otherwise(F.lit("updated"))
    )
    rows = rows.withColumn("action", action).withColumn("writes", F.col("action").isin("created", "updated"))
    rows = rows.withColumn("text", F.when(F.col("writes"), summary_text(F.col("newest_first"), p)).otherwise(F.coalesce("summary_text", F.lit(""))))
    meta = summary_metadata(F.col("text"), F.col("newest_first"), F.col("source_ids"), F.col("summarized_count"), as_of, p, lemmas)
    made_id = F.sha2(F.concat_ws("#", *SCOPE, F.lit(p.kind)), 256)
    return rows.select(
        *SCOPE, "action", F.when(F.col("action") == "created", made_id).otherwise(F.col("summary_id")).alias("summary_memory_id"), F.col("text").alias("summary_text"),
        "source_ids", "summarized_count", "new_input_count", F.lit(p.min_new).alias("refresh_threshold"), F.when(F.col("writes"), meta).alias("metadata"),
    )


def apply_summaries(memories: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """The snapshot after the results' writes: new summary rows appended, existing ones replaced."""
    from ..sources.memories import COLUMNS

    written = results.filter("metadata is not null").select("summary_memory_id", *SCOPE, "summary_text", F.col("metadata").alias("new_metadata"), "action")
    old = memories.join(written.filter("action = 'updated'").select(F.col("summary_memory_id").alias("id"), "summary_text", "new_metadata"), "id", "left")
    hit = F.col("new_metadata").isNotNull()
    changes = {
        "content": F.col("summary_text"), "normalized_content": t.normalize_content(F.col("summary_text")), "type": F.lit("summary"), "importance": F.lit(0.9), "updated_at": as_of, "metadata": F.col("new_metadata"),
    }
    old = old.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in changes.items()}).select(*COLUMNS)
    new = written.filter("action = 'created'").select(
        F.col("summary_memory_id").alias("id"), *SCOPE, F.lit("summary").alias("type"), F.col("summary_text").alias("content"), t.normalize_content(F.col("summary_text")).alias("normalized_content"),
        F.lit("auto").alias("source"), F.lit("stable").alias("layer"), F.lit(0.9).alias("importance"), as_of.alias("created_at"), as_of.alias("updated_at"), F.lit(None).cast("timestamp").alias("last_accessed_at"),
        F.lit(0).cast("long").alias("access_count"), F.lit(False).alias("pinned"), F.lit(False).alias("archived"), F.col("new_metadata").alias("metadata"),
    )
    return old.unionByName(new.select(*COLUMNS))
