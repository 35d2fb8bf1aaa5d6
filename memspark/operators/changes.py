"""Snapshots after edits, reviews, toggles, deletions and uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.memories import COLUMNS, HISTORY

EDITABLE = ("type", "content", "source", "layer", "importance", "pinned", "archived")


def apply_changes(memories: DataFrame, changes: DataFrame, merge_metadata: bool = False) -> DataFrame:
    """The snapshot after changes (id, seq, ts, action, and nullable columns to set).

    action: update, delete, toggle_pinned or toggle_archived. Of several updates the last value given for a column wins; a toggle turns the
    flag as set by updates once for each odd count. New content is normalised anew. updated_at moves only if something was given. A metadata
    change replaces the whole struct, or only its given fields under merge_metadata. Changes to unknown ids are ignored.
    """
    have = [c for c in (*EDITABLE, "metadata") if c in changes.columns]
    update = F.col("action") == "update"
    given = [F.max_by(F.col(c), F.when(update & F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in have]
    touched = F.lit(False)
    for c in have:
        touched = touched | F.col(c).isNotNull()
    odd = lambda name: (F.count_if(F.col("action") == name) % 2 == 1)
    folded = changes.groupBy("id").agg(
        *given, F.max(F.when((update & touched) | F.col("action").startswith("toggle"), F.col("ts"))).alias("new_ts"), F.max(F.col("action") == "delete").alias("deleted"),
        odd("toggle_pinned").alias("flip_pinned"), odd("toggle_archived").alias("flip_archived"),
    )
    rows = memories.join(folded, "id", "left").filter(~F.coalesce("deleted", F.lit(False)))
    new = {c: F.coalesce(f"new_{c}", c) for c in have if c not in ("metadata", "content")}
    for flag in ("pinned", "archived"):
        new[flag] = new.get(flag, F.col(flag)) != F.coalesce(f"flip_{flag}", F.lit(False))
    if "content" in have:
        content = F.trim("new_content")
        new["content"] = F.coalesce(content, F.col("content"))
        new["normalized_content"] = F.when(content.isNotNull(), t.normalize_content(content)).otherwise(F.col("normalized_content"))
    if "metadata" in have:
        if merge_metadata:
            names = [f.name for f in memories.schema["metadata"].dataType.fields]
            new["metadata"] = F.struct(*[F.coalesce(f"new_metadata.{n}", f"metadata.{n}").alias(n) for n in names])
        else:
            new["metadata"] = F.coalesce("new_metadata", "metadata")
    new["updated_at"] = F.coalesce("new_ts", "updated_at")
    return rows.withColumns(new).select(*COLUMNS)


# Review actions and the status each sets.
REVIEW_STATUS = {"mark_consolidated_archive": "consolidated_archive", "mark_reviewed_keep": "reviewed_keep", "link_to_related_memory": "linked_to_related"}


def apply_reviews(memories: DataFrame, reviews: DataFrame) -> DataFrame:
    """The snapshot after reviews (id, seq, ts, action, related_memory_id, note), whose history each memory keeps.

    An unknown action adds to the history but keeps the status; an archiving one also archives. The last related memory and note given stay.
    """
    status = F.lit(None).cast("string")
    for action, value in REVIEW_STATUS.items():
        status = F.when(F.col("action") == action, F.lit(value)).otherwise(status)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    entry = F.struct("seq", F.struct("action", F.col("ts").alias("timestamp"), blank("related_memory_id").alias("related_memory_id"), blank("note").alias("note")).alias("e"))
    last = lambda c, name: F.max_by(c, F.when(c.isNotNull(), F.col("seq"))).alias(name)
    folded = reviews.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).cast(HISTORY).alias("added"), last(status, "status"), last(blank("related_memory_id"), "related"), last(blank("note"), "note"),
        F.max(F.col("action") == "mark_consolidated_archive").alias("archives"), F.max("ts").alias("ts"),
    )
    rows = memories.join(folded, "id", "left")
    meta = F.col("metadata")
    history = F.concat(F.coalesce(meta["consolidation_history"], F.array().cast(HISTORY)), "added")
    changed = (
        meta.withField("review_status", F.coalesce("status", meta["review_status"])).withField("related_memory_id", F.coalesce("related", meta["related_memory_id"]))
        .withField("consolidation_note", F.coalesce("note", meta["consolidation_note"])).withField("consolidation_history", history)
    )
    hit = F.col("added").isNotNull()
    return rows.withColumns({"metadata": F.when(hit, changed).otherwise(meta), "archived": F.col("archived") | F.coalesce("archives", F.lit(False)), "updated_at": F.coalesce("ts", "updated_at")}).select(*COLUMNS)


def apply_usage(memories: DataFrame, log: DataFrame) -> DataFrame:
    """memories with the access log (id, ts) added to access_count and last_accessed_at; the log is summed before the join."""
    uses = log.groupBy("id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_use"))
    rows = memories.join(uses, "id", "left")
    return rows.withColumns({"access_count": F.col("access_count") + F.coalesce("uses", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "last_use")}).select(*COLUMNS)


def usage_counts(log: DataFrame) -> DataFrame:
    """id, uses, last_use; also for streams, in update mode."""
    return log.groupBy("id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_use"))
