"""Derived columns of memories: ages, buckets, layers, labels. as_of is always explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYERS = ("summary", "stable", "episodic")


def whole_days(since: Column, as_of: Column) -> Column:
    """Full 24-hour days, at least 0; null if since is null."""
    micros = F.unix_micros(as_of) - F.unix_micros(since)
    return F.when(micros.isNotNull(), F.greatest(F.floor(micros / F.lit(86_400_000_000)), F.lit(0)).cast("int"))


def parse_time(text: Column) -> Column:
    """ISO-8601 text to a timestamp; null for anything else."""
    return text.try_cast("timestamp")


def retrieval_layer(kind: Column | None = None, is_summary: Column | None = None, layer: Column | None = None) -> Column:
    kind = F.col("type") if kind is None else kind
    is_summary = F.col("metadata.is_summary") if is_summary is None else is_summary
    layer = F.col("layer") if layer is None else layer
    return F.when((kind == "summary") | F.coalesce(is_summary, F.lit(False)), F.lit("summary")).when(layer == "stable", F.lit("stable")).otherwise(F.lit("episodic"))


def by_layer(layer: Column, values: dict) -> Column:
    out = F.lit(values["episodic"])
    for name in ("summary", "stable"):
        out = F.when(layer == name, F.lit(values[name])).otherwise(out)
    return out


def recency(updated_at: Column, as_of: Column) -> Column:
    """1 / (1 + days); 0.5 for an unknown time. Times after as_of count as today."""
    return F.coalesce(1.0 / (1 + whole_days(updated_at, as_of)), F.lit(0.5))


def freshness(updated_days: Column) -> Column:
    return F.when(updated_days.isNull() | (updated_days <= 7), F.lit("fresh")).when(updated_days <= 30, F.lit("warm")).otherwise(F.lit("stale"))


def activity(access_count: Column, last_accessed_at: Column, accessed_days: Column) -> Column:
    return (
        F.when((access_count <= 0) | last_accessed_at.isNull(), F.lit("never_used"))
        .when((access_count >= 5) | F.coalesce(accessed_days <= 14, F.lit(False)), F.lit("active"))
        .otherwise(F.lit("low_use"))
    )


def touch_state(access_count: Column, updated_days: Column, accessed_days: Column) -> Column:
    return (
        F.when(F.coalesce(accessed_days <= 14, F.lit(False)), F.lit("recently_accessed"))
        .when(F.coalesce(updated_days <= 14, F.lit(False)), F.lit("recently_updated"))
        .when((access_count <= 0) & F.coalesce(updated_days > 30, F.lit(False)), F.lit("stale_unused"))
        .otherwise(F.lit("quiet"))
    )


def can_auto_update(prefix: str = "") -> Column:
    return (F.col(prefix + "source") == "auto") & ~F.col(prefix + "pinned") & ~F.col(prefix + "archived")


def cards(memories: DataFrame, as_of: Column) -> DataFrame:
    """memories with their ages, freshness, activity and touch state."""
    aged = memories.withColumns({"updated_days": whole_days(F.col("updated_at"), as_of), "accessed_days": whole_days(F.col("last_accessed_at"), as_of)})
    return aged.withColumns(
        {
            "freshness": freshness(F.col("updated_days")),
            "activity": activity(F.col("access_count"), F.col("last_accessed_at"), F.col("accessed_days")),
            "touch_state": touch_state(F.col("access_count"), F.col("updated_days"), F.col("accessed_days")),
        }
    )


def labels(pinned: Column, layer: Column) -> Column:
    return F.concat_ws(" ", F.when(pinned, F.lit("[PINNED]")), F.concat(F.lit("["), F.upper(layer), F.lit("]")))


def better_content(new: Column, old: Column, longer_by: int = 10) -> Column:
    return F.char_length(new) > F.char_length(old) + longer_by


def ordered_union(old: Column, new: Column) -> Column:
    """old as it is, then what is new in new."""
    return F.concat(old, F.array_except(new, old))


def turn_key(chat: Column, character: Column, length: Column, text: Column) -> Column:
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("::", blank(chat), blank(character), F.coalesce(length, F.lit(0)).cast("string"), blank(text))
