"""Prompt blocks from ranked memories, under item and character budgets, and lore anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import memory as m
from ..functions import text as t
from ..functions.policy import BudgetPolicy
from ..sources.durable import durable
from .contained import TOLD, contained, told_apart

HEADER, ANCHOR_HEADER = "[Relevant Memory]", "[Lore Anchor]"


def line(content: Column, pinned: Column, layer: Column, limit: int) -> Column:
    return F.concat(F.lit("- "), m.labels(pinned, layer), F.lit(" "), t.truncate_at_blank(content, limit))


def format_blocks(items: DataFrame, max_items: int = 4, limit: int = 120) -> DataFrame:
    """request_id, block, n_lines. items: request_id, rank, content, pinned, ret_layer. Equal contents count once; a request without items has no row."""
    stripped = F.regexp_replace("content", r"^\s+|\s+$", "")
    rows = items.withColumn("norm", t.normalize_similarity(stripped)).withColumn("blank", (stripped == "") | (F.col("norm") == ""))
    first = rows.withColumn("copy", F.row_number().over(W.partitionBy("request_id", "norm").orderBy("rank"))).withColumn("use", ~F.col("blank") & (F.col("copy") == 1))
    nth = F.sum(F.col("use").cast("int")).over(W.partitionBy("request_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    used = first.withColumn("nth", nth).withColumn("use", F.col("use") & (F.col("nth") <= max_items))
    text = F.when(F.col("use"), F.struct("rank", line(F.col("content"), F.col("pinned"), F.col("ret_layer"), limit).alias("line")))
    lines = used.groupBy("request_id").agg(F.array_sort(F.collect_list(text)).alias("lines"))
    return lines.select("request_id", F.concat_ws("\n", F.lit(HEADER), F.transform("lines", lambda x: x["line"])).alias("block"), F.size("lines").alias("n_lines"))


def budget_items(items: DataFrame, p: BudgetPolicy | None = None) -> DataFrame:
    """items (request_id, rank, id, content, pinned, ret_layer) with kept and trim_reason (layer_cap, item_cap or char_budget, with the layer).

    What goes first is fixed once the layers are capped: the last episodic, then the last stable, then the last summary. So the longest
    run in the order summary, stable, episodic that fits both limits stays.
    """
    p = p or BudgetPolicy()
    layer = F.col("ret_layer")
    rows = items.withColumn("in_layer", F.row_number().over(W.partitionBy("request_id", "ret_layer").orderBy("rank"))).withColumn("capped", F.col("in_layer") > m.by_layer(layer, p.caps))
    rows = rows.withColumn("line", line(F.col("content"), F.col("pinned"), layer, p.line))
    keep_first = W.partitionBy("request_id", "capped").orderBy(m.by_layer(layer, {"summary": 0, "stable": 1, "episodic": 2}), "rank")
    upto = keep_first.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.row_number().over(keep_first)).withColumn("chars", F.lit(len(HEADER)) + F.sum(F.char_length("line") + 1).over(upto))
    over_items, over_chars = F.col("nth") > p.items, F.col("chars") > p.chars
    reason = F.when(F.col("capped"), F.lit("layer_cap:")).when(over_items, F.lit("item_cap:")).when(over_chars, F.lit("char_budget:"))
    return rows.withColumn("trim_reason", F.concat(reason, layer)).withColumn("kept", F.col("trim_reason").isNull())


def budget_blocks(items: DataFrame, p: BudgetPolicy | None = None) -> DataFrame:
    """request_id, block, actual_chars, counts of returned, kept and trimmed items by layer, trim_reasons."""
    p = p or BudgetPolicy()
    rows = budget_items(items, p)
    count = lambda cond, name: F.count_if(cond).cast("int").alias(name)
    by = []
    for name in m.LAYERS:
        own = F.col("ret_layer") == name
        by += [count(own, f"retrieved_{name}"), count(own & F.col("kept"), f"injected_{name}"), count(own & ~F.col("kept"), f"trimmed_{name}")]
    lines = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("rank", "line"))))
    # Reasons in the order the items go: caps by rank, then from the end of what would be kept.
    gone = F.when(~F.col("kept"), F.struct(F.when(F.col("capped"), F.lit(0)).otherwise(F.lit(1)).alias("phase"), F.when(F.col("capped"), F.col("rank")).otherwise(-F.col("nth")).alias("at"), F.col("trim_reason").alias("r")))
    out = rows.groupBy("request_id").agg(
        lines.alias("lines"), F.transform(F.array_sort(F.collect_list(gone)), lambda x: x["r"]).alias("trim_reasons"),
        F.count("*").cast("int").alias("retrieved_items"), count(F.col("kept"), "injected_items"), count(~F.col("kept"), "trimmed_items"), *by,
    )
    block = F.when(F.size("lines") > 0, F.concat_ws("\n", F.lit(HEADER), F.transform("lines", lambda x: x["line"]))).otherwise(F.lit(""))
    return out.withColumn("block", block).withColumn("actual_chars", F.char_length("block")).drop("lines")


MARKER = r"(?im)^[ \t\x0B\f\r]*(?:\[memory-anchor\]|@memory-anchor(?:[ \t]*:[ \t]*.+)?)[ \t\x0B\f\r]*$"
EXPLICIT = r"(?im)^\s*@memory-anchor\s*:\s*(.+)\s*$"


def anchor_candidates(entries: DataFrame) -> DataFrame:
    """Allowed lore entries (from sources.lore_entries) with anchor_text: by tag or marker line."""
    comment, content = F.col("lore_comment"), F.col("lore_content")
    # Only texts that hold the marker's word are held against the patterns.
    marked = lambda c: F.lower(c).contains("memory-anchor")
    allowed = F.array_contains("lore_tags", "memory-anchor") | (marked(comment) & comment.rlike(MARKER)) | (marked(content) & content.rlike(MARKER))
    explicit = lambda c: F.when(marked(c), F.nullif(t.collapse(F.regexp_extract(c, EXPLICIT, 1)), F.lit("")))
    plain = lambda c: F.nullif(t.collapse(F.when(marked(c), F.regexp_replace(c, MARKER, "")).otherwise(c)), F.lit(""))
    text = F.coalesce(explicit(comment), explicit(content), plain(content), plain(comment))
    # Exploded, as a filter on a plain column would make the text once more.
    return entries.filter(allowed).withColumn("anchor_text", F.explode(F.array(text))).filter(F.col("anchor_text").isNotNull())


def anchor_blocks(entries: DataFrame, blocks: DataFrame | None = None, max_items: int = 1, max_chars: int = 220) -> DataFrame:
    """request_id, anchor_block, n_anchors, truncated. entries: request_id, pos and the columns of lore_entries(); blocks: request_id, block.

    Texts that repeat or already stand in the request's memory block are skipped; the first max_items stay, the last of them go
    until the rest fits, and a single one that is too long is cut.
    """
    rows = anchor_candidates(entries).withColumn("norm", F.lower(t.collapse(F.col("anchor_text"))))
    if blocks is not None:
        known = durable(blocks.select("request_id", F.lower(t.collapse(F.col("block"))).alias("known")))
        # Blocks may be long, so texts are looked up in pieces of them, and no row carries a block.
        rows = durable(told_apart(rows.select("request_id", "pos", "anchor_text", "norm"), "norm"))
        rows = rows.join(contained(rows, known, "request_id", "known"), ["request_id", *TOLD], "left_anti")
    rows = rows.withColumn("copy", F.row_number().over(W.partitionBy("request_id", "norm").orderBy("pos"))).filter("copy = 1")
    order = W.partitionBy("request_id").orderBy("pos")
    rows = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max_items)
    chars = F.lit(len(ANCHOR_HEADER)) + F.sum(F.char_length("anchor_text") + 3).over(order.rowsBetween(W.unboundedPreceding, 0))
    room = max_chars - len(ANCHOR_HEADER) - 3
    cut = F.concat(F.trim(F.substring("anchor_text", 1, max(room - 1, 0))), F.lit("…"))
    fits = F.col("chars") <= max_chars
    rows = rows.withColumn("chars", chars).filter(fits | ((F.col("nth") == 1) & F.lit(room > 1)))
    rows = rows.withColumn("text", F.when(fits, F.col("anchor_text")).otherwise(cut))
    done = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("ls"), F.max(~fits).alias("truncated"))
    return done.select("request_id", F.concat_ws("\n", F.lit(ANCHOR_HEADER), F.transform("ls", lambda x: F.concat(F.lit("- "), x["text"]))).alias("anchor_block"), F.size("ls").alias("n_anchors"), "truncated")
