"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points run through the sources' cumulative targets and give every output slot a source.
Slots are ranked per source; rank r takes the r-th equal-token block of the source's shuffled documents,
starting over when the source is used up. Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, durable

BLOCK_WORDS = 1024
GOLDEN = 0.6180339887498949
#: Cells of a source's shuffled order, which bound what one task sorts, and the least and most of the unit interval.
CELLS, MOST_CELLS = 4096, 1 << 20
#: So many equal rows stay one row until their place is known.
COPIES = 1024
NAME = ["unnamed", "name"]


def named(df: DataFrame) -> DataFrame:
    """df with its source as a key without nulls, in the order of code points with the null source last."""
    return df.withColumns({"unnamed": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})


def running(df: DataFrame, order: list[str], keys: tuple[str, ...] = (), **sums: Column) -> DataFrame:
    """df with a column for each of sums: its sum over all earlier rows in the order, among those of equal keys.

    order and keys have no nulls and name a row. Rows are dealt in ranges and summed within them; what whole ranges
    hold is added from a table of a row per range and key, so neither the table nor a frequent key meets in one task.
    """
    dealt = durable(df.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))
    within = W.partitionBy("part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    nothing = F.lit(0)
    parts = dealt.groupBy("part", *keys).agg(*[F.sum(c).alias(f"{n}_part") for n, c in sums.items()])
    before = parts.select("part", *keys, *[F.coalesce(F.sum(f"{n}_part").over(earlier), nothing).alias(f"{n}_before") for n in sums])
    here = dealt.withColumns({f"{n}_here": F.coalesce(F.sum(c).over(within), nothing) for n, c in sums.items()})
    return here.join(before, ["part", *keys]).select(*df.columns, *[(F.col(f"{n}_before") + F.col(f"{n}_here")).alias(n) for n in sums])


def golden_point(i: Column) -> Column:
    """The fractional part of (i + 0.5) / phi, in two parts so that large i keep their digits."""
    high, low = F.shiftright(i, 20), i.bitwiseAND(F.lit((1 << 20) - 1))
    return F.pmod(high * F.lit((GOLDEN * (1 << 20)) % 1.0) + (low + 0.5) * GOLDEN, F.lit(1.0))


def source_targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sid, source, source_size, target: weights 1, 2, 3 repeating by code point, null last; at most max_epochs times the source.

    Water filling in closed form: in the order of capacity per weight the capped sources come first, so
    each source is compared with the level that is left when all before it are capped.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = (
        running(named(per_source), NAME, sid=F.lit(1))
        .withColumn("weight", (F.pmod("sid", F.lit(3)) + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    by_ratio = durable(running(weighed, ["ratio", "sid"], cap_before=F.col("cap"), weight_before=F.col("weight")))
    size, weight = by_ratio.agg(F.sum("source_size"), F.sum("weight")).first()
    levels = by_ratio.withColumn("level", (F.lit(size).cast("long") - F.col("cap_before")) / (F.lit(weight).cast("long") - F.col("weight_before")))
    free = F.col("ratio") > F.col("level")
    final = levels.filter(free).agg(F.min_by("level", F.struct("ratio", "sid"))).first()[0]
    target = F.when(free, F.col("weight") * F.lit(final).cast("double")).otherwise(F.col("cap")).cast("double")
    return levels.select("sid", "source", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, sid, rank, epoch, block, words: which block of which source each slot takes, and how many words of it.

    A source needs one slot a block until its target is met; the last is cut to the word. The sequence gives
    each source its share to within a few slots: what it draws too many is left out, what it lacks follows at the end.
    """
    spark = targets.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    whole = F.floor(F.col("words_due") / F.col("source_size")).cast("long")
    rest = F.col("words_due") - F.col("whole") * F.col("source_size")
    due = (
        targets.filter("source_size > 0")
        .withColumn("words_due", F.round("target").cast("long"))
        .filter("words_due > 0")
        .withColumn("n_blocks", blocks)
        .withColumn("whole", whole)
        .withColumn("rest", rest)
        .withColumn("quota", F.col("whole") * F.col("n_blocks") + F.ceil(F.col("rest") / block_words).cast("long"))
        .select("sid", "quota", "n_blocks", "source_size", "whole", "rest")
    )
    plan = durable(running(due, ["sid"], before=F.col("quota")))
    n_slots, n_sources = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    # As many cells as sources, so that a point meets few intervals.
    cells = min(MOST_CELLS, max(CELLS, 1 << max(n_sources - 1, 0).bit_length()))
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1)).cast("int")
    low, high = F.col("before") / F.lit(n_slots), (F.col("before") + F.col("quota")) / F.lit(n_slots)
    intervals = plan.select("sid", low.alias("low"), high.alias("high")).withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u")).withColumn("cell", cell(F.col("u")))
    drawn = points.join(intervals, "cell").filter("u >= low and u < high").select("slot", "sid", F.shiftright("slot", 12).alias("run"))
    runs = drawn.groupBy("sid", "run").agg(F.count("*").alias("n"))
    starts = durable(running(runs, ["run"], keys=("sid",), start=F.col("n")))
    in_run = W.partitionBy("sid", "run").orderBy("slot")
    ranked = drawn.join(starts.drop("n").join(plan.drop("before"), "sid"), ["sid", "run"]).withColumn("rank", F.col("start") + F.row_number().over(in_run) - 1)
    counts = starts.groupBy("sid").agg(F.sum("n").alias("n"))
    lacking = (
        plan.drop("before")
        .join(counts, "sid", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .filter("n < quota")
        .withColumn("slot", F.lit(None).cast("long"))
        .withColumn("rank", F.explode(F.sequence(F.col("n"), F.col("quota") - 1)))
    )
    epoch = F.floor(F.col("rank") / F.col("n_blocks")).cast("long")
    size = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    left = F.when(F.col("epoch") == F.col("whole"), F.col("rest") - F.col("block") * block_words).otherwise(size)
    return (
        ranked.drop("run", "start")
        .unionByName(lacking.drop("n"))
        .filter("rank < quota")
        .withColumn("epoch", epoch)
        .withColumn("block", F.col("rank") - F.col("epoch") * F.col("n_blocks"))
        .withColumn("words", F.least(size, left))
        .select("slot", "sid", "rank", "epoch", "block", "words")
    )


def mix(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs.

    Null or blank texts have size 0 and are never taken. A null source is a source of its own, the last. Rows
    that repeat are taken each for itself; an id that many rows share, null too, is shuffled by size and in bundles
    of equal rows, so its rows lie apart. Empty table: empty result. Other columns are ignored.
    """
    size = F.greatest(F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)), F.lit(0)).cast("long")
    rows = durable(docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    targets = durable(source_targets(rows.select("source", (F.col("size") * F.col("n")).alias("size"))))
    place = [*NAME, "cell"]
    lines = (
        named(rows)
        .withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
        .withColumn("n", F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("bundle") * COPIES))
        .withColumn("order", F.xxhash64("doc_id", "size", "bundle", F.lit(seed)))
        .withColumn("cell", F.pmod("order", F.lit(CELLS)).cast("int"))
        .withColumn("words", F.col("size") * F.col("n"))
    )
    upto = W.partitionBy(*NAME).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = lines.groupBy(*place).agg(F.sum("words").alias("words")).withColumn("start", F.coalesce(F.sum("words").over(upto), F.lit(0))).drop("words")
    known = lines.join(durable(starts.join(named(targets).drop("source"), NAME)), place)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    result = ["doc_id", "source", "size", "source_size", "target"]
    in_cell = W.partitionBy(*place).orderBy("order", "doc_id", "size", "bundle")
    placed = (
        known.filter("size > 0")
        .withColumn("nth", F.row_number().over(in_cell))
        .withColumn("at", F.col("start") + F.sum("words").over(in_cell.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("copy", copies)
        .withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
        .select("sid", "cell", "nth", "copy", "at", *result)
    )
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    pieces = placed.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    begin = F.greatest(F.col("at") - F.col("block") * block_words, F.lit(0))
    end = F.least(F.col("at") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    takes = schedule(targets, block_words).groupBy("sid", "block", "words").agg(F.count("*").alias("times"))
    got = F.col("times") * F.greatest(F.least("end", "words") - F.col("begin"), F.lit(0))
    taken = (
        pieces.withColumn("begin", begin)
        .withColumn("end", end)
        .join(takes, ["sid", "block"], "left")
        .groupBy("sid", "cell", "nth", "copy", *result)
        .agg(F.coalesce(F.sum(got), F.lit(0)).cast("long").alias("taken"))
    )
    blank = known.filter("size = 0").withColumn("copy", copies).withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*result, "taken").unionByName(blank.select(*result, "taken"))
