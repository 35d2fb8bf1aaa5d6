"""SimHash document fingerprints and the search within a Hamming radius. Only DataFrame operations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import ascii_lower, durable

BITS = 128
RADIUS = 3
BLOCKS = 5
#: Near copies lie up to about 12 bits apart, unrelated texts beyond 40.
COPY_RADIUS = 12
#: What separates terms: ASCII other than letters and digits.
TERM_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def term_weight(term: Column) -> Column:
    """1 to 16, growing with the square of the term's length: short words are the frequent ones."""
    n = F.least(F.char_length(term), F.lit(8))
    return F.greatest(F.floor(n * n / 4), F.lit(1)).cast("long")


def _lanes(term: Column) -> list[Column]:
    """Votes for bit i and bit i + 32 of a hash, in the two halves of a long; texts under 2**27 terms can't overflow a half."""
    weight = F.when(term.isNull() | (term == ""), F.lit(0)).otherwise(term_weight(term)).cast("long")
    hashes = [F.xxhash64(term, F.lit(k)) for k in range(BITS // 64)]
    return [F.shiftrightunsigned(h, i).bitwiseAND(F.lit(0x100000001)) * weight for h in hashes for i in range(32)] + [weight]


def _half(lanes: list[Column], total: Column) -> Column:
    """64 bits: each is set where the ones outweigh half of the total."""
    low = [(F.when(x.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > total, F.lit(1 << i)).otherwise(F.lit(0))).cast("long") for i, x in enumerate(lanes)]
    high = [F.when(F.shiftrightunsigned(x, 32) * 2 > total, F.shiftleft(F.lit(1).cast("long"), 32 + i)).otherwise(F.lit(0).cast("long")) for i, x in enumerate(lanes)]
    out = low[0]
    for x in [*low[1:], *high]:
        out = out.bitwiseOR(x)
    return out


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, hi, lo: the fingerprint's halves for each row; keys must tell rows apart. No text or no terms: zero.

    Terms are exploded and their votes summed per row, so long texts need no large arrays of votes.
    """
    term = F.explode_outer(F.split(ascii_lower(F.col(text)), TERM_BREAK)).alias("term")
    sums = [F.sum(x).alias(f"v{i}") for i, x in enumerate(_lanes(F.col("term")))]
    votes = rows.select(*keys, term).groupBy(*keys).agg(*sums)
    v, n = [F.col(f"v{i}") for i in range(BITS // 2)], F.col(f"v{BITS // 2}")
    return votes.select(*keys, _half(v[:32], n).alias("hi"), _half(v[32:], n).alias("lo"))


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def as_hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def block_keys(hi: Column, lo: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """One key a table: the fingerprint's bits are cut into blocks, and each table is keyed by blocks - radius of them.

    Two fingerprints within the radius differ in at most `radius` blocks, so they share a key in some table.
    """
    bits = F.concat(F.lpad(F.bin(hi), 64, "0"), F.lpad(F.bin(lo), 64, "0"))
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    part = lambda k: F.substring(bits, edges[k] + 1, edges[k + 1] - edges[k])
    return F.array(*[F.xxhash64(F.lit(t), *[part(k) for k in kept]) for t, kept in enumerate(combinations(range(blocks), blocks - radius))])


def search(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """hi, lo, n_near: for each different query fingerprint the rows of prints within the radius (equal ones included), counted.

    Equal fingerprints are counted before the join, so copies add no rows. All rows are found: keys only propose, distances decide.
    """
    counted = prints.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    index = counted.withColumn("key", F.explode(block_keys(F.col("hi"), F.col("lo"), radius, blocks)))
    asked = queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")).distinct()
    asked = asked.withColumn("key", F.explode(block_keys(F.col("q_hi"), F.col("q_lo"), radius, blocks)))
    near = hamming((F.col("hi"), F.col("lo")), (F.col("q_hi"), F.col("q_lo"))) <= radius
    found = asked.join(index, "key").filter(near).select("q_hi", "q_lo", "hi", "lo", "n").distinct()
    return found.groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("n").alias("n_near"))


def block_values(hi: Column, lo: Column, blocks: int = BLOCKS) -> list[Column]:
    """The fingerprint's bits from the highest down, cut into blocks, as longs; the first ones get the bits left over."""
    out, at = [], 0
    for width in _shares(BITS, blocks):
        end = at + width
        if end <= 64 or at >= 64:
            value = F.shiftrightunsigned(hi if end <= 64 else lo, (64 if end <= 64 else 128) - end)
        else:
            value = F.shiftleft(hi, end - 64).bitwiseOR(F.shiftrightunsigned(lo, 128 - end))
        out.append(value.bitwiseAND(F.lit((1 << width) - 1)))
        at = end
    return out


def _shares(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def search_wide(queries: DataFrame, prints: DataFrame, radius: int = COPY_RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """As search(), for radii that leave no equal blocks: each block allows so many flips that some block of any pair within the radius has no more.

    The allowed flips plus one sum to radius + 1 over the blocks, so exactly as many differing bits can't exceed them all. Only the queries'
    blocks are flipped, the prints have one key a block. A pair is counted in the first block that proposes it.
    """
    spark = prints.sparkSession
    flips = [n - 1 for n in _shares(radius + 1, blocks)]
    masks = [(k, sum(1 << b for b in c)) for k, (width, most) in enumerate(zip(_shares(BITS, blocks), flips, strict=True)) for n in range(most + 1) for c in combinations(range(width), n)]
    own, asked_for = block_values(F.col("hi"), F.col("lo"), blocks), block_values(F.col("q_hi"), F.col("q_lo"), blocks)
    counted = prints.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    index = counted.select("hi", "lo", "n", F.posexplode(F.array(*own)).alias("block", "key"))
    asked = queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")).distinct()
    asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q_hi", "q_lo")
    masks = F.broadcast(spark.createDataFrame(masks, "block int, mask long"))
    value = F.element_at(F.array(*asked_for), F.col("block") + 1)
    asked = asked.crossJoin(masks).select("q_hi", "q_lo", "block", value.bitwiseXOR(F.col("mask")).alias("key"))
    near = hamming((F.col("hi"), F.col("lo")), (F.col("q_hi"), F.col("q_lo"))) <= radius
    proposes = [F.bit_count(a.bitwiseXOR(b)) <= most for a, b, most in zip(own, asked_for, flips, strict=True)]
    first = F.lit(True)
    for k, p in enumerate(proposes[:-1]):
        first = first & ((F.col("block") <= k) | ~p)
    found = asked.join(index, ["block", "key"]).filter(near).filter(first)
    return found.groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("n").alias("n_near"))


def with_next(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """doc_id, text, next_text, block, nth, tail: each document with the one after it in descending doc_id (after the last: the first).

    Documents go to blocks of neighbouring ids, cut at quantiles; each block's first document is also sent to the
    block above as its tail, so one shuffle of the texts gives every document its follower and no task sees all rows.
    Rows with the same id follow each other by the hash of their text; null ids come last.
    """
    spark = docs.sparkSession
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))])
    block = F.size(F.filter(cuts, lambda c: c <= F.col("doc_id")))
    heads = rows.select("doc_id").withColumn("block", block).groupBy("block").agg(F.max("doc_id").alias("head")).orderBy("block").collect()
    # At most n heads: the first of a block is the tail of the block above, that of the highest is the tail of the lowest.
    above = [(r["head"], heads[(i + 1) % len(heads)]["block"]) for i, r in enumerate(heads)]
    tails = F.broadcast(spark.createDataFrame(above, "head long, goes_to int"))
    placed = rows.withColumn("block", block).join(tails, F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own, also = (F.struct(b.alias("block"), F.lit(t).alias("tail")) for b, t in ((F.col("block"), False), (F.col("goes_to"), True)))
    spread = placed.select("doc_id", "text", F.explode(F.when(F.col("goes_to").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("x"))
    order = W.partitionBy("block").orderBy("tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    rows = spread.select("doc_id", "text", "x.block", "x.tail")
    return rows.select("*", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("nth"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near, n_copies for every row.

    The edited text has its last third replaced by the start of the next document. n_near, for ids divisible by 100,
    is the number of other rows within the Hamming radius of 3, n_copies that within the radius of near copies. Null texts are empty; equal texts get equal fingerprints;
    an empty table gives an empty result; other columns are ignored.
    """
    n = F.char_length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n.cast("int") - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    rows = with_next(docs).select("block", "nth", "tail", "doc_id", n.alias("n_chars"), "text", edited.alias("edited"))
    keys = ["block", "nth", "tail", "doc_id", "n_chars", "edited_sha256", "kind"]
    kinds = F.when(F.col("tail"), F.array(F.struct(F.lit("own").alias("kind"), F.col("text").alias("body")))).otherwise(
        F.array(F.struct(F.lit("own").alias("kind"), F.col("text").alias("body")), F.struct(F.lit("edited").alias("kind"), F.col("edited").alias("body")))
    )
    both = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(*keys[:-1], F.explode(kinds).alias("x"))
    prints = simhash(both.select(*keys[:-1], "x.kind", "x.body"), keys, "body")
    of = lambda half, kind: F.max(F.when(F.col("kind") == kind, F.col(half)))
    wide = prints.groupBy(*keys[:-1]).agg(of("hi", "own").alias("hi"), of("lo", "own").alias("lo"), of("hi", "edited").alias("e_hi"), of("lo", "edited").alias("e_lo"))
    after = W.partitionBy("block").orderBy("nth")
    pairs = wide.select("*", F.lead("hi").over(after).alias("n_hi"), F.lead("lo").over(after).alias("n_lo")).filter("not tail")
    likeness = lambda a, b: 1.0 - hamming((F.col("hi"), F.col("lo")), (F.col(a), F.col(b))) / F.lit(float(BITS))
    done = durable(
        pairs.select("doc_id", "n_chars", "edited_sha256", "hi", "lo", "e_hi", "e_lo", likeness("e_hi", "e_lo").alias("near_edited"), likeness("n_hi", "n_lo").alias("near_next"))
    )
    asked = F.col("doc_id") % 100 == 0
    near = search(done.filter(asked), done).withColumnRenamed("n_near", "n_all")
    copies = search_wide(done.filter(asked), done).withColumnRenamed("n_near", "n_wide")
    counted = done.filter(asked).join(near, ["hi", "lo"], "left").join(copies, ["hi", "lo"], "left")
    counted = counted.withColumn("n_near", F.col("n_all") - 1).withColumn("n_copies", F.col("n_wide") - 1).drop("n_all", "n_wide")
    none = F.lit(None).cast("long")
    rest = done.filter(~F.coalesce(asked, F.lit(False))).withColumn("n_near", none).withColumn("n_copies", none)
    return counted.unionByName(rest).select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("hi"), F.col("lo")).alias("fingerprint"), as_hex(F.col("e_hi"), F.col("e_lo")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near", "n_copies"
    )
