"""Ranked lexical search by pipelined term partitioning.

Terms are owned by successive stages: rare terms, whose weights are high, by the first, the most frequent by the last. Documents are
dealt into slices and items into bundles. A bundle meets a slice with a sparse accumulator of (item, document, score) entries, which
travels through the stages: in each a cogroup brings the postings that the stage owns, whose integer contributions are added. Entries that
can't reach a slice's best k any more, whatever later stages add, are left behind, which is exact. The last stage picks each slice's best
k, and a window picks them over all slices. Frequent terms come last, so what they touch is never shuffled, and as every posting list is cut by slices,
no owner holds a frequent term's postings alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import KeyFilter, durable

#: Documents of a slice, items of a bundle (about), stages, and the width of a stage's band of weights.
SLICE, BUNDLE, STAGES, BAND = 4096, 256, 4, 2000
#: Bytes of a text that are cut into terms at a time, and terms whose place in the filter a task remembers.
PIECE, KNOWN = 1 << 20, 500_000
#: No term's factor beside its weight reaches this.
MOST = 1_000_000
CAPS = pa.list_(pa.struct([("item", pa.int32()), ("stage", pa.int32()), ("cap", pa.int64())]))
#: Separators become spaces and A-Z lower case. Letters, digits and all bytes of characters beyond ASCII make terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> Counter[bytes]:
    """The terms of a UTF-8 text, counted piece by piece."""
    out: Counter[bytes] = Counter()
    at, text = 0, text or b""
    while at < len(text):
        end = at + PIECE
        while end < len(text) and FOLD[text[end]] != 32:
            end += 1
        out.update(text[at:end].translate(FOLD).split())
        at = end
    return out


def _index(batches: Iterator[pa.RecordBatch], wanted: KeyFilter | None, size: int) -> Iterator[pa.RecordBatch]:
    """Per slice a row for each wanted term (documents and occurrences), and one without a term: the documents' ids and lengths."""
    task, n_slices, known = TaskContext.get().partitionId(), 0, {}
    names = ["slice", "term", "docs", "tfs", "ids", "lens"]
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            texts, found, lens = part.column("text").cast(pa.binary()), {}, []
            for some in range(0, len(texts), 64):
                counts = [terms(x.as_py()) for x in texts.slice(some, 64)]
                if len(known) > KNOWN:
                    known.clear()
                new = list({t for c in counts for t in c if t not in known})
                if new:
                    hashes = np.array([xxhash.xxh64_intdigest(t, 42) for t in new], dtype=np.uint64)
                    known.update(zip(new, wanted.has(hashes.view(np.int64)).tolist(), strict=True))
                for doc, count in enumerate(counts, some):
                    lens.append(sum(count.values()))
                    for term, tf in count.items():
                        if known[term]:
                            docs, tfs = found.setdefault(term, ([], []))
                            docs.append(doc)
                            tfs.append(tf)
            key, n_slices, n = task << 32 | n_slices, n_slices + 1, len(found)
            docs, tfs = ([np.array(x[i], kind).tobytes() for x in found.values()] for i, kind in ((0, "<u2"), (1, "<i4")))
            nothing = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.record_batch([pa.array([key] * n, pa.int64()), pa.array(list(found), pa.binary()), pa.array(docs, pa.binary()), pa.array(tfs, pa.binary()), nothing, nothing], names)
            one = pa.nulls(1, pa.binary())
            ids = pa.ListArray.from_arrays([0, len(lens)], part.column("id"))
            yield pa.record_batch([pa.array([key]), one, one, one, ids, pa.array([lens], pa.list_(pa.int64()))], names)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each item, and one without a term for the item itself; item: its number in the bundle, which is the partition."""
    bundle, item = TaskContext.get().partitionId(), 0
    for batch in batches:
        for key, text in zip(batch.column("id"), batch.column("text").cast(pa.binary()), strict=True):
            count, n = terms(text.as_py()), 1
            n += len(count)
            yield pa.record_batch([pa.array([bundle] * n, pa.int32()), pa.array([item] * n, pa.int32()), pa.array([key.as_py()] * n, pa.int64()), pa.array([None, *count], pa.binary()), pa.array([0, *count.values()], pa.int64())], ["bundle", "item", "item_id", "term", "q"])
            item += 1


def _lengths(batches: Iterator[pa.RecordBatch], n: int, total: int) -> Iterator[pa.RecordBatch]:
    """Each document's m = 100 - 75 + (75 * length * n) div total, in whole numbers of any size."""
    for batch in batches:
        ms = [np.array([25 + 75 * x * n // max(1, total) for x in lens], dtype="<i8").tobytes() for lens in batch.column("lens").to_pylist()]
        yield pa.record_batch([batch.column("slice"), batch.column("ids"), pa.array(ms, pa.binary())], ["slice", "ids", "m"])


def _numbers(cell: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype=kind)


def added(left: pa.Table, right: pa.Table) -> np.ndarray:
    """The bundle's scores in the slice, items by documents, after the postings of a stage."""
    m, n_items = _numbers(left["m"][0], "<i8"), left["n_items"][0].as_py()
    scores = np.zeros((n_items, len(m)), np.int64)
    scores.ravel()[_numbers(left["at"][0], "<u4")] = _numbers(left["score"][0], "<i8")
    if right.num_rows:
        cells = [[_numbers(x, kind) for x in right[name]] for name, kind in (("docs", "<u2"), ("tfs", "<i4"))]
        docs, tfs = (np.concatenate(x) for x in cells)
        tfs, sizes = tfs.astype(np.int64), [len(x) for x in cells[0]]
        part = np.repeat(right["w"].to_numpy(), sizes) * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[docs]))
        end = 0
        for n, asks in zip(sizes, right["asks"], strict=True):
            at, end = end, end + n
            for item, q in zip(asks.values.field("item").to_pylist(), asks.values.field("q").to_pylist(), strict=True):
                scores[item, docs[at:end]] += q * part[at:end]
    return scores


def _floors(scores: np.ndarray, k: int) -> np.ndarray:
    """Each item's k-th best score so far, at least 1."""
    if scores.shape[1] <= k:
        return np.ones(len(scores), np.int64)
    return np.maximum(np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k], 1)


def _owner(stage: int, k: int):
    """For a cogroup: adds the postings that the stage owns and hands on the entries that may still be among the best k."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        scores = added(left, right)
        later = np.zeros(len(scores), np.int64)
        for cap in left["caps"][0].as_py() or []:
            if cap["stage"] > stage:
                later[cap["item"]] += cap["cap"]
        alive = (scores > 0) & (scores + later[:, None] >= _floors(scores, k)[:, None])
        at = np.flatnonzero(alive)
        kept = [left[c].cast(CAPS) if c == "caps" else left[c] for c in ("slice", "bundle", "n_items", "caps", "ids", "m")]
        return pa.table([*kept, pa.array([at.astype("<u4").tobytes()]), pa.array([scores.ravel()[at].astype("<i8").tobytes()])], [*"slice bundle n_items caps ids m at score".split()])

    return run


def _last(k: int):
    """For the last stage's cogroup: each item's best k of the slice."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        scores, ids = added(left, right), left["ids"][0].values
        item, doc = np.nonzero(scores >= _floors(scores, k)[:, None])
        score, order_id, none = scores[item, doc], ids.fill_null(0).to_numpy()[doc], ids.is_null().to_numpy(zero_copy_only=False)[doc]
        order = np.lexsort((doc, order_id, none, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        best = np.arange(len(item)) - np.searchsorted(item, item, "left") < k
        item, doc, score = item[best], doc[best], score[best]
        same = lambda c: pa.array(np.repeat(left[c].to_numpy(), len(item)))
        return pa.table([same("slice"), same("bundle"), pa.array(item.astype(np.int32)), pa.array(doc.astype(np.int32)), ids.take(pa.array(doc)), pa.array(score)], ["slice", "bundle", "item", "place", "doc_id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", slice_size: int = SLICE, bundle_size: int = BUNDLE, stages: int = STAGES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0, ties to smaller ids (null ids last).

    Terms are runs of ASCII letters and digits and characters beyond ASCII in whole texts, A-Z lower-cased; null texts have none. Documents that repeat, ids
    included, count each for itself, and so do items. Items or documents without terms find nothing and are not found. Empty tables: empty result.
    """
    spark = docs.sparkSession
    asked_rows = items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bundles = max(1, -(-asked_rows.count() // bundle_size))
    asked = durable(asked_rows.repartition(bundles).mapInArrow(_asked, "bundle int, item int, item_id long, term binary, q long"))
    uses = asked.filter("term is not null")
    wanted = spark.sparkContext.broadcast(KeyFilter.build(uses.select(F.xxhash64("term").alias("key")).distinct(), "key"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    indexed = durable(source.mapInArrow(lambda b: _index(b, wanted.value, slice_size), "slice long, term binary, docs binary, tfs binary, ids array<long>, lens array<long>"))
    slices, postings = indexed.filter("term is null").select("slice", "ids", "lens"), indexed.filter("term is not null").select("slice", "term", "docs", "tfs")
    total = slices.agg(F.sum(F.size(F.filter("lens", lambda n: n > 0))).alias("n"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("l")).first()
    n, length = total["n"] or 0, total["l"] or 0
    # Weights, owners, and what an owner can add to an item at most.
    seen = postings.groupBy("term").agg((F.sum(F.length("docs")) / 2).cast("long").alias("df"))
    w = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double")))
    owner = F.lit(stages - 1) - F.least(F.lit(stages - 1), F.floor(F.col("w") / BAND))
    weighed = durable(uses.join(seen, "term").withColumn("w", w.cast("long")).withColumn("stage", owner.cast("int")))
    caps = weighed.groupBy("bundle", "item", "stage").agg(F.sum(F.col("q") * F.col("w") * MOST).alias("cap")).groupBy("bundle").agg(F.collect_list(F.struct("item", "stage", "cap")).alias("caps"))
    sizes = asked.groupBy("bundle").agg((F.max("item") + 1).alias("n_items"))
    about = durable(sizes.join(caps, "bundle"))
    lists = weighed.groupBy("term", "bundle", "stage", "w").agg(F.collect_list(F.struct("item", "q")).alias("asks"))
    owned = durable(postings.join(lists, "term").select("slice", "bundle", "stage", "w", "docs", "tfs", "asks"))
    # Every bundle of the stated queries meets every slice.
    every = slices.mapInArrow(lambda b: _lengths(b, n, length), "slice long, ids array<long>, m binary").withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    empty = F.lit(b"")
    moving = every.join(about, "bundle").select("slice", "bundle", "n_items", "caps", "ids", "m", empty.alias("at"), empty.alias("score"))
    schema = "slice long, bundle int, n_items int, caps array<struct<item:int,stage:int,cap:long>>, ids array<long>, m binary, at binary, score binary"
    for stage in range(stages):
        pair = moving.groupBy("slice", "bundle").cogroup(owned.filter(F.col("stage") == stage).select("slice", "bundle", "w", "docs", "tfs", "asks").groupBy("slice", "bundle"))
        if stage + 1 < stages:
            moving = pair.applyInArrow(_owner(stage, k), schema)
        else:
            best = pair.applyInArrow(_last(k), "slice long, bundle int, item int, place int, doc_id long, score long")
    order = W.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "slice", "place")
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.filter("term is null").select("bundle", "item", "item_id")
    return top.join(names, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")
