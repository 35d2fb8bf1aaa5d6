"""Toxicity by a classifier chain.

The categories are predicted one after another; each linear model sees the words and the probabilities of the
categories before it. In training those probabilities come from models that were fitted on other folds.
Only one human label exists, so the categories before it are labelled weakly: human-toxic and holding a seed word.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many labelled documents, those with the smallest hashes, are used for fitting.
SAMPLE = 12_000
HASH_BITS = 20
#: Words per model, chosen by association with its label within the training rows.
WORDS = 512
FOLDS = 5
#: Hashes that a task remembers; others are computed anew.
CACHED_WORDS = 100_000
L2 = 1.0
#: Seed words of the weakly labelled categories, in the chain's order; a parameter.
SEEDS: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "stupid", "moron", "dumb", "fool", "clown", "loser", "imbecile"),
    "contempt": ("worthless", "pathetic", "useless", "disgusting", "hopeless", "despicable"),
    "dehumanising": ("trash", "scum", "vermin", "garbage", "filth", "parasite"),
}
_TOKEN = re.compile(r"[^\W\d_]+")


def word_hashes(text: str | None, cache: dict[str, int]) -> np.ndarray:
    """Distinct hashes of the text's lower-cased words, in order."""
    out = set()
    for w in set(_TOKEN.findall((text or "").lower())):
        h = cache.get(w)
        if h is None:
            h = xxhash.xxh32_intdigest(w) >> (32 - HASH_BITS)
            if len(cache) < CACHED_WORDS:
                cache[w] = h
        out.add(h)
    return np.array(sorted(out), dtype=np.int32)


@dataclass(frozen=True)
class Link:
    """One model: weights of word hashes, of the probabilities before it, and a constant."""

    name: str
    words: dict[int, float]
    before: tuple[float, ...]
    constant: float


@dataclass(frozen=True)
class Chain:
    links: tuple[Link, ...]
    threshold: float

    @cached_property
    def known(self) -> frozenset[int]:
        """The words that any link weighs; all others are left out at once."""
        return frozenset(h for link in self.links for h in link.words)

    def predict(self, hashes: np.ndarray) -> list[float]:
        out: list[float] = []
        present = sorted(self.known.intersection(hashes.tolist()))
        for link in self.links:
            get = link.words.get
            z = link.constant + sum(get(h, 0.0) for h in present) + sum(w * p for w, p in zip(link.before, out, strict=True))
            out.append(float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))))
        return out


#: Training rows that must hold a word for it to be chosen.
LEAST_ROWS = 5


#: Entries that are counted or filtered at a time.
SLICE = 1 << 18


def _choose(held: np.ndarray, hit: np.ndarray, n: int, positive: int) -> np.ndarray:
    """The words most associated with a label: held, hit: training rows with each word, and those of them with the label, of n and `positive`."""
    if positive in (0, n):
        return np.zeros(0, dtype=np.int64)
    due = held * positive / n
    score = np.where(held >= LEAST_ROWS, (hit - due) ** 2 / np.maximum(due * (1 - positive / n), 1e-9), 0.0)
    chosen = np.sort(np.argsort(-score, kind="stable")[:WORDS])
    return chosen[score[chosen] > 6.6]


def _fit(docs: np.ndarray, words: np.ndarray, n_words: int, chosen: np.ndarray, before: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression on the given rows. docs, words: a row and a word's number per entry. Returns chosen words, weights, weights of before, constant."""
    n, positive = len(rows), int(y[rows].sum())
    if positive == 0 or positive == n:
        rate = (positive + 0.5) / (n + 1)
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), float(np.log(rate / (1 - rate)))
    column, place = np.full(n_words, -1), np.full(len(y), -1)
    column[chosen], place[rows] = np.arange(len(chosen)), np.arange(n)
    i, j = place[docs], column[words]
    use = (i >= 0) & (j >= 0)
    i, j = i[use], j[use]
    x, t = before[rows], y[rows]
    k, m = len(chosen), before.shape[1]
    beta, velocity = np.zeros(k + m + 1), np.zeros(k + m + 1)
    beta[-1] = np.log(positive / (n - positive))
    # Accelerated gradient steps, scaled by a bound of each column's curvature.
    scale = 0.25 * np.concatenate((np.bincount(j, minlength=k) * 4.0, (x**2).sum(0) * 4 + 1, [n])) + L2
    for step in range(300):
        ahead = beta + step / (step + 3) * velocity
        z = np.bincount(i, weights=ahead[j], minlength=n) + x @ ahead[k : k + m] + ahead[-1]
        r = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - t
        gradient = np.concatenate((np.bincount(j, weights=r[i], minlength=k), x.T @ r, [r.sum()]))
        gradient[:-1] += L2 * ahead[:-1]
        new = ahead - gradient / scale
        velocity, beta = new - beta, new
    return chosen, beta[:k], beta[k : k + m], float(beta[-1])


def _score(docs: np.ndarray, words: np.ndarray, n_words: int, before: np.ndarray, model: tuple, n: int) -> np.ndarray:
    chosen, w, b, constant = model
    weight = np.zeros(n_words)
    weight[chosen] = w
    z = np.bincount(docs, weights=weight[words], minlength=n) + before @ b + constant
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_arrays(docs: np.ndarray, words: np.ndarray, labels: dict[str, np.ndarray]) -> tuple[Chain, np.ndarray]:
    """The chain for labels in their order, and the last label's out-of-fold probabilities. docs, words: a row and a word hash per entry."""
    n, slices = len(next(iter(labels.values()))), range(0, len(docs), SLICE)
    fold, folds = np.arange(n) % FOLDS, min(FOLDS, n)
    # Words of too few rows can't be chosen in any fold; the others are numbered.
    counts = np.zeros(int(words.max(initial=0)) + 1, dtype=np.int64)
    for at in slices:
        counts += np.bincount(words[at : at + SLICE], minlength=len(counts))
    often = np.flatnonzero(counts >= LEAST_ROWS)
    number = np.full(len(counts), -1, dtype=np.int32)
    number[often] = np.arange(len(often), dtype=np.int32)
    # Rows with each word by fold, of all rows and of each label's: every fit's choice of words follows from these.
    flags = {"": np.ones(n), **{name: y.astype(np.float64) for name, y in labels.items()}}
    held = {name: np.zeros((FOLDS, len(often))) for name in flags}
    for at in slices:
        d, w = docs[at : at + SLICE], number[words[at : at + SLICE]]
        d, w = d[w >= 0], w[w >= 0]
        cell = fold[d] * len(often) + w
        for name, flag in flags.items():
            held[name] += np.bincount(cell, weights=flag[d], minlength=held[name].size).reshape(held[name].shape)
    chosen = {}
    for name, y in labels.items():
        for f in (*range(folds), FOLDS):  # the last one: all rows
            inside = [g for g in range(FOLDS) if g != f]
            rows = fold != f
            chosen[name, f] = _choose(held[""][inside].sum(0), held[name][inside].sum(0), int(rows.sum()), int(y[rows].sum()))
    # Only entries of chosen words stay, renumbered; all others weigh nothing.
    some = np.unique(np.concatenate(list(chosen.values()))) if chosen else np.zeros(0, np.int64)
    place = np.full(len(often), -1)
    place[some] = np.arange(len(some))
    final = np.full(len(counts), -1, dtype=np.int32)
    final[often] = place
    kept = [np.flatnonzero(final[words[at : at + SLICE]] >= 0) + at for at in slices]
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    docs, words, n_words = docs[kept].astype(np.int64), final[words[kept]].astype(np.int64), len(some)

    before, links, own = np.zeros((n, 0)), [], np.zeros(n)
    for name, y in labels.items():
        y, own = y.astype(np.float64), np.zeros(n)
        for f in range(folds):
            if n > 1:
                model = _fit(docs, words, n_words, place[chosen[name, f]], before, y, np.flatnonzero(fold != f))
            else:
                model = (np.zeros(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), -30.0)
            own[fold == f] = _score(docs, words, n_words, before, model, n)[fold == f]
        best, w, b, constant = _fit(docs, words, n_words, place[chosen[name, FOLDS]], before, y, np.arange(n))
        links.append(Link(name, dict(zip(often[some[best]].tolist(), w.tolist(), strict=True)), tuple(b.tolist()), constant))
        before = np.column_stack((before, own))
    return Chain(tuple(links), best_threshold(own, y)), own


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability at which F1 is largest, midway to the next lower one; above 1 if nothing is labelled toxic."""
    if not y.sum():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    at = int(f1.argmax())
    return float((p[order[at]] + p[order[min(at + 1, len(p) - 1)]]) / 2)


def fit(docs: DataFrame, labels: DataFrame, seeds: dict[str, tuple[str, ...]] | None = None, sample: int = SAMPLE) -> Chain | None:
    """A chain fitted on at most `sample` labelled documents; None without any. Null labels are left out; a document with several is toxic if one says so."""
    seeds = SEEDS if seeds is None else seeds
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            hashes = [word_hashes(t, cache) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(hashes, pa.list_(pa.int32()))], ["doc_id", "toxic", "words"])

    # Of rows that share an id the one with the smallest list of words counts, whatever the order of tasks.
    hashed = rows.mapInArrow(run, "doc_id long, toxic int, words array<int>").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("words").alias("words"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if some := [b for b in batches if b.num_rows]:
            yield pa.record_batch([pa.array([pickle.dumps(fit_table(pa.Table.from_batches(some), seeds))], pa.binary())], ["chain"])

    # The sample is bounded, so one task holds it; the driver gets the chain alone.
    got = hashed.coalesce(1).mapInArrow(learn, "chain binary").toArrow()
    return pickle.loads(got.column("chain")[0].as_py()) if got.num_rows else None


def fit_table(got: pa.Table, seeds: dict[str, tuple[str, ...]]) -> Chain:
    """The chain fitted on the rows (doc_id, toxic, words: hashes) of a sample, whatever their order."""
    got = got.sort_by("doc_id")
    lists = got.column("words").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    words = lists.flatten().to_numpy(zero_copy_only=False)
    toxic = got.column("toxic").to_numpy() > 0
    rng = np.random.default_rng(7).permutation(got.num_rows).astype(np.int32)  # folds don't follow the ids
    docs_at, toxic = np.repeat(rng, lists.value_lengths().to_numpy(zero_copy_only=False)), toxic[np.argsort(rng)]
    wanted = {}
    for name, seed in seeds.items():
        has = np.zeros(got.num_rows, dtype=bool)
        for h in word_hashes(" ".join(seed), {}):
            has[docs_at[words == h]] = True
        wanted[name] = has & toxic
    chain, _ = fit_arrays(docs_at, words, wanted | {"toxic": toxic})
    return chain


def score(docs: DataFrame, chain: Chain | None, names: list[str]) -> DataFrame:
    """docs with toxicity struct<a double per category of names, toxic boolean>. Null and empty texts are scored as texts without words; without a chain nothing is toxic."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(chain)
    kind = pa.struct([*((f"p_{n}", pa.float64()) for n in names), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        chain_ = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch, out = whole.slice(at, 1024), []
                for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                    p = chain_.predict(word_hashes(text, cache)) if chain_ else [0.0] * len(names)
                    out.append({**{f"p_{n}": x for n, x in zip(names, p, strict=True)}, "toxic": bool(chain_ and p[-1] >= chain_.threshold)})
                yield pa.record_batch([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "toxicity"])

    docs = docs.drop("toxicity")
    inner = [*(T.StructField(f"p_{n}", T.DoubleType()) for n in names), T.StructField("toxic", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.StructType(inner))])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, seeds: dict[str, tuple[str, ...]] | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs with the column toxicity, by a chain fitted on its labelled rows. Every row is returned once; an empty table gives an empty result."""
    seeds = SEEDS if seeds is None else seeds
    return score(docs, fit(docs, labels, seeds, sample), [*seeds, "toxic"])


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, a probability per category, toxic for every row."""
    got = classify(docs.select("doc_id", "text"), labels)
    return got.select("doc_id", *[F.round(f"toxicity.p_{n}", 6).alias(f"p_{n}") for n in [*SEEDS, "toxic"]], "toxicity.toxic")
