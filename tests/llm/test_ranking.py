import math
import re
from collections import Counter

import pytest

from memspark.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """docs, items: lists of (id, text). (item_id, rank, doc_id, score) of each item's best k."""
    counts = [Counter(words(t)) for _, t in docs]
    n, total = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), count in zip(docs, counts, strict=True):
            m = 100 - 75 + (75 * sum(count.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * ((1000000000 * count[t]) // (1000 * count[t] + 8 * m)) for t in words(text) if count[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(scored[:k], 1)]
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=lambda r: (str(r[0]), r[1]))


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


@pytest.mark.parametrize(("slice_size", "bundle_size", "stages", "k"), [(4096, 256, 4, 10), (7, 3, 3, 4), (50, 16, 1, 1), (33, 1000, 6, 300)])
def test_ranks_and_scores_equal_a_full_scan(spark, sf, documents, slice_size, bundle_size, stages, k):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = found(ranking.rank(documents, items, k=k, slice_size=slice_size, bundle_size=bundle_size, stages=stages))
    assert got == brute(pairs(documents, "doc_id"), pairs(items, "item_id"), k)


def test_ties_repeats_and_frequent_terms(spark):
    docs = [(i % 37, "same words in many texts " * (1 + i % 3)) for i in range(150)] + [(None, "same words in many texts"), (None, None), (-5, "rare Words"), (900, "RARE")]
    items = [(1, "same words"), (2, "words words RARE rare"), (3, "nothing known"), (4, None), (None, "texts"), (6, ""), (7, "K Ää same")]
    frame = lambda rows, key: spark.createDataFrame([(*r, "x", 1, 2) for r in rows], f"{key} long, text string, slice string, term int, item int")
    for size in (4096, 10):
        assert found(ranking.rank(frame(docs, "doc_id"), frame(items, "item_id"), slice_size=size)) == brute(docs, items)
    assert ranking.rank(frame([], "doc_id"), frame(items, "item_id")).collect() == []
    assert ranking.rank(frame(docs, "doc_id"), frame([], "item_id")).collect() == []
    assert ranking.rank(frame([(1, None)], "doc_id"), frame(items, "item_id")).collect() == []


def test_odd_documents(spark, odd_docs):
    items = [(1, "The QUICK brown fox"), (2, "long"), (3, "漢字 \U0001f600\U0001f600 İstanbul"), (4, "version 3 gnu"), (5, "ñandú x y")]
    assert found(ranking.rank(odd_docs, spark.createDataFrame(items, "item_id long, text string"))) == brute(pairs(odd_docs, "doc_id"), items)


def test_terms_of_long_texts_are_whole():
    text = "Äb" * 700_000 + " tail Tail " + "x1 " * 900_000
    assert {t.decode(): n for t, n in ranking.terms(text.encode()).items()} == Counter(words(text))


def test_entries_that_are_left_behind_do_not_matter(spark):
    # One document leads after the first stage by more than the frequent terms can add: only then are entries dropped.
    docs = [(i, "common " * (i % 5 + 1) + ("scarce " * 3 if i % 40 == 0 else "")) for i in range(400)]
    items = [(1, "scarce common"), (2, "common"), (3, "scarce scarce scarce common")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    for k in (1, 3, 10):
        assert found(ranking.rank(frame(docs, "doc_id"), frame(items, "item_id"), k=k, slice_size=100)) == brute(docs, items, k)
