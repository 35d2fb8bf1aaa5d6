import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from memspark.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ended = ",".join(map(str, sorted(c for c in convs if len(full[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out)


def got(df):
    assert df.columns == list(COLUMNS)
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int, block int, head string")


@pytest.mark.parametrize("block", [8, 3, 1])
def test_nodes_equal_all_prefixes(spark, sf, block):
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in conversations.collect()]
    assert got(trie.prefix_trie(conversations, block)) == brute(rows)


@pytest.mark.parametrize("block", [8, 2])
def test_shared_prefixes_long_and_repeated_conversations(spark, block):
    rng = random.Random(4)
    rows = [(c, i, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "Ä"])) for c in [*range(0, 60), -1, -3, -5, -11] for i in range(rng.choice([1, 2, 3, 9, 12]))]
    rows += [(c, i, "user", "same") for c in range(100, 140) for i in range(11)]
    rows += [(c, i, "user", f"long {i if i < 30 else c % 2 + i}") for c in (200, 201, 205, 210) for i in range(45)]
    assert got(trie.prefix_trie(frame(spark, rows), block)) == brute(rows)


def test_odd_conversations(spark):
    rows = [(0, None, None, None), (0, None, "user", "x"), (0, 3, "user", ""), (0, 3, "user", ""), (1, 0, "", "x"), (2, 5, "user", "y" * 300_000), (3, 1, "a", "b"), (None, 0, "user", "lost"), (8, 1, "a", "b"), (9, 1, "ab", ""), (9, 2, "a", "b"), (2**62, 0, "u", "t"), (2**62, -4, "u", "s")]
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)
    assert trie.prefix_trie(frame(spark, [])).collect() == []
    assert got(trie.prefix_trie(frame(spark, [(3, 0, "u", "t")]))) == brute([(3, 0, "u", "t")])


def test_a_conversation_over_many_parts(spark):
    rows = [(7, i, "user", str(i % 3)) for i in range(400)] + [(c, 0, "user", "0") for c in range(40)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, sizes = trie.positioned(frame(spark, rows))
        assert {r["conv"]: r["n"] for r in sizes.collect()}[7] == 401
        assert sorted(r["pos"] for r in placed.filter("conv = 7").collect()) == list(range(1, 402))
        assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
