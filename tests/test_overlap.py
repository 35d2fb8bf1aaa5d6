"""Overlap joins on token sets: the grid of token blocks against all pairs, and how a token that every text holds is dealt."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memspark.operators import duplicates, overlap


def brute(rows, percent=85):
    """{id: number of other rows with an equal or overlapping set in the scope}; sets without tokens have none."""
    out = {}
    for i, scope, a in rows:
        n = 0
        for j, other, b in rows:
            if i != j and scope == other and a and b:
                n += 100 * len(a & b) >= percent * min(len(a), len(b))
        out[i] = n
    return out


def texts(seed, n, frequent):
    """Random sets, near copies of them, tiny sets of frequent tokens; every set holds the frequent token if asked."""
    rng = random.Random(seed)
    sets = []
    for i in range(n):
        if sets and i % 3 == 0:
            base = set(rng.choice(sets))
            for x in rng.sample(sorted(base), max(1, len(base) // 12)):
                base.discard(x)
            sets.append(base or {"the"})
        elif i % 7 == 1:
            sets.append(set(rng.sample(["the", "of", "and"], rng.randint(1, 3))))
        else:
            sets.append({f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.choice([3, 9, 30, 90]))})
    return [(i, f"s{i % 2}", (s | {"the"} if frequent else s) if i % 41 else set()) for i, s in enumerate(sets)]


def frame(spark, rows):
    return spark.createDataFrame([(i, s, sorted(x)) for i, s, x in rows], "id long, scope string, words array<string>")


@pytest.mark.parametrize("frequent", [False, True])
def test_links_equal_all_pairs(spark, monkeypatch, frequent):
    for name, n in (("CELL", 16), ("SETS", 32), ("AGAINST", 20), ("LIGHT", 50)):
        monkeypatch.setattr(overlap, name, n)
    rows = texts(5, 330, frequent)
    got = duplicates.overlap_report(frame(spark, rows), ["scope"], F.col("words"))
    assert {r["id"]: r["n_links"] for r in got.collect()} == brute(rows)


def test_a_token_of_all_sets_is_met_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(overlap, "CELL", 64)
    rows = [(i, "s", {"the", *(f"x{i}-{j}" for j in range(6))}) for i in range(900)] + [(1000 + i, "s", {"the"} if i == 0 else {"the", "of", f"y{i}"}) for i in range(64)]
    sets = frame(spark, rows).select("scope", "id", F.col("words").alias("tokens"), F.size("words").alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("m", "last", "first")])
    seen = []
    plain = overlap.by_key

    def spied(left, table, keys, weight):
        out = plain(left, table, keys, weight)
        if keys == ["t"]:
            seen.append(out.selectExpr("t", "rows", "columns"))
        return out

    monkeypatch.setattr(overlap, "by_key", spied)
    ranked = overlap.ranked_sets(sets, ["scope"], 85)
    proposed, _ = overlap._proposed(ranked)
    cells = seen[0].orderBy(F.desc("columns")).first()
    assert cells["columns"] == 16  # 964 sets in blocks of 64
    assert proposed.count() > 0
    links = {r["id"]: r["n_links"] for r in duplicates.overlap_report(frame(spark, rows), ["scope"], F.col("words")).collect()}
    assert links[1000] == len(rows) - 1
    assert links == brute(rows)


def test_pairs_name_the_smaller_set_first(spark):
    rows = [(1, "s", {"a", "b", "c"}), (2, "s", {"a", "b", "c", "d"}), (3, "s", {"b", "c", "a"}), (4, "s", {"x", "y", "z", "w", "v", "u", "t"}), (5, "s", {"x", "y", "z", "w", "v", "u", "q"}), (6, "r", {"a", "b", "c"})]
    got = {(r["a"], r["b"], r["n_shared"], r["n_a"], r["n_b"]) for r in duplicates.overlap_pairs(frame(spark, rows), ["scope"], F.col("words")).collect()}
    assert got == {(1, 2, 3, 3, 4), (4, 5, 6, 7, 7)}


def test_heavy_keys_are_met_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(overlap, "LIGHT", 10)
    rows = spark.createDataFrame([("a" if i % 2 else f"k{i}", i) for i in range(60)], "k string, v int")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = overlap.by_key(rows, table, ["k"], "n")
    assert sorted((r["v"], r["n"]) for r in got.collect()) == sorted((i, 30 if i % 2 else 1) for i in range(60))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def memory_rows(seed, n, words=30):
    rng = random.Random(seed)
    some = lambda k: rng.sample([f"t{int(rng.paretovariate(0.8)) % words}" for _ in range(40)], k)
    return [(f"m{i:04}", "c", f"x{i % 2}", rng.choice(["event", "profile"]), f"2026-01-{1 + i % 28:02} 00:00:00" if i % 17 else None, sorted({x.title() for x in some(rng.randint(0, 4))}), sorted(set(some(rng.randint(0, 6))))) for i in range(n)]


def memory_frame(spark, rows):
    flat = spark.createDataFrame(rows, "id string, chat_id string, character_id string, type string, at string, entities array<string>, keywords array<string>")
    meta = F.struct("entities", "keywords", F.lit(None).cast("string").alias("review_status"))
    fixed = {"updated_at": F.col("at").cast("timestamp"), "metadata": meta, "source": F.lit("auto"), "pinned": F.lit(False), "archived": F.lit(False)}
    return flat.withColumns(fixed)


@pytest.mark.parametrize(("slices", "min_entities", "min_keywords"), [(1, 1, 2), (3, 1, 2), (4, 2, 1), (3, 0, 3), (2, 2, 0)])
def test_soft_matches_take_the_newest_of_all(spark, monkeypatch, slices, min_entities, min_keywords):
    for name, n in (("CELL", 8), ("LIGHT", 30)):
        monkeypatch.setattr(overlap, name, n)
    old, new = memory_rows(1, 240), [(f"n{r[0]}", *r[1:]) for r in memory_rows(2, 120)]
    policy = duplicates.MergePolicy(newest=None, slices=slices, min_entities=min_entities, min_keywords=min_keywords)
    got = {r["candidate_id"]: (r["existing_id"], r["n_entities"], r["n_keywords"]) for r in duplicates.soft_matches(memory_frame(spark, new), memory_frame(spark, old), policy).collect()}
    expected = {}
    for c in new:
        hits = []
        for o in old:
            shared = len(set(c[5]) & set(o[5])), len(set(c[6]) & set(o[6]))
            if c[2:4] == o[2:4] and shared[0] >= min_entities and shared[1] >= min_keywords:
                hits.append((o[4] or "", o[0], *shared))
        if hits:
            expected[c[0]] = max(hits)[1:]
    assert got == expected
    assert len(got) > 20


@pytest.mark.parametrize(("hot", "min_shared"), [(0.01, 2), (0.2, 2), (2.0, 2), (0.1, 1), (0.1, 3)])
def test_shadowed_episodes_with_hot_terms(spark, hot, min_shared):
    rows = memory_rows(3, 200)
    cards = memory_frame(spark, rows).withColumns({"pos": F.substring("id", 2, 4).cast("int"), "layer": F.when(F.substring("id", 2, 4).cast("int") % 3 == 0, F.lit("stable")).otherwise(F.lit("episodic")), "activity": F.lit("low_use")})
    got = {r["id"]: r["related_id"] for r in duplicates.shadowed_by_stable(cards, min_shared, hot=hot).collect()}
    signals = {r[0]: {x.lower() for x in (*r[5], *r[6])} for r in rows}
    expected = {}
    for i, r in enumerate(rows):
        if i % 3:
            first = next((s[0] for j, s in enumerate(rows) if j % 3 == 0 and s[2] == r[2] and len(signals[r[0]] & signals[s[0]]) >= min_shared), None)
            if first:
                expected[r[0]] = first
    assert got == expected


def test_tokens_of_one_set_are_not_posted(spark):
    """Words that no other text has are in no posting; they still count where the overlap is asked for."""
    shared = [f"w{i}" for i in range(17)]
    texts = {1: shared + ["a1", "a2", "a3"], 2: shared + ["b1", "b2", "b3", "b4"], 3: shared + ["c1", "c2", "c3"] + ["c4"] * 2 + ["c5"], 4: ["alone", "words"], 5: shared[:9]}
    rows = spark.createDataFrame([("x", i, " ".join(w)) for i, w in texts.items()], "lang string, id long, text string")
    tokens = F.array_distinct(F.split("text", " "))
    sets = duplicates._sets(duplicates._classes(rows, ["lang"], tokens), ["lang"], 85)
    assert {r["id"]: len(r["ts"]) for r in sets.collect()} == {1: 17, 2: 17, 3: 17, 5: 9}
    got = {r["id"]: r["n_links"] for r in duplicates.overlap_report(rows, ["lang"], tokens, 85).collect()}
    assert got == {1: 3, 2: 2, 3: 2, 4: 0, 5: 3}


def told_memories(seed, sizes):
    """Rows (id, chat, text, pos, pinned, status, layer, entities, keywords) of chats of these sizes: near copies, equal texts, texts without words, null texts."""
    rng, rows = random.Random(seed), []
    for chat, n in enumerate(sizes):
        texts = []
        for pos in range(1, n + 1):
            base = rng.choice(texts) if texts and rng.random() < 0.5 else " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.choice([1, 4, 12])))
            text = rng.choice([base, base, base + " more", base.replace(" ", ", ", 1), "?", "??", "", None])
            texts.append(base)
            some = lambda k: rng.sample([f"T{i}" for i in range(9)], rng.randint(0, k))
            rows.append((f"{chat}-{pos}", f"c{chat}", text, pos, rng.random() < 0.1, rng.choice([None, None, "reviewed_keep", "other"]), rng.choice(["stable", "episodic"]), some(3), some(4)))
    return rows


def told_frame(spark, rows):
    flat = spark.createDataFrame(rows, "id string, chat_id string, content string, pos int, pinned boolean, review_status string, layer string, entities array<string>, keywords array<string>")
    return flat.withColumns({"character_id": F.lit("x"), "activity": F.lit("low_use"), "metadata": F.struct("entities", "keywords", "review_status")}).drop("entities", "keywords", "review_status")


def told_links(rows):
    """Pairs of near duplicates, the first in the list first, and the first stable memory of shadowed episodes."""
    norm = lambda x: re.sub(r"[^\w\s]", " ", " ".join(x.lower().split()))
    near, shadowed = set(), {}
    for a in rows:
        for b in rows:
            if a[1] != b[1]:
                continue
            if a[3] < b[3] and not (a[4] or b[4]) and a[5] != "reviewed_keep" and a[2] is not None and b[2] is not None:
                x, y = set(norm(a[2]).split()), set(norm(b[2]).split())
                if norm(a[2]) == norm(b[2]) or (x and y and 100 * len(x & y) >= 85 * min(len(x), len(y))):
                    near.add((a[0], b[0]))
            if a[6] == "episodic" and not a[4] and a[5] != "reviewed_keep" and b[6] == "stable" and len({*a[7], *a[8]} & {*b[7], *b[8]}) >= 2:
                shadowed.setdefault(a[0], b[0])
    return near, shadowed


@pytest.mark.parametrize("few", [0, 6, 1000])
def test_pairs_of_small_scopes_are_those_of_large_ones(spark, monkeypatch, few):
    monkeypatch.setattr(duplicates, "FEW", few)
    rows = told_memories(4, [1, 2, 6, 7, 25, 60])
    memories = told_frame(spark, rows)
    near, shadowed = told_links(rows)
    assert {(r["a"], r["b"]) for r in duplicates.near_duplicate_pairs(memories).collect()} == near
    place = {r[0]: r[3] for r in rows}
    partners = {}
    for a, b in near:
        partners.setdefault(a, []).append(b)
        partners.setdefault(b, []).append(a)
    # The first that stands before it in the list, else the last.
    expected = {i: min(before, key=place.get) if (before := [x for x in all_ if place[x] < place[i]]) else max(all_, key=place.get) for i, all_ in partners.items()}
    got = duplicates.near_duplicate_candidates(memories).collect()
    assert {r["id"]: r["related_id"] for r in got} == expected
    assert len(got) == len(expected) > 30
    assert {r["id"]: r["related_id"] for r in duplicates.shadowed_by_stable(memories).collect()} == shadowed


def test_small_scopes_need_no_tables_of_tokens_or_terms(spark, monkeypatch):
    rows = told_memories(8, [8] * 12)
    memories = told_frame(spark, rows)
    near, shadowed = told_links(rows)

    def refused(*args):
        raise AssertionError("tokens of a small scope are made rows")

    monkeypatch.setattr(duplicates, "ranked_sets", refused)
    written = []
    monkeypatch.setattr(duplicates, "durable", lambda df: written.append(1) or df.checkpoint())
    assert {(r["a"], r["b"]) for r in duplicates.near_duplicate_pairs(memories).collect()} == near
    assert {r["id"] for r in duplicates.near_duplicate_candidates(memories).collect()} == {x for p in near for x in p}
    assert {r["id"]: r["related_id"] for r in duplicates.shadowed_by_stable(memories).collect()} == shadowed
    assert len(written) <= 4


def test_a_set_travels_to_few_blocks(spark, monkeypatch):
    """What a set is sent to doesn't grow with the number of sets as long as tasks can hold more of them."""
    monkeypatch.setattr(overlap, "SETS", 16)
    common = [f"c{j}" for j in range(10)]
    rows = [(i, "s", {*common, *(f"x{i // 2}-{j}" for j in range(20 + i % 3))}) for i in range(400)] + [(1000 + i, "s", set(common[i % 4 : i % 4 + 5])) for i in range(40)]
    sets = frame(spark, rows).select("scope", "id", F.col("words").alias("tokens"), F.size("words").alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("m", "last", "first")])
    most = overlap._proposed(overlap.ranked_sets(sets, ["scope"], 85))[0].groupBy("k").agg(F.count("*").alias("blocks"), F.sum(F.size("others")).alias("others")).orderBy(F.desc("others")).first()
    assert most["others"] >= 400 and most["blocks"] <= 14
    got = duplicates.overlap_report(frame(spark, rows), ["scope"], F.col("words"))
    assert {r["id"]: r["n_links"] for r in got.collect()} == brute(rows)


def test_many_partners_are_looked_up_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PIECE", 50)
    rows = texts(8, 150, True)
    block = overlap._Block(pa.table({"k": range(len(rows)), "ts": [sorted(hash_of(x) for x in s | {"the"}) for _, _, s in rows]}))
    left = pa.table({"ts": [[hash_of("the"), hash_of("of")], []], "others": [list(range(len(rows)))[::-1], [3]], "needed": [1, 0]})
    found = {row: (at.tolist(), shared.tolist()) for row, at, shared in block.asking(left)}
    assert found[0] == (list(range(len(rows)))[::-1], [1 + ("of" in s) for _, _, s in rows][::-1]) and found[1] == ([3], [0])


def hash_of(word):
    return sum(ord(c) * 131**i for i, c in enumerate(word)) % 2**40
