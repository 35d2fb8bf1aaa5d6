import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from memspark.llm import chat, fingerprints, licenses, mixing, sharding


def rows(df):
    return [r.asDict() for r in df.collect()]


# Fingerprints


@pytest.mark.parametrize("which", ["odd_docs", "documents"])
def test_edited_texts_and_equal_fingerprints(which, request):
    docs = request.getfixturevalue(which)
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    texts.sort(key=lambda x: -x[0])
    got = rows(fingerprints.edited_fingerprints(docs))
    assert len(got) == len(texts)
    expected = Counter()
    for k, (i, t) in enumerate(texts):
        third, after = len(t) // 3, texts[(k + 1) % len(texts)][1]
        expected[i, len(t), hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected
    by_text, of = dict(texts), {r["doc_id"]: r["fingerprint"] for r in got}
    same = defaultdict(set)
    for i, f in of.items():
        same[by_text[i]].add(f)
    assert all(len(x) == 1 for x in same.values())
    distance = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    after = {i: texts[(k + 1) % len(texts)][0] for k, (i, _) in enumerate(texts)}
    for r in got:
        assert r["near_edited"] == 1 - distance(r["fingerprint"], r["edited_fingerprint"]) / 128
        if sum(x["doc_id"] == r["doc_id"] for x in got) == 1:
            assert r["near_next"] == 1 - distance(r["fingerprint"], of[after[r["doc_id"]]]) / 128
        near = sum(distance(r["fingerprint"], x["fingerprint"]) <= 3 for x in got) - 1
        assert r["n_near"] == (near if r["doc_id"] % 100 == 0 else None)


def test_edits_stay_nearer_than_other_documents(documents):
    got = rows(fingerprints.edited_fingerprints(documents).filter("n_chars > 500"))
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.97 * len(got)


def test_block_tables_find_every_pair_within_the_radius(spark):
    base = 0x0123456789ABCDEF
    flips = [c for n in range(5) for c in list(combinations(range(0, 128, 9), n))[:40]]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = []
    for c in flips:
        hi, lo = base, base
        for b in c:
            hi, lo = (hi ^ 1 << b - 64, lo) if b >= 64 else (hi, lo ^ 1 << b)
        prints.append((signed(hi), signed(lo)))
    df = spark.createDataFrame(prints, "hi long, lo long")
    got = {(r["hi"], r["lo"]): r["n_near"] for r in fingerprints.search(df, df).collect()}
    wide = lambda p: (p[0] & (1 << 64) - 1) << 64 | p[1] & (1 << 64) - 1
    assert got == {p: sum((wide(p) ^ wide(q)).bit_count() <= 3 for q in prints) for p in prints}


def test_wide_search_finds_every_pair_within_its_radius(spark):
    rng = random.Random(3)
    wide = []
    for n in [0, 0, 1, 3, 4, *range(8, 16)] * 12:
        x = 0x0123456789ABCDEFFEDCBA9876543210
        for b in rng.sample(range(128), n):
            x ^= 1 << b
        wide.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = [(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in wide]
    df = spark.createDataFrame(prints, "hi long, lo long")
    got = {(r["hi"], r["lo"]): r["n_near"] for r in fingerprints.search_wide(df, df).collect()}
    assert got == {p: sum((x ^ y).bit_count() <= 12 for y in wide) for p, x in zip(prints, wide, strict=True)}


def test_near_copies_are_counted(spark, documents):
    words = documents.filter("n_chars > 2000").orderBy("doc_id").first()["text"].split()
    copies = [(i, " ".join([*words[: 20 * i], f"word{i}", *words[20 * i + 1 :]]), "en", "s", 1) for i in range(1, 9)]
    docs = documents.filter("doc_id <> 100").unionByName(spark.createDataFrame([(100, " ".join(words), "en", "s", 1), *((1_000_000 + i, *r) for i, *r in copies)], documents.schema))
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    distance = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for r in got.values():
        near = sum(distance(r["fingerprint"], x["fingerprint"]) <= 12 for x in got.values()) - 1
        assert r["n_copies"] == (near if r["doc_id"] % 100 == 0 else None)
    assert got[100]["n_copies"] >= 8


def test_fingerprints_of_no_documents(no_docs):
    assert fingerprints.edited_fingerprints(no_docs).count() == 0


# Chat


def brute_chat(turns):
    by = defaultdict(list)
    for c, i, role, text in turns:
        by[c].append((i, role or "", text or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        lines = "".join(f"{r}\n{t}\n" for _, r, t in ts)
        out[c] = (len(ts), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN 41]", "[/TURN]", "\\", "\\\\", "<", "[", "</", "a", "\n", "😀", "$1", "<\\s>"]


def test_chat_round_trip(spark, sf):
    odd = [(k, i, role, (CONTROL[(k * 7 + i * 3) % 18] + CONTROL[(k + i) % 18]) * (1 + i % 3)) for k in range(1, 40) for i, role in enumerate(["system", "user", "assistant", "tool", None][: 1 + k % 5])]
    odd += [(100, 0, "user", None), (100, 1, "assistant", ""), (100, 1, "assistant", ""), (101, 0, "user", "x" * 200_000), (101, 1, "assistant", "[/INST]" * 20_000)]
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    given = [(c + 1000, *r) for c, *r in given] + odd
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_digest(df).collect()}
    mark = "</s>[INST] ok [/INST]"
    assert got == brute_chat([*given, (-7, 0, "user", mark), (-7, 1, "assistant", mark)])


def test_chat_spans_and_marks(spark):
    turns = spark.createDataFrame([(1, [("system", "a<s>"), ("user", "[INST]"), ("assistant", "yes"), ("tool", "t")]), (2, [])], "conv_id long, turns array<struct<role:string,text:string>>")
    got = {r["conv_id"]: r for r in chat.format_turns(turns).collect()}
    text = got[1]["formatted"]
    assert text == "<<SYS>>a<\\s><</SYS>>[INST][\\INST][/INST]<s>yes</s>[TURN 746F6F6C]t[/TURN]"
    assert [text[s["start"] : s["start"] + s["length"]] for s in got[1]["spans"] if s["loss"]] == ["yes"]
    assert got[2]["formatted"] == "" and got[2]["spans"] == []


def test_layouts_choose_mappings(spark):
    records = [(1, '{"prompt":"p","completion":null}'), (2, '{"messages":[{"role":"user","content":"x"}]}'), (3, '{"conversations":[{"from":"gpt","value":"y"}]}'), (4, '{"other":1}'), (5, "no json"), (6, None), (7, '{"output":"o","instruction":"i","system":"s"}')]
    got = {r["conv_id"]: (r["mapping"], [tuple(t) for t in r["turns"]]) for r in chat.canonical_turns(spark.createDataFrame(records, "conv_id long, record string")).collect()}
    assert got[1] == ("prompt", [("user", "p"), ("assistant", "")]) and got[2] == ("messages", [("user", "x")]) and got[3] == ("share", [("assistant", "y")])
    assert got[7] == ("system-instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]) and got[4] == got[5] == got[6] == (None, [])


def test_layouts_have_the_fields_of_their_records(spark):
    records = ['{"messages":[{"role":"a:\\"","content":"{x},{x}"},{"role":"b","content":""},{"role":"c","content":"\\\\"}]}', '{"a":["x:","y"],"b":{"c":[{"d":1},{"e":null}]}}', '{"prompt" : "p\\n" , "completion":null}', '[{"x":"1"},{"x":"2"},{"y":"3"}]', "no json", "{}"]
    df = spark.createDataFrame([(r,) for r in records], "record string")
    got = df.select(chat.field_paths(F.col("record"), 0).alias("a"), chat.field_paths(F.col("record")).alias("b"), F.octet_length(chat.layout(F.col("record"))).alias("n")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[0]["b"] == "OBJECT<messages: ARRAY<OBJECT<content, role>>>" and got[0]["n"] < 45


def test_conversations_beyond_a_variant_keep_their_turns(spark):
    long = F.repeat(F.lit("0123456789"), 13_500_000)
    rows = spark.range(2).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 0, long).otherwise(F.lit("yes")).alias("text"))
    got = chat.canonical_turns(chat.pack_records(rows)).select("mapping", F.transform("turns", lambda t: F.struct(t["role"], F.char_length(t["text"]))).alias("turns")).first()
    assert got["mapping"] == "instruction" and [tuple(t) for t in got["turns"]] == [("user", 135_000_000), ("assistant", 3)]


def test_a_very_long_text_is_one_turn_of_the_digest(spark):
    """Longer than the JSON reader's usual limit for a string."""
    rows = spark.range(1).select(F.lit(5).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("0123456"), 3_000_000).alias("text"))
    got = {r["conv_id"]: r for r in chat.chat_digest(rows).collect()}
    text = "0123456" * 3_000_000
    assert (got[5]["n_turns"], got[5]["formatted_chars"], got[5]["loss_chars"]) == (1, 21_000_013, 0)
    assert got[5]["turns_sha256"] == hashlib.sha256(f"user\n{text}\n".encode()).hexdigest()


def test_records_without_a_mapping_fail_the_digest(spark, monkeypatch):
    monkeypatch.setattr(chat, "MAPPINGS", ())
    monkeypatch.setattr(chat.canonical_turns, "__defaults__", ("conv_id", "record", ()))
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="no mapping"):
        chat.chat_digest(rows).collect()


# Mixing


def brute_targets(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight, total, capped = {s: 1 + k % 3 for k, s in enumerate(names)}, sum(size.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            return {s: 3 * size[s] if s in capped else weight[s] * level for s in names}
        capped |= over


@pytest.mark.parametrize("which", ["odd_docs", "documents"])
def test_mix_meets_targets(which, request):
    docs = request.getfixturevalue(which)
    got, size, taken = rows(mixing.mix(docs, block_words=64)), Counter(), Counter()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r["size"] == words[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    target = brute_targets(size)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    again = rows(mixing.mix(docs.repartition(3), block_words=64))
    key = lambda r: tuple(str(r[c]) for c in sorted(r))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_spreads_sources_and_repeats_whole_blocks_first(spark):
    targets = spark.createDataFrame([(0, "a", 1000, 3000.0), (1, "b", 5000, 2500.0), (2, "c", 0, 0.0), (3, "d", 70, 35.4)], "sid long, source string, source_size long, target double")
    got = rows(mixing.schedule(targets, 64))
    for sid, source, size, target in [(0, "a", 1000, 3000), (1, "b", 5000, 2500), (3, "d", 70, 35)]:
        own = sorted((r for r in got if r["sid"] == sid), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and sum(r["words"] for r in own) == target
        blocks = -(-size // 64)
        assert all((r["epoch"], r["block"]) == divmod(r["rank"], blocks) for r in own)
    drawn = sorted((r for r in got if r["slot"] is not None), key=lambda r: r["slot"])
    half = Counter(r["sid"] for r in drawn[: len(drawn) // 2])
    assert abs(half[0] - half[1] * 48 / 40) < 5


def test_mix_of_one_id_on_half_of_the_rows(spark):
    """Rows of the null id, equal ones and others, many of them blank, meet their targets and agree between runs."""
    data = [(None, "a b c", "x")] * 3000 + [(None, "d " * (k % 7), "x") for k in range(1000)] + [(None, None, None)] * 1500 + [(k, "e f g h " * (k % 5), f"s{k % 3}") for k in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(docs.repartition(5), block_words=64)
    assert Counter(map(tuple, got.select("doc_id", "source", "size").collect())) == Counter((i, s, len((t or "").split())) for i, t, s in data)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, mixing.mix(docs.coalesce(1), block_words=64).collect()))
    size, taken = Counter(), Counter()
    for r in got.collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    target = brute_targets(size)
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)


def test_targets_and_schedule_of_many_sources(spark):
    """Nothing about the sources is gathered in one task: ranks in name order, targets and gapless blocks still hold."""
    n = 20_000
    docs = spark.range(n).select(F.concat(F.lit("host"), F.lpad(F.pmod(F.col("id") * 7919, F.lit(n)).cast("string"), 6, "0")).alias("source"), (F.pmod("id", F.lit(13)) * 10 + 1).alias("size"))
    targets = mixing.source_targets(docs)
    got = {r["source"]: r for r in targets.collect()}
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1]["sid"])] == sorted(got) and {r["sid"] for r in got.values()} == set(range(n))
    expected = brute_targets({r["source"]: r["size"] for r in docs.collect()})
    assert all(r["target"] == pytest.approx(expected[s]) for s, r in got.items())
    slots = mixing.schedule(targets, 64).groupBy("sid").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("rank").alias("ranks"))
    slots = {r["sid"]: r for r in slots.collect()}
    assert all(slots[r["sid"]]["words"] == round(r["target"]) for r in got.values() if round(r["target"]))
    assert all(r["n"] == r["ranks"] == r["last"] + 1 for r in slots.values())


def test_running_sums_of_a_frequent_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("at"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("v"))
    got = {(r["k"], r["at"]): r["before"] for r in mixing.running(df, ["at"], keys=("k",), before=F.col("v")).collect()}
    sums, expected = Counter(), {}
    for r in sorted(rows(df), key=lambda r: r["at"]):
        expected[r["k"], r["at"]] = sums[r["k"]]
        sums[r["k"]] += r["v"]
    assert got == expected


def test_mix_of_no_documents(no_docs):
    assert mixing.mix(no_docs).count() == 0


# Sharding


@pytest.mark.parametrize("which", ["odd_docs", "documents"])
def test_shards(which, request):
    docs = request.getfixturevalue(which)
    got = rows(sharding.shard_documents(docs))
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    places, load = defaultdict(list), Counter()
    for r in got:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(0 <= k < 24 and sorted(x) == list(range(len(x))) for k, x in places.items())
    if which == "documents":
        assert max(load.values()) - min(load.values()) <= max(r["size"] for r in got)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_records_keep_their_slots_and_the_query_rebalances_the_stored_map(spark, documents, tmp_path):
    before = {r["doc_id"]: r for r in rows(sharding.shard_documents(documents, path=str(tmp_path / "map")))}
    edited = documents.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))).repartition(5)
    after = {r["doc_id"]: r for r in rows(sharding.shard_documents(edited))}
    assert all(before[i]["virtual_slot"] == after[i]["virtual_slot"] for i in before)
    stored = {v: {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map"), v).collect()} for v in (1, 2)}
    assert all(stored[2][s] in (k, 24) for s, k in stored[1].items()) and 24 in stored[2].values()
    assert all((r["shard"], r["next_shard"]) == (stored[1][r["virtual_slot"]], stored[2][r["virtual_slot"]]) for r in before.values())
    moved = sum(r["size"] for r in before.values() if r["next_shard"] == 24)
    assert 0.5 < moved * 25 / sum(r["size"] for r in before.values()) < 1.5


def test_an_id_that_repeats_spreads_over_slots(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    got = rows(sharding.shard_documents(docs))
    assert len(got) == 3000 and max(Counter(r["virtual_slot"] for r in got).values()) < 12
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= 4 * 17


def test_rebalance_moves_slots_into_the_new_shard_only(spark, tmp_path):
    usage = spark.createDataFrame([(s, 100 + s * 7 % 50, 1) for s in range(256)], "virtual_slot int, bytes long, n_rows long")
    one = sharding.build_map(usage, 6, 256)
    two = sharding.rebalance(one, usage, 7)
    old, new = ({r["virtual_slot"]: r["shard"] for r in m.collect()} for m in (one, two))
    assert all(new[s] in (old[s], 6) for s in old)
    weight, load = {r["virtual_slot"]: r["bytes"] for r in usage.collect()}, Counter()
    for s, k in new.items():
        load[k] += weight[s]
    assert max(load.values()) - min(load.values()) < 400
    for m in (one, two):
        sharding.save_map(m, str(tmp_path / "map"))
    assert {r["version"] for r in spark.read.parquet(str(tmp_path / "map")).select("version").distinct().collect()} == {1, 2}


def test_rebalance_fills_several_new_shards(spark):
    usage = spark.createDataFrame([(s, 100 + s * 7 % 50, 1) for s in range(256)], "virtual_slot int, bytes long, n_rows long")
    one = sharding.build_map(usage, 6, 256)
    old, new = ({r["virtual_slot"]: r["shard"] for r in m.collect()} for m in (one, sharding.rebalance(one, usage, 9)))
    assert all(new[s] == old[s] or new[s] in (6, 7, 8) for s in old)
    load = Counter()
    for r in usage.collect():
        load[new[r["virtual_slot"]]] += r["bytes"]
    assert set(load) == set(range(9)) and max(load.values()) - min(load.values()) < 400


# Licenses


def brute_licenses(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = {p: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p in [*licenses.BASE, *[p for ps in licenses.TEMPLATES.values() for p in ps]]}
    base = [k for p in licenses.BASE for k in at[p]]
    labels = {v for p, v in licenses.BASE.items() if at[p]}
    own = {v for v, ps in licenses.TEMPLATES.items() if all(at[p] for p in ps)}
    for name, (text, keys) in licenses.TEXTS.items():
        whole = text.split()
        must = {i: w for k in keys for i, w in enumerate(whole) if any(whole[j : j + len(k.split())] == k.split() and j <= i < j + len(k.split()) for j in range(len(whole)))}
        if any(all(0 <= s + i < len(words) and words[s + i] == w for i, w in must.items()) for s in range(-len(whole), len(words))):
            own.add(name)
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own))


@pytest.mark.parametrize("which", ["odd_docs", "documents", "license_docs"])
def test_licenses(which, request, spark):
    if which == "license_docs":
        lines = ["cc by cc by cc by-nc", "general public license general public license", "by cc", "x ALL RIGHTS RESERVED all rights", "Permission is hereby granted, free of charge ... THE SOFTWARE IS PROVIDED AS IS", "permission is hereby granted free of charge", "The Apache License, Version 2.0", "the GNU Lesser General Public License version 2"]
        for text, keys in licenses.TEXTS.values():
            words = text.split()
            plain = {i for a, n in (licenses.place_of(k, text) for k in keys) for i in range(a, a + n)}
            free = [i for i in range(len(words)) if i not in plain]
            key = sorted(plain)[len(plain) // 2]
            cut = text[text.index(keys[0]) :]
            lines += [
                text.upper() + ".", "start of file, " + text.replace(" ", ", ") + " and more", " ".join("x" if i in free[:2] else w for i, w in enumerate(words)), " ".join("x" if i == key else w for i, w in enumerate(words)),
                " ".join(keys[::-1]), " ".join(keys), cut, text + " " + text, " ".join(w for i, w in enumerate(words) if i not in free[-1:]), " ".join(licenses.TEXTS["zlib-notice"][0].split() + words),
            ]
        docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    else:
        docs = request.getfixturevalue(which)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = rows(licenses.license_digest(docs))
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) == brute_licenses(text[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and (r["score"] >= 0.999 or not r["labels"])
    assert licenses.license_digest(docs.limit(0)).count() == 0


def test_a_template_of_one_word_is_found_alone(spark):
    docs = spark.createDataFrame([(1, "zzz gplv3 yyy"), (2, "nothing here"), (3, "zzz gplv3 under yyy"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["own_labels"] for r in licenses.scan(docs, {"gplv3": ("gplv3",)}).collect()}
    assert {i for i, labels in got.items() if "gplv3" in labels} == {1, 3}
