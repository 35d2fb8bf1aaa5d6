import random

import pytest
from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.functions.policy import MergePolicy
from memspark.sources import memories as src
from memspark.streaming import store as streams

SCHEMA = "chat_id string, character_id string, id string, type string, content string, importance double, seq long"
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@pytest.fixture(autouse=True)
def rocks(spark):
    for k, v in STATE.items():
        spark.conf.set(k, v)
    yield
    for k in STATE:
        spark.conf.unset(k)


def candidates(spark, n=60):
    rng = random.Random(6)
    heads = ["In town Alice planned a birthday party", "then Alice moved her birthday party", "In town Bob repaired the old bridge", "Bob painted the old bridge again and again in town"]
    rows = [(f"c{i % 3}", "p", f"m{i:03d}", "event", rng.choice(heads) + rng.choice(["", "!", " with more words than ever before"]), 0.5, i) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    meta = src.metadata(entities=t.entities(F.col("content")), keywords=t.keywords(F.col("content")))
    return df.withColumns({"normalized_content": t.normalize_content(F.col("content")), "source": F.lit("auto"), "metadata": meta})


def sequential(rows, p):
    """The rule, one candidate after another."""
    state, out = {}, []
    for r in sorted(rows, key=lambda r: r["seq"]):
        mem = state.setdefault(r["chat_id"], {})
        norm, ents, kws = r["normalized_content"], list(r["metadata"]["entities"]), list(r["metadata"]["keywords"])
        hit, branch = (norm, "exact") if norm in mem else (None, "new")
        if hit is None:
            for k in sorted(mem, key=lambda k: -mem[k]["seq"]):
                if {e.lower() for e in ents} & {e.lower() for e in mem[k]["e"]} and len(set(kws) & set(mem[k]["k"])) >= 2:
                    hit, branch = k, "soft"
                    break
        if hit is None:
            mem[norm] = {"id": r["id"], "content": r["content"], "imp": 0.5, "e": ents, "k": kws, "seq": r["seq"]}
        else:
            m = mem[hit]
            m["e"] += [x for x in ents if x not in m["e"]]
            m["k"] += [x for x in kws if x not in m["k"]]
            m["imp"], m["seq"] = min(1.0, m["imp"] + (p.exact_boost if branch == "exact" else p.soft_boost)), r["seq"]
            if len(r["content"]) > len(m["content"]) + p.longer_by:
                m["content"] = r["content"]
                mem[norm] = mem.pop(hit)
                hit = norm
        m = mem[hit or norm]
        out.append((r["id"], branch, m["id"], m["content"], round(m["imp"], 6)))
    return sorted(out)


def test_store_stream_in_batches_equals_the_sequence(spark, tmp_path):
    df = candidates(spark)
    expected = sequential(df.collect(), MergePolicy())
    pick = lambda rows: sorted((r["id"], r["branch"], r["matched_id"] or r["id"], r["content"], round(r["importance"], 6)) for r in rows)
    assert pick(streams.store_stream(df).collect()) == expected
    feed = str(tmp_path / "feed")
    for at in (0, 20, 40):
        df.filter((F.col("seq") >= at) & (F.col("seq") < at + 20)).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(feed)
    q = streams.store_stream(stream).writeStream.format("memory").queryName("stored").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert pick(spark.table("stored").collect()) == expected


def held(spark):
    """Memories that the store holds before the stream: one that may change, protected ones, and two of equal content."""
    base = candidates(spark, 60).filter("seq < 6").withColumn("id", F.concat(F.lit("old-"), "id"))
    flags = {"pinned": F.col("seq") == 1, "archived": F.col("seq") == 2, "source": F.when(F.col("seq") == 3, F.lit("manual")).otherwise(F.lit("auto"))}
    times = {c: F.timestamp_seconds(F.col("seq") * 60) for c in ("created_at", "updated_at")}
    rows = base.withColumns({**flags, **times})
    return rows.unionByName(rows.filter("seq = 0").withColumns({"id": F.lit("old-twin"), "created_at": F.timestamp_seconds(F.lit(7)), "updated_at": F.timestamp_seconds(F.lit(7))}))


def with_protection(rows, memories, p):
    """The rule with a store that isn't empty: protected memories are skipped on exact hits and passed by on soft ones."""
    state, out = {}, []
    for r in sorted(memories, key=lambda r: (r["created_at"], r["id"])):
        safe = r["source"] != "auto" or r["pinned"] or r["archived"]
        mem = {"id": r["id"], "norm": r["normalized_content"], "content": r["content"], "e": list(r["metadata"]["entities"]), "k": list(r["metadata"]["keywords"]), "safe": safe, "when": (0, r["updated_at"], r["id"])}
        state.setdefault(r["chat_id"], []).append(mem)
    for r in sorted(rows, key=lambda r: r["seq"]):
        mems, norm, ents, kws = state.setdefault(r["chat_id"], []), r["normalized_content"], list(r["metadata"]["entities"]), list(r["metadata"]["keywords"])
        hit, branch = next((m for m in mems if m["norm"] == norm), None), "exact"
        if hit is None:
            near = [m for m in sorted(mems, key=lambda m: m["when"], reverse=True)[: p.newest] if not m["safe"]]
            hit = next((m for m in near if {e.lower() for e in ents} & {e.lower() for e in m["e"]} and len(set(kws) & set(m["k"])) >= 2), None)
            branch = "soft" if hit else "new"
        if hit is None:
            hit = {"id": r["id"], "norm": norm, "content": r["content"], "e": ents, "k": kws, "safe": False}
            mems.append(hit)
        elif not hit["safe"]:
            hit["e"] += [x for x in ents if x not in hit["e"]]
            hit["k"] += [x for x in kws if x not in hit["k"]]
            if len(r["content"]) > len(hit["content"]) + p.longer_by:
                hit["content"], hit["norm"] = r["content"], norm
        if not hit["safe"] or branch != "exact":
            hit["when"] = (1, r["seq"])
        decision = "stored" if branch == "new" else "skipped_exact_protected" if hit["safe"] and branch == "exact" else "updated"
        out.append((r["id"], decision, branch, hit["id"], hit["content"]))
    return sorted(out)


@pytest.mark.parametrize("newest", [200, 2])
def test_store_stream_begins_with_memories_and_protects_them(spark, tmp_path, newest):
    df, memories, p = candidates(spark), held(spark), MergePolicy(newest=newest)
    expected = with_protection(df.collect(), memories.collect(), p)
    assert {d for _, d, *_ in expected} == {"stored", "updated", "skipped_exact_protected"}
    pick = lambda rows: sorted((r["id"], r["decision"], r["branch"], r["matched_id"] or r["id"], r["content"]) for r in rows)
    assert pick(streams.store_stream(df, merge=p, memories=memories).collect()) == expected
    feed = str(tmp_path / "feed")
    for at in (0, 20, 40):
        df.filter((F.col("seq") >= at) & (F.col("seq") < at + 20)).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(feed)
    name = f"protected{newest}"
    q = streams.store_stream(stream, merge=p, memories=memories).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert pick(spark.table(name).collect()) == expected


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    base = candidates(spark, 9).withColumns({"layer": F.lit("episodic"), "pinned": F.lit(False), "archived": F.lit(False), "created_at": F.timestamp_seconds("seq"), "updated_at": F.timestamp_seconds("seq"), "last_accessed_at": F.lit(None).cast("timestamp"), "access_count": F.lit(0).cast("long")}).select(*src.COLUMNS)
    run = streams.summary_batches(lambda: base, streams.replace_batch(str(tmp_path / "out")), lambda: F.lit("2026-01-01").cast("timestamp"), by_batch=True)
    for scope, number in (("c1", 0), ("c2", 1), ("c2", 1)):
        run(base.filter(F.col("chat_id") == scope), number)
    assert sorted(r["chat_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["c1", "c2"]


def test_counts_of_uses_and_decisions(spark):
    log = spark.createDataFrame([("a", 0), ("a", 700), ("b", 650)], "id string, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    assert {(r["id"], r["uses"], r["last_use"].minute) for r in streams.usage_stream(log).collect()} == {("a", 2, 11), ("b", 1, 10)}
    made = log.select(F.col("id").alias("decision"), "ts")
    assert {(r["window"]["start"].minute, r["decision"], r["n"]) for r in streams.decision_counts(made).collect()} == {(0, "a", 1), (10, "a", 1), (10, "b", 1)}


def test_turns_and_context(spark, tmp_path):
    rows = [("c", i, f"t{i}", f"k{i % 3}", i) for i in range(6)]
    df = spark.createDataFrame(rows, "chat_id string, msg_idx int, text string, turn_key string, s int").withColumn("ts", F.timestamp_seconds(F.col("s")))
    got = {r["msg_idx"]: list(r["recent"]) for r in streams.recent_context_stream(df, 3).collect()}
    assert got[0] == ["t0"] and got[5] == ["t3", "t4", "t5"]
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "t"))
    q = streams.once_per_turn(stream).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["turn_key"] for r in spark.table("turns").collect()) == ["k0", "k1", "k2"]


def test_summaries_of_touched_scopes(spark):
    base = candidates(spark, 9).withColumns({"layer": F.lit("episodic"), "pinned": F.lit(False), "archived": F.lit(False), "created_at": F.timestamp_seconds("seq"), "updated_at": F.timestamp_seconds("seq"), "last_accessed_at": F.lit(None).cast("timestamp"), "access_count": F.lit(0).cast("long")}).select(*src.COLUMNS)
    wrote = []
    run = streams.summary_batches(lambda: base, lambda df: wrote.extend(df.collect()), lambda: F.lit("2026-01-01").cast("timestamp"))
    run(base.filter("chat_id = 'c1'"), 0)
    assert [(r["chat_id"], r["action"]) for r in wrote] == [("c1", "created")]
