"""Tables that are read in part: lemmas, trigram postings, pages, buckets."""

import os
import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.operators import blocks, changes, contained, insight, lemmas, overlap, search
from memspark.plans import more
from memspark.sources import memories as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def known(spark):
    rows = src.memories_from_conversations(spark, SF)
    return spark.createDataFrame(rows.collect(), rows.schema)


@pytest.fixture
def table(known, tmp_path):
    src.append_memories(known, f"{tmp_path}/table")
    return f"{tmp_path}/table"


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_lemmas_from_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(overlap, "LIGHT", 5)
    rows = spark.createDataFrame([(1, "Anna saw Forms7 and forms8 again"), (2, None), (3, "nothing here"), (1, "В Риме видели Анну и Анне писали"), *[(10 + i, f"forms9 of text {i}") for i in range(20)]], "id int, text string")
    few = {"forms7": "form", "forms8": "form", "forms9": "form", "анну": "анна", "анне": "анна", "риме": "рим"}
    table = spark.range(300_000).select(F.concat(F.lit("other"), "id").alias("word"), F.lit("x").alias("lemma")).unionByName(spark.createDataFrame([*few.items(), ("saw", None), ("forms7", "zz")], "word string, lemma string"))
    x = F.col("text")
    show = lambda df, forms: sorted((r["id"], str(r["k"]), str(r["e"])) for r in df.select("id", t.keywords(x, lemmas=forms).alias("k"), t.entities(x, lemmas=forms).alias("e")).collect())
    got = lemmas.with_forms(rows, ["text"], table)
    assert show(got, F.col("forms")) == show(rows, few)
    plan = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert plan(got) < 1.2 * plan(lemmas.with_forms(rows, ["text"], spark.createDataFrame(list(few.items()), "word string, lemma string")))


@pytest.mark.parametrize("needle", ["the", " THE  th ", "chat", "event", "zzzq", "th", "", "ñ", "auto episodic", "0-1"])
def test_postings_find_what_a_scan_finds(spark, known, table, tmp_path, needle):
    rows = spark.read.schema(f"{src.MEMORY}, bucket int").parquet(table)
    search.write_postings(rows, f"{tmp_path}/postings")
    got = {r["id"] for r in search.search_postings(spark, rows, f"{tmp_path}/postings", needle).collect()}
    assert got == {r["id"] for r in insight.search(known, needle).collect()}


def test_a_rare_needle_reads_few_buckets(spark, known, table, tmp_path):
    rows = spark.read.schema(f"{src.MEMORY}, bucket int").parquet(table)
    search.write_postings(rows, f"{tmp_path}/postings")
    one = known.filter("length(content) > 60").first()
    got = search.search_postings(spark, rows, f"{tmp_path}/postings", one["content"][:50])
    assert one["id"] in {r["id"] for r in got.collect()}
    held = len({f.split("/")[0] for f in files(table)})
    buckets = {r["bucket"] for r in rows.join(got.select("id"), "id").select("bucket").distinct().collect()}
    assert len(buckets) < held / 2


def test_pages_read_only_the_ranges_they_lie_in(spark, tmp_path):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("score"), "id")
    order = [F.desc("score"), F.asc("id")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    search.write_pages(rows, order, f"{tmp_path}/p")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    everything = [(r["score"], r["id"]) for r in rows.orderBy(*order).collect()]
    for offset, limit in ((0, 10), (1245, 20), (2500, 3000), (4990, 50), (6000, 5), (0, 0)):
        page = search.read_page(spark, f"{tmp_path}/p", order, offset, limit)
        assert [(r["score"], r["id"]) for r in page.collect()] == everything[offset : offset + limit]
        assert {r["total"] for r in page.collect()} <= {5000}
    # Without the other ranges the page can still be read.
    folders = sorted({os.path.dirname(f) for f in files(f"{tmp_path}/p/rows")}, key=lambda f: int(f.split("=")[1]))
    assert len(folders) >= 4
    for folder in folders[:2]:
        shutil.rmtree(f"{tmp_path}/p/rows/{folder}")
    page = search.read_page(spark, f"{tmp_path}/p", order, 4000, 10)
    assert [(r["score"], r["id"]) for r in page.collect()] == everything[4000:4010]


def test_appends_write_a_file_a_bucket(known, table):
    count = lambda: max(sum(f.startswith(f"bucket={b}/") for f in files(table)) for b in range(src.BUCKETS))
    assert count() == 1
    src.append_memories(known, table)
    assert count() == 2


def test_only_touched_buckets_are_rewritten(spark, known, table):
    before, ids = files(table), sorted(r["id"] for r in known.collect())
    feed = spark.createDataFrame([(ids[0], 1, "update", "A new content"), (ids[1], 2, "toggle_pinned", None), ("unknown", 3, "delete", None)], "id string, seq long, action string, content string").withColumn("ts", F.lit("2026-04-01").cast("timestamp"))
    expected = sorted(map(str, changes.apply_changes(known, feed).collect()))
    touched = src.rewrite_memories(spark, table, feed, changes.apply_changes)
    assert sorted(map(str, src.read_memories(spark, table).select(*src.COLUMNS).collect())) == expected
    assert 1 <= len(touched) <= 2
    stays = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
    assert stays == {f for f in files(table) if int(f.split("/")[0].split("=")[1]) not in touched}
    # Reviews and uses go the same way.
    reviews = spark.createDataFrame([(ids[2], 1, "mark_reviewed_keep", None, "fine")], "id string, seq long, action string, related_memory_id string, note string").withColumn("ts", F.lit("2026-04-02").cast("timestamp"))
    src.rewrite_memories(spark, table, reviews, changes.apply_reviews)
    src.rewrite_memories(spark, table, spark.createDataFrame([(ids[2], "2026-04-03")], "id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")), changes.apply_usage)
    row = src.read_memories(spark, table).filter(F.col("id") == ids[2]).first()
    assert (row["metadata"]["review_status"], row["access_count"]) == ("reviewed_keep", 1)


def test_a_bucket_that_loses_its_rows_goes(spark, known, table):
    scope = known.groupBy("chat_id", "character_id").count().orderBy("count").first()
    gone = known.filter((F.col("chat_id") == scope["chat_id"]) & (F.col("character_id") == scope["character_id"]))
    bucket = gone.select(src.bucket_of("chat_id", "character_id").alias("b")).first()["b"]
    feed = known.filter(src.bucket_of("chat_id", "character_id") == bucket).select("id", F.lit(1).cast("long").alias("seq"), F.lit("delete").alias("action"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("content"))
    left = known.count() - feed.count()
    assert src.rewrite_memories(spark, table, feed, changes.apply_changes) == [bucket]
    assert src.read_memories(spark, table).count() == left
    assert not any(f.startswith(f"bucket={bucket}/") for f in files(table))
    assert src.rewrite_memories(spark, table, feed, changes.apply_changes) == []


def test_all_reasons_of_the_gate_occur():
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    found = {r[0] for r in con.execute(f"SELECT DISTINCT gate_reason FROM ({more.ORACLES['gate_reasons']})").fetchall()}
    # Punctuation becomes blanks, of which one stays, so nothing that isn't empty is empty after normalisation.
    assert len(found) == 9


def test_postings_are_no_row_for_each_gram_and_memory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 7)
    rows = more.said_memories(spark, SF).withColumn("bucket", src.bucket_of("chat_id", "character_id"))
    rows = rows.withColumn("content", F.when(F.substring("id", -1, 1) == "1", F.concat(F.lit("𝄞ñ𝄞"), "content")).otherwise(F.col("content")))
    search.write_postings(rows.filter("bucket % 2 = 0"), f"{tmp_path}/p")
    search.write_postings(rows.filter("bucket % 2 = 1"), f"{tmp_path}/p")
    made = spark.read.parquet(f"{tmp_path}/p").filter("part >= 0")
    assert 2 * made.count() < made.agg(F.sum("n")).first()[0]
    for needle in ("𝄞Ñ𝄞", "ñ𝄞я", "анна и борис", "thon", "никого тут нет"):
        got = sorted(r["id"] for r in search.search_postings(spark, rows, f"{tmp_path}/p", needle).collect())
        assert got == sorted(r["id"] for r in insight.search(rows, needle).collect())


def test_needles_are_found_in_pieces_of_a_text(spark, monkeypatch):
    monkeypatch.setattr(contained, "PIECE", 50)
    texts = spark.createDataFrame([("a", "".join(chr(97 + i * i % 23) for i in range(400)) + "ñ𝄞" * 3), ("b", ""), ("c", "x" * 500)], "k string, text string")
    whole = {r["k"]: r["text"] for r in texts.collect()}
    a = whole["a"]
    needles = [("a", n) for n in (a, a[:1], a[49:51], a[-3:], a[7:200], a[7:200] + "!", "!" + a[7:200], a[37:166], a[37:101], a[37:102], a + "a", "")]
    needles += [("b", "x"), ("c", "x" * 129), ("c", "x" * 501), ("d", a[:9])]
    rows = contained.told_apart(spark.createDataFrame(needles, "k string, needle string"), "needle")
    got = rows.join(contained.contained(rows, texts, "k", "text"), ["k", *contained.TOLD], "left_semi")
    assert sorted((r["k"], r["needle"]) for r in got.collect()) == sorted((k, n) for k, n in needles if n and n in whole.get(k, ""))


def test_no_entry_is_joined_with_its_block(spark):
    entries = src.lore_entries(more.plain_pages(spark, SF).select("request_id", F.col("page_id").alias("pos"), F.col("page_id").cast("string").alias("id"), F.lit("memory-anchor").alias("tags"), F.col("plain").alias("entry")))
    known = spark.createDataFrame([("r0", "x")], "request_id string, block string")
    plan = blocks.anchor_blocks(entries, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(known" not in plan
