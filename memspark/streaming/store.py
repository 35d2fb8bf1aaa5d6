"""Streams of candidates, uses and turns. State is kept per scope by Structured Streaming."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.policy import GatePolicy, MergePolicy, SummaryPolicy
from ..operators.extract import quality_gate
from ..operators.summary import rolling_summary, summary_metadata, summary_text

SCOPE = ["chat_id", "character_id"]
DECISIONS = "chat_id string, character_id string, id string, decision string, branch string, matched_id string, content string, importance double, entities array<string>, keywords array<string>"


#: State: a memory by its id, ids by normalised content in the order they came, and ids by their last change, newest first.
MEMORY_STATE = "id string, type string, content string, norm string, importance double, entities array<string>, keywords array<string>, protected boolean"
FIELDS = [x.split(" ")[0] for x in MEMORY_STATE.split(", ")]


class SequentialStore(StatefulProcessor):
    """Stores a scope's candidates one after another: each sees what earlier ones changed.

    A call reads the newest memories, as soft matches look at these only, and what its candidates hit exactly; so its work grows with its candidates, not
    with the scope. Rows are handled in the chunks in which they come, by seq within a chunk, and each chunk's changes are written before the next.
    Memories that are pinned, archived or not automatic are protected: an exact hit skips the candidate, soft matches pass them by.
    ttl_ms: memories that nothing has changed for so long are forgotten; who hits a forgotten one finds nothing.
    """

    def __init__(self, policy: MergePolicy, ttl_ms: int | None = None):
        self.policy, self.ttl_ms = policy, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memories = handle.getMapState("memories", "key string", MEMORY_STATE, self.ttl_ms)
        self.by_norm = handle.getMapState("by_norm", "norm string", "ids array<string>", self.ttl_ms)
        self.newest = handle.getListState("newest", "seq long, id string")

    def _cut(self, order: list[tuple]) -> list[tuple]:
        return order if self.policy.newest is None else order[: self.policy.newest]

    def _ids(self, norm: str) -> list[str]:
        return list(self.by_norm.getValue((norm,))[0]) if self.by_norm.containsKey((norm,)) else []

    def _put(self, m: dict) -> None:
        self.memories.updateValue((m["id"],), tuple(m[f] for f in FIELDS))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timer_values) -> None:
        """The memories that a scope has when the stream begins. Times before it count as older than every candidate."""
        rows, ids = initialState.sort_values(["updated_at", "id"], ascending=False), {}
        for r in rows.sort_values(["created_at", "id"]).itertuples():
            ids.setdefault(r.normalized_content, []).append(r.id)
        for r in rows.itertuples():
            self._put(_memory(r))
        for norm, some in ids.items():
            self.by_norm.updateValue((norm,), (some,))
        self.newest.put(self._cut([(-1, x) for x in rows["id"]]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        order, cache = [(s, i) for s, i in self.newest.get()], {}

        def memory(i: str) -> dict | None:
            if i not in cache:
                cache[i] = _listed_state(self.memories.getValue((i,))) if self.memories.containsKey((i,)) else None
            return cache[i]

        for chunk in rows:
            out, changed = [], set()
            for c in chunk.sort_values(["seq", "id"]).itertuples():
                new = _memory(c)
                branch, hit = "exact", next((m for m in map(memory, self._ids(new["norm"])) if m), None)
                if hit is None:
                    hit = next((m for m in (memory(i) for _, i in order) if m and self._soft(new, m)), None)
                    branch = "soft" if hit else "new"
                if branch == "exact" and hit["protected"]:
                    out.append(self._row(key, c.id, "skipped_exact_protected", branch, hit))
                    continue
                if hit is None:
                    cache[c.id] = new
                    self.by_norm.updateValue((new["norm"],), ([c.id],))
                else:
                    self._merge(hit, new, self.policy.exact_boost if branch == "exact" else self.policy.soft_boost)
                m = hit or new
                changed.add(m["id"])
                order = self._cut([(int(c.seq), m["id"]), *[x for x in order if x[1] != m["id"]]])
                out.append(self._row(key, c.id, "updated" if hit else "stored", branch, m, hit is None))
            for i in changed:
                self._put(cache[i])
            kept = {i for _, i in order}
            cache = {i: m for i, m in cache.items() if i in kept}
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in DECISIONS.split(", ")])
        self.newest.put(order)

    @staticmethod
    def _row(key: tuple, candidate: str, decision: str, branch: str, m: dict, is_new: bool = False) -> tuple:
        return (*key, candidate, decision, branch, None if is_new else m["id"], m["content"], m["importance"], list(m["entities"]), list(m["keywords"]))

    def _soft(self, new: dict, old: dict) -> bool:
        lower = lambda xs: {x.lower() for x in xs}
        if old["protected"] or new["type"] != old["type"]:
            return False
        return len(lower(new["entities"]) & lower(old["entities"])) >= self.policy.min_entities and len(set(new["keywords"]) & set(old["keywords"])) >= self.policy.min_keywords

    def _merge(self, old: dict, new: dict, boost: float) -> None:
        """Folds new into old; a clearly longer content takes over, and with it the normalised one."""
        for f in ("entities", "keywords"):
            old[f] += [x for x in new[f] if x not in old[f]]
        old["importance"] = min(old["importance"] + boost, 1.0)
        if len(new["content"]) > len(old["content"]) + self.policy.longer_by:
            old["content"] = new["content"]
            if new["norm"] != old["norm"]:
                left = [i for i in self._ids(old["norm"]) if i != old["id"]]
                self.by_norm.updateValue((old["norm"],), (left,)) if left else self.by_norm.removeKey((old["norm"],))
                self.by_norm.updateValue((new["norm"],), ([old["id"]],))
                old["norm"] = new["norm"]

    def close(self) -> None:
        pass


def _memory(r) -> dict:
    return {
        "id": r.id, "type": r.type, "content": r.content, "norm": r.normalized_content, "importance": float(r.importance), "entities": list(r.entities), "keywords": list(r.keywords), "protected": bool(r.protected),
    }


def _listed_state(value: tuple) -> dict:
    m = dict(zip(FIELDS, value, strict=True))
    return m | {f: list(m[f]) for f in ("entities", "keywords")}


#: The state store that keyed state needs.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """For queries that keep keyed state: sets the session's state store and puts it back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _stateful(df: DataFrame) -> DataFrame:
    """df, in a session whose state store coordinator runs: a batch query doesn't start it, asking for the streams does."""
    _ = df.sparkSession.streams.active
    return df


def _listed(rows: DataFrame) -> DataFrame:
    """rows with their lists and whether they are protected from automatic changes; flags that are missing count as false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    protected = (F.col("source") != "auto") | flag("pinned") | flag("archived")
    lists = {c: F.coalesce(f"metadata.{c}", F.array().cast("array<string>")) for c in ("entities", "keywords")}
    return rows.withColumns({**lists, "protected": F.coalesce(protected, F.lit(True))})


STORED = ["id", "type", "content", "normalized_content", "importance", "entities", "keywords", "protected"]


def store_stream(candidates: DataFrame, gate: GatePolicy | None = None, merge: MergePolicy | None = None, memories: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Decisions on a stream (or table) of candidates (id, scope, type, content, normalized_content, source, importance, metadata, seq) that pass the gate, in the order of seq within a batch.

    memories: a table of memories that the store holds when the stream begins; without it scopes begin empty. ttl_ms: see SequentialStore.
    """
    rows = _listed(quality_gate(candidates, gate).filter("gate_ok")).select(*SCOPE, *STORED, "seq")
    held = None if memories is None else _listed(memories).select(*SCOPE, *STORED, "created_at", "updated_at").groupBy(*SCOPE)
    return _stateful(rows).groupBy(*SCOPE).transformWithStateInPandas(
        statefulProcessor=SequentialStore(merge or MergePolicy(), ttl_ms), outputStructType=DECISIONS, outputMode="append", timeMode="processingTime" if ttl_ms else "none", initialState=held
    )


def usage_stream(log: DataFrame) -> DataFrame:
    """id, uses, last_use of a stream of uses (id, ts), for update mode."""
    return log.groupBy("id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_use"))


def once_per_turn(turns: DataFrame, delay: str = "10 minutes", ts: str = "ts", key: str = "turn_key") -> DataFrame:
    """Each turn key once within the watermark."""
    return turns.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def decision_counts(decisions: DataFrame, ts: str = "ts", width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Tumbling counts of store decisions."""
    return decisions.withWatermark(ts, delay).groupBy(F.window(ts, width), "decision").agg(F.count("*").alias("n"))


class RecentContext(StatefulProcessor):
    """Emits each message with the last n texts of its chat, itself included; messages are handled in the chunks in which they come."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getListState("texts", "text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        recent = [x[0] for x in self.texts.get()]
        for chunk in rows:
            out = []
            for r in chunk.sort_values("msg_idx").itertuples():
                recent = [*recent, r.text][-self.n :]
                out.append((key[0], r.msg_idx, list(recent)))
            yield pd.DataFrame(out, columns=["chat_id", "msg_idx", "recent"])
        self.texts.put([(x,) for x in recent])

    def close(self) -> None:
        pass


def recent_context_stream(messages: DataFrame, n: int = 8) -> DataFrame:
    """chat_id, msg_idx, recent of a stream of messages (chat_id, msg_idx, text)."""
    rows = messages.select("chat_id", "msg_idx", "text")
    return _stateful(rows).groupBy("chat_id").transformWithStateInPandas(statefulProcessor=RecentContext(n), outputStructType="chat_id string, msg_idx int, recent array<string>", outputMode="append", timeMode="none")


class IncrementalSummary(StatefulProcessor):
    """Decides, for each batch that touches a scope, whether its rolling summary is made anew.

    State: the newest episodic memories, as many as a summary covers, and the summary with the ids that it covers. So a batch costs what it brings, and no
    memory table is read again. A summary that the stream has seen or written counts however many memories follow it. A seen one takes the place of a written one
    if it is newer, where times in the future count as the time of writing.
    """

    def __init__(self, p: SummaryPolicy, as_of: int | None):
        self.p, self.as_of = p, as_of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "updated_at long, id string, content string, entities array<string>, keywords array<string>, is_summary boolean")
        self.summary = handle.getValueState("summary", "updated_at long, id string, known array<string>, written boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        p, window, held = self.p, [tuple(x) for x in self.window.get()], self.summary.get() if self.summary.exists() else None
        now = self.as_of if self.as_of is not None else time.time_ns() // 1000
        for chunk in rows:
            for r in chunk.itertuples():
                if r.rolling and (held is None or (min(r.updated_at, now) > held[0] if held[3] else (r.updated_at, r.id) > tuple(held[:2]))):
                    held = (r.updated_at, r.id, list(r.known), False)
                if r.episodic:
                    window.append((r.updated_at, r.id, r.content, list(r.entities), list(r.keywords), bool(r.is_summary)))
            window = sorted(window, key=lambda x: x[:2], reverse=True)[: max(p.window, 1)]
        items = [x for x in window if not x[5]]
        ids = [x[1] for x in reversed(items)]
        new = len([i for i in ids if held is None or i not in held[2]])
        if len(ids) < p.min_inputs:
            action = "skipped_not_enough_inputs"
        elif held is not None and new < p.min_new:
            action = "skipped_not_enough_new_inputs"
        else:
            action = "created" if held is None else "updated"
            made = held[1] if held else hashlib.sha256("#".join((*key, p.kind)).encode()).hexdigest()
            held, window = (now, made, ids, True), [(now, *x[1:]) if x[1] == made else x for x in window]
        if window:  # an empty list is no state
            self.window.put(window)
        if held is not None:
            self.summary.update((held[0], held[1], list(held[2]), held[3]))
        shown = items if action in ("created", "updated") else []
        row = (*key, action, held[1] if held else None, ids, len(ids), new, [x[2] for x in shown], [list(x[3]) for x in shown], [list(x[4]) for x in shown])
        yield pd.DataFrame([row], columns=[x.split(" ")[0] for x in SUMMARISED.split(", ")])

    def close(self) -> None:
        pass


SUMMARISED = "chat_id string, character_id string, action string, summary_memory_id string, source_ids array<string>, summarized_count int, new_input_count int, contents array<string>, entities array<array<string>>, keywords array<array<string>>"


def summary_stream(memories: DataFrame, p: SummaryPolicy | None = None, as_of: int | None = None, skips: bool = False) -> DataFrame:
    """Summaries of a stream (or table) of memories, from state per scope: a row for each batch in which a scope's summary is created or updated; with skips also for others.

    Columns as of rolling_summary(), text and metadata null where nothing is written. as_of: microseconds that count as the time of writing (None: now). Archived memories are passed by.
    """
    p = p or SummaryPolicy()
    meta = F.col("metadata")
    rolling = (F.col("type") == "summary") | (F.coalesce(meta["is_summary"], F.lit(False)) & F.coalesce(meta["summary_kind"] == p.kind, F.lit(False)))
    empty = F.array().cast("array<string>")
    rows = memories.filter("not archived").select(
        *SCOPE, "id", "content", F.unix_micros("updated_at").alias("updated_at"), rolling.alias("rolling"), (F.col("layer") == "episodic").alias("episodic"), F.coalesce(meta["is_summary"], F.lit(False)).alias("is_summary"),
        F.coalesce(meta["entities"], empty).alias("entities"), F.coalesce(meta["keywords"], empty).alias("keywords"), F.coalesce(meta["summary_source_memory_ids"], empty).alias("known"),
    ).filter("rolling or episodic")
    got = _stateful(rows).groupBy(*SCOPE).transformWithStateInPandas(statefulProcessor=IncrementalSummary(p, as_of), outputStructType=SUMMARISED, outputMode="append", timeMode="none")
    when = F.current_timestamp() if as_of is None else F.timestamp_micros(F.lit(as_of))
    writes = F.col("action").isin("created", "updated")
    items = F.transform(F.sequence(F.lit(0), F.size("contents") - 1), lambda i: F.struct(F.get("contents", i).alias("content"), F.get("entities", i).alias("entities"), F.get("keywords", i).alias("keywords")))
    text = F.when(writes, summary_text(items, p))
    done = got.withColumn("summary_text", text).withColumn("newest_first", F.when(writes, items))
    done = done.withColumn("metadata", F.when(writes, summary_metadata(F.col("summary_text"), F.col("newest_first"), F.col("source_ids"), F.col("summarized_count"), when, p)))
    done = done if skips else done.filter(writes)
    return done.select(*SCOPE, "action", "summary_memory_id", "summary_text", "source_ids", "summarized_count", "new_input_count", F.lit(p.min_new).alias("refresh_threshold"), "metadata")


def summary_batches(read: Callable[[], DataFrame], write: Callable[..., None], as_of: Callable[[], Column], by_batch: bool = False) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on a stream of new episodic memories: summarises the scopes that the batch touched.

    A batch may come again after a failure. by_batch: write also gets the batch's number, so that it can replace what the first attempt
    wrote (see replace_batch). A summary's id is that of its scope, so writers that merge by id need no number.
    """

    def run(batch: DataFrame, number: int) -> None:
        touched = batch.select(*SCOPE).distinct()
        done = rolling_summary(read().join(touched, SCOPE, "left_semi"), as_of())
        write(done, number) if by_batch else write(done)

    return run


def replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A writer for batches that may come again: each batch has a folder of its own, which a second attempt replaces."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
