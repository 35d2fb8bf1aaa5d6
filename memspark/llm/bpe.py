"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash over the bytes cuts texts into chunks, so equal passages give equal chunks wherever they stand.
A chunk that occurs more than once in the corpus is encoded once, in one task, and its ids go to all its places. Chunks
are cut anywhere, so near a chunk join these ids may be wrong: the join is repaired by encoding the text around it anew, from
the last pre-token of what is certain on the left into the chunk on the right, until both agree on where a pre-token starts.
From a common start on they are equal, as a pre-token depends on nothing before it. The stretch grows until they agree;
a chunk that never agrees is encoded as text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, durable

#: Fixed values of byte-level BPE: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rolling hash: bytes in its window, mean chunk (a power of two), least and most bytes of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 1024, 256, 8192
#: Bytes of a chunk that a join's repair encodes anew at first, and by how much the stretch grows.
STRETCH, GROWTH = 48, 4
#: Bits of the filter of shared chunks, as a power of two: 8 MB at most are broadcast.
FILTER_BITS = 26
ROWS_OUT = 256

_MULT = np.uint32(0x9E3779B1)
_BYTE = ((np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def check_spec(spec: dict) -> None:
    """Raises ValueError for a tokenizer file whose rules this module doesn't follow."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    names = [t["content"] for t in added]
    wrong = {
        "model other than plain BPE": model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "pre-tokenizer other than byte-level with its pattern and no prefix space": pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True),
        "decoder other than byte-level": (spec.get("decoder") or {}).get("type") != "ByteLevel",
        "normalizer": spec.get("normalizer") is not None,
        "added token that takes in blanks or stands only as a word": any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")),
        "added tokens that may overlap": any((a != b and b in a) or any(a.endswith(b[:n]) for n in range(1, len(b))) for a in names for b in names),
    }
    if found := [k for k, bad in wrong.items() if bad]:
        raise ValueError(f"tokenizer file with {', '.join(found)}")


class Codec:
    """Encodes and decodes bytes as the tokenizers library does with the file's contents.

    Texts of Latin letters and common punctuation go through tiktoken with the same ranks, which is several times
    faster; anything else goes through the library itself.
    """

    def __init__(self, contents: str):
        import regex
        import tiktoken

        self.contents, self.library = contents, None
        spec = json.loads(contents)
        check_spec(spec)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        #: Bytes at the end of a cut text in which a pre-token's end may be wrong: contractions and special tokens need so many to be seen.
        self.guard = max([3, *(len(x.encode()) for x in special)])
        self.pieces = np.empty(max(*ranks.values(), *special.values()) + 1, dtype=object)
        self.pieces[:] = b""
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.pieces[i] = token
        self.blanks_are_sure = not any(" " in x for x in special)
        self.lengths = np.array([len(x) for x in self.pieces], dtype=np.int64)
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, sorted(special)))) if special else None
        self.odd = regex.compile(r"[^\x00-\x7F¡-ɏ‐-‟…€]")

    def encode(self, data: bytes) -> np.ndarray:
        text = data.decode("utf-8", "replace")
        if not data.isascii() and self.odd.search(text):
            return self.encode_all(text)
        return np.array(self.fast.encode(text, allowed_special=self.special, disallowed_special=()), dtype=np.uint32)

    def encode_all(self, text: str) -> np.ndarray:
        return np.array(self.loaded().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def loaded(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.contents)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(self.pieces[ids].tolist())

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")

    def starts(self, data: bytes, whole: bool = False) -> np.ndarray:
        """Byte places where pre-tokens and special tokens start. Without `whole` text may follow, so only those that hold whatever follows are given."""
        text, out, at = data.decode("utf-8", "replace"), [], 0
        for part in self._parts(text):
            for a, b in part:
                out.append(at)
                at += b - a if text.isascii() else len(text[a:b].encode())
        out = np.array(out, dtype=np.int64)
        return out if whole else out[out <= len(data) - self.guard]

    def _parts(self, text: str) -> Iterator[list[tuple[int, int]]]:
        """(start, end) of the pre-tokens between special tokens, and of these, in order."""
        at = 0
        for a, b in [*([m.span() for m in self.split.finditer(text)] if self.split else []), (len(text), len(text))]:
            if a > at:
                part = text[at:a]
                if part.isascii() or not self.odd.search(part):
                    yield [(at + x, at + y) for x, y in (m.span() for m in self.words.finditer(part))]
                else:
                    yield [(at + x, at + y) for _, (x, y) in self.loaded().pre_tokenizer.pre_tokenize_str(part)]
            if b > a:
                yield [(a, b)]
            at = b


@lru_cache(1)
def codec(contents: str) -> Codec:
    return Codec(contents)


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the rolling hash cuts, moved to the next character's start, the end included."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h, power, width = _BYTE[data], _MULT, 1
    while width < WINDOW:  # h at i covers the bytes from i on
        h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
        power, width = np.uint32(int(power) ** 2 & 0xFFFFFFFF), 2 * width
    marks = np.flatnonzero(h >> np.uint32(32 - (MEAN.bit_length() - 1)) == 0) + WINDOW
    ends, last = [], 0

    def cut(at: int) -> int:
        while at < n and data[at] & 0xC0 == 0x80:
            at += 1
        ends.append(at)
        return at

    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            last = cut(last + MOST)
        if m > last and (m - last >= LEAST or m == n):
            last = cut(m)
    return ends


def chunks(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of a text's chunks, in order."""
    ends = chunk_ends(np.frombuffer(raw, dtype=np.uint8))
    return list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []


def _key(body: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(body)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text"):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[int, int], int] = {}
        for raw in _texts(batch):
            for a, b in chunks(raw):
                if b - a >= LEAST:
                    k = _key(raw[a:b])
                    seen[k] = seen.get(k, 0) + 1
        yield pa.record_batch({"k1": pa.array([k[0] for k in seen], pa.int64()), "k2": pa.array([k[1] for k in seen], pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})


def _shared(raw: bytes, keep: KeyFilter) -> list[tuple[int, int, tuple[int, int]]]:
    """The text's chunks that may be shared, with their keys."""
    got = [(a, b, _key(raw[a:b])) for a, b in chunks(raw) if b - a >= LEAST]
    if not got:
        return []
    hits = keep.has(np.array([k[0] for _, _, k in got], dtype=np.int64))
    return [x for x, hit in zip(got, hits, strict=True) if hit]


#: A blank between visible ASCII characters: a pre-token starts there, whatever else stands around.
_SURE = re.compile(rb"(?<=[!-~]) (?=[!-~])")
#: Starts of a chunk that are kept for joins, besides its last one, and bytes before a join that are looked through for a sure one.
KEPT, LOOK_BACK = 64, 512


class Chunk:
    """A chunk's own ids, and where its pre-tokens start as far as that holds whatever follows it: the first ones and the last.

    sure: the starts hold whatever stands before the chunk, too.
    """

    def __init__(self, codec_: Codec, ids: np.ndarray, starts: np.ndarray, sure: bool):
        self.ids, self.starts, self.sure = ids, starts.tolist(), sure
        self.raw = codec_.raw(ids)
        self.ends = codec_.lengths[ids].cumsum()

    def between(self, a: int, b: int) -> np.ndarray:
        """The ids of the bytes from a to b, both of them starts of tokens."""
        i, j = self.ends.searchsorted((a, b))
        return self.ids[i + (a > 0) : j + (b > 0)]


def chunk_starts(codec_: Codec, raw: bytes) -> tuple[np.ndarray, bool]:
    """Starts that joins need, and whether they are sure ones. A chunk with several sure starts needs no others."""
    found = [m.start() for m in _SURE.finditer(raw)] if codec_.blanks_are_sure else []
    sure = len(found) > 2
    found = found if sure else codec_.starts(raw).tolist()
    return np.array([*found[:-1][:KEPT], *found[-1:]], dtype=np.int64), sure


def join(codec_: Codec, runs: list[bytes | Chunk]) -> np.ndarray:
    """The ids of a text that is given as runs of text and of chunks."""
    out, before = [], b""  # before: from the last certain start on, not encoded yet
    for run in runs:
        if isinstance(run, bytes):
            before += run
            continue
        # What lies before a sure start near the join needs no repair.
        if len(before) > LOOK_BACK and codec_.blanks_are_sure and (sure := [m.start() for m in _SURE.finditer(before, len(before) - LOOK_BACK)]):
            out.append(codec_.encode(before[: sure[-1]]))
            before = before[sure[-1] :]
        # A chunk without a second start is one pre-token as far as it tells, so it is text.
        agreed = _agree(codec_, before, run) if len(run.starts) > 1 else None
        if agreed is None:
            before += run.raw
            continue
        ids, at = agreed
        last = run.starts[-1]
        out += [ids, run.between(at, last)]
        before = run.raw[last:]
    return np.concatenate([*out, codec_.encode(before)]) if out else codec_.encode(before)


def _agree(codec_: Codec, before: bytes, chunk: Chunk) -> tuple[np.ndarray, int] | None:
    """Ids of `before` and the chunk's bytes up to a start that both have and from which on both have the same ids, and that start; None if there is none."""
    if not before:
        return np.zeros(0, dtype=np.uint32), 0
    n, size, stretch = len(before), len(chunk.raw), STRETCH
    while True:
        to = min(stretch, size)
        if chunk.sure:  # to a sure start behind another one
            to = next((s for s in chunk.starts[1:] if s >= to), chunk.starts[-1])
        else:
            while to < size and chunk.raw[to] & 0xC0 == 0x80:
                to += 1
        text = before + chunk.raw[:to]
        certain = chunk.starts[:-1] if chunk.sure else (codec_.starts(text) - n).tolist()
        ids = codec_.encode(text)
        ends = codec_.lengths[ids].cumsum() - n
        for at in sorted(set(certain) & set(chunk.starts)):
            if 0 <= at < to:
                i = int(ends.searchsorted(at)) + (at > -n)
                # What both say from there on, but for the end of the stretch, where a start isn't certain.
                upto = to if chunk.sure else max([s for s in certain if s < to], default=at)
                j = int(ends.searchsorted(upto)) + (upto > -n)
                if np.array_equal(ids[i:j], chunk.between(at, upto)):
                    return ids[:i], at
        if to >= (chunk.starts[-1] if chunk.sure else size):
            return None
        stretch *= GROWTH


def shared_keys(docs: DataFrame) -> DataFrame:
    """k1, k2 of the chunks that occur more than once in the corpus."""
    counts = docs.select("text").mapInArrow(_count, "k1 long, k2 long, n long")
    return counts.groupBy("k1", "k2").agg(F.sum("n").alias("n")).filter("n > 1")


def encode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), decoded for every row of docs.

    Null and empty texts give no ids. Strings of special tokens in a text become their ids, as in the library.
    Repeated rows are each returned; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer_path or default_tokenizer()) as f:
        contents = spark.sparkContext.broadcast(f.read())
    keep = spark.sparkContext.broadcast(KeyFilter.build(shared_keys(docs), "k1", FILTER_BITS))
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    # Ids are kept in two bytes where the vocabulary allows it.
    narrow = "<u2" if len(codec(contents.value).pieces) <= 1 << 16 else "<u4"

    def finished(ids: np.ndarray) -> tuple[int, bytes, str]:
        return len(ids), ids.astype("<u4").tobytes(), codec(contents.value).decode(ids)

    def record(got: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*got, strict=True)) or [(), (), (), ()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids", "decoded"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without shared chunks, from start to end."""
        codec_, filter_ = codec(contents.value), keep.value
        for batch in batches:
            out = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                if not _shared(raw, filter_):
                    out.append((doc_id, *finished(codec_.encode(raw))))
                if len(out) >= ROWS_OUT:
                    yield record(out)
                    out = []
            yield record(out)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_ = codec(contents.value)
        for batch in batches:
            raws = [b.as_buffer().to_pybytes() for b in batch.column("body")]
            ids = [codec_.encode(x).astype(narrow).tobytes() for x in raws]
            starts = [chunk_starts(codec_, x) for x in raws]
            columns = [pa.array(ids, pa.binary()), pa.array([x.astype("<u2").tobytes() for x, _ in starts], pa.binary()), pa.array([sure for _, sure in starts], pa.bool_())]
            yield pa.record_batch([batch.column("k1"), batch.column("k2"), *columns], ["k1", "k2", "ids", "starts", "sure"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with shared chunks: a row for each run of own text, as it is, and for each shared chunk its key, with its text once a batch."""
        filter_ = keep.value
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        names = ["row", "doc_id", "seq", "k1", "k2", "own"]
        for batch in batches:
            out, told = [], set()
            for row, doc_id, raw in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                got, at = _shared(raw, filter_), 0
                for seq, (a, b, k) in enumerate(got):
                    if a > at:
                        out.append((row, doc_id, 2 * seq, None, None, raw[at:a]))
                    out.append((row, doc_id, 2 * seq + 1, *k, None if k in told else raw[a:b]))
                    told.add(k)
                    at = b
                if got and at < len(raw):
                    out.append((row, doc_id, 2 * len(got), None, None, raw[at:]))
                if len(out) >= 8 * ROWS_OUT:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_ = codec(contents.value)
        for batch in batches:
            out = []
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("runs"), strict=True):
                runs = []
                for own, ids, starts, sure in zip(*(cell.values.field(c) for c in ("own", "ids", "starts", "sure")), strict=True):
                    if own.is_valid:
                        runs.append(own.as_buffer().to_pybytes())
                    else:
                        runs.append(Chunk(codec_, np.frombuffer(ids.as_buffer(), dtype=narrow).astype(np.uint32), np.frombuffer(starts.as_buffer(), dtype="<u2"), sure.as_py()))
                out.append((doc_id, *finished(join(codec_, runs))))
                if len(out) >= ROWS_OUT:
                    yield record(out)
                    out = []
            yield record(out)

    schema = "doc_id long, n_tokens long, ids binary, decoded string"
    whole = rows.select("doc_id", "text").mapInArrow(alone, schema)
    cut = durable(rows.mapInArrow(pieces, "row long, doc_id long, seq int, k1 long, k2 long, own binary"))
    bodies = cut.filter("k1 is not null and own is not null").groupBy("k1", "k2").agg(F.first("own").alias("body"))
    dictionary = bodies.mapInArrow(coded, "k1 long, k2 long, ids binary, starts binary, sure boolean")
    none, flag = F.lit(None).cast("binary"), F.lit(None).cast("boolean").alias("sure")
    placed = cut.filter("k1 is not null").join(dictionary, ["k1", "k2"]).select("row", "doc_id", "seq", none.alias("own"), "ids", "starts", "sure")
    own = cut.filter("k1 is null").select("row", "doc_id", "seq", "own", none.alias("ids"), none.alias("starts"), flag)
    runs = placed.unionByName(own).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "own", "ids", "starts", "sure"))).alias("runs"))
    return whole.unionByName(runs.select("doc_id", "runs").mapInArrow(joined, schema))


def encode_digest(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, from the ids and texts that encode() returns."""
    got = encode(docs, tokenizer_path)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
