import hashlib
import json

import numpy as np
import pytest
from tokenizers import Tokenizer

from memspark.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def codec():
    with open(bpe.default_tokenizer()) as f:
        return bpe.Codec(f.read())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())


def test_codec_agrees_on_every_character(codec, library):
    for c in map(chr, [*range(0x3100), *range(0xFE00, 0x10000, 7), *range(0x1F300, 0x1F700, 5), *range(0x10000, 0x30000, 997)]):
        text = f"a{c}b {c}{c} {c}1{c}  {c}\n{c}'s{c}"
        ids = library.encode(text, add_special_tokens=False).ids
        got = codec.encode(text.encode())
        assert got.tolist() == ids, hex(ord(c))
        assert codec.decode(got) == library.decode(ids, skip_special_tokens=False)


ODD = [
    "", " ", "a", "x" * 50_000, "a b " * 9000, "  two  spaces  " * 900, "漢字 " * 4000, "漢字かな交じり文。" * 900, "Привет, мир! Как дела? " * 700, "no<|endoftext|>te <|endoftext|> x" * 300, "<|endoftext|>" * 900,
    "don't 's 're we'll " * 500, "a \n\n b\r\n\t c" * 900, "😀👍🏽 é e\u0301 " * 800, " " * 9000 + "x", "मानक हिन्दी " * 900, "'" * 4000 + "s" * 4000,
]


def test_chunks_cover_the_text_between_characters(documents):
    for text in [*ODD, *[r["text"] for r in documents.limit(60).collect()]]:
        raw = text.encode()
        got = bpe.chunks(raw)
        assert [a for a, _ in got] == [0, *[b for _, b in got]][: len(got)] and (not got or got[-1][1] == len(raw))
        assert all(raw[a:b].decode() for a, b in got) and all(b - a <= bpe.MOST + 3 for a, b in got)


def made(codec, raw):
    ids = codec.encode(raw)
    return bpe.Chunk(codec, ids, *bpe.chunk_starts(codec, raw))


@pytest.mark.parametrize("seed", range(3))
def test_repaired_joins_equal_the_whole_encoding(codec, library, documents, seed):
    """Texts cut anywhere between characters, runs of text and chunks mixed at will, also far smaller chunks than the operator cuts."""
    rng = np.random.default_rng(seed)
    for text in [*[x[:6000] for x in ODD], *[r["text"][:20000] for r in documents.limit(40).collect()]]:
        at, runs = 0, []
        while at < len(text):
            to = min(len(text), at + int(rng.integers(1, [12, 90, 1500][seed])))
            piece = text[at:to].encode()
            runs.append(piece if rng.random() < 0.3 else made(codec, piece))
            at = to
        assert bpe.join(codec, runs).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("language", ["latin", "cyrillic", "han"])
def test_joins_keep_the_ids_of_shared_chunks(codec, language, monkeypatch):
    rng = np.random.default_rng(5)
    low, high, gap = {"latin": (97, 123, " "), "cyrillic": (0x430, 0x450, " "), "han": (0x4E00, 0x5E00, "。")}[language]
    word = lambda: "".join(map(chr, rng.integers(low, high, 5)))
    shared = gap.join(word() for _ in range(3000))
    texts = [f"{gap.join(word() for _ in range(k))}{gap}{shared}{gap}{word()}" for k in (37, 501)]
    cuts = [{x[a:b] for a, b in bpe.chunks(x)} for x in (t.encode() for t in texts)]
    same = cuts[0] & cuts[1]
    assert sum(map(len, same)) > 0.8 * len(shared.encode())
    encoded, real = [], codec.encode
    runs = [made(codec, x) if (x := t[a:b]) in same else x for t in [texts[0].encode()] for a, b in bpe.chunks(t)]
    monkeypatch.setattr(codec, "encode", lambda data: encoded.append(len(data)) or real(data))
    ids = bpe.join(codec, runs)
    assert sum(encoded) < 0.5 * len(texts[0].encode())  # the rest came from the chunks
    assert ids.tolist() == real(texts[0].encode()).tolist()


def test_other_rules_are_refused():
    with open(bpe.default_tokenizer()) as f:
        spec = json.load(f)
    bpe.check_spec(spec)
    changes = [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True}), ("pre_tokenizer", {"type": "ByteLevel", "use_regex": False}), ("decoder", None)]
    for field, value in changes:
        with pytest.raises(ValueError):
            bpe.check_spec(spec | {field: value})
    for flag in ("lstrip", "rstrip", "single_word"):
        with pytest.raises(ValueError):
            bpe.check_spec(spec | {"added_tokens": [spec["added_tokens"][0] | {flag: True}]})
    with pytest.raises(ValueError):
        bpe.check_spec(spec | {"added_tokens": [{"content": "<ab", "id": 1}, {"content": "b>", "id": 2}]})


@pytest.mark.parametrize("which", ["odd_docs", "documents", "shared"])
def test_encode(which, request, spark, library):
    if which == "shared":
        passage = " ".join(f"word{k * 7919 % 1000}" for k in range(2000))
        texts = [f"start{i} {passage[: 4000 + 500 * (i % 9)]} end{i} <|endoftext|> {passage[i * 10 :]}" for i in range(60)]
        docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string").repartition(5)
    else:
        docs = request.getfixturevalue(which)
    got = sorted(map(tuple, bpe.encode_digest(docs).collect()))
    assert got == sorted((r["doc_id"], *expected(library, r["text"])) for r in docs.collect())
    assert bpe.encode_digest(docs.limit(0)).count() == 0
    if which == "shared":
        assert bpe.shared_keys(docs).count() > 5
