import datetime as dt
import ipaddress
import random
import re
import time
from hashlib import blake2b

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import pii, topk, toxicity

# Top-k


def brute_top(rows, k):
    """By row: (query id, its place) -> scores with ids, best first."""
    ok = [(n, i, np.floor(64 * np.array(v, dtype=np.float64)).astype(object)) for n, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i is not None and i % 20 == 0:
            best = sorted((-int(q @ c), -1 if j is None else j) for m, j, c in ok if m != n and len(c) == len(q))[:k]
            out += [(i, r + 1, None if j == -1 else j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("dim", [1, 5, 64, 70])
def test_top_k(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + [(440, [float("nan")] * dim), (441, [None] * dim), (460, None), (461, []), (480, [float("inf")] * dim), (500, [1.0] * (dim + 1)), (501, [2.0] * (dim + 1)), (502, [1e5] * dim), (502, [1e5] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    got = sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()), key=str)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute_top(rows, 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_drop_candidates(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(8, 1, 64)) * 20
    x = np.concatenate([b + rng.normal(size=(60, 64)) for b in base]).round().astype(np.int64)
    for segments in (1, 8, 32, 64):
        s = topk.statistics(x.astype(float), segments)
        assert (s @ s.T + 1e-6 >= topk.exact(x, x)).all()
    big = np.full((2, 3), 2**30)
    assert topk.exact(big, big).tolist() == [[3 * 2**60] * 2] * 2


def test_scores_beyond_64_bits_are_the_nearest_long(spark):
    big = 2.0**40
    rows = [(0, [big, big, 1.0]), (1, [big, big, 1.0]), (2, [-big, -big, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1e300, 0.0, 0.0]), (20, [3e9, 1.0, 1.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()}
    assert got[0, 1] == topk.LONGEST and got[0, 2] == -topk.LONGEST and got[0, 4] == topk.LONGEST and got[0, 3] == 2**46 * 64
    assert got[20, 3] == int(3e9) * 64 * 64 and len(got) == 10


def test_block_pairs_out_of_reach_are_dropped(spark, monkeypatch):
    """Vectors in clusters: results stay right, and far fewer rows meet than without envelopes."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 4)).repeat(8, axis=1) * 40
    rows = [(i, [float(np.float32(x)) for x in centers[i % 12] * (0.2 if i % 5 else 1.0) + rng.normal(size=32)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    got = sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()), key=str)
    assert got == brute_top(rows, 20)
    lo = np.array([[-1.0, 2.0], [0.5, -3.0]])
    names = [f"{n}_{w}{i}" for n in "ab" for i in range(2 * topk.LEVELS[0]) for w in ("lo", "hi")]
    values = [float(x) for n in (0, 1) for i in range(2 * topk.LEVELS[0]) for x in (lo[n][i % 2] - 1, lo[n][i % 2] + 1)]
    reach = spark.createDataFrame([values], names).select(topk._reach("a", "b")).first()[0]
    inside = [sum((lo[0][i % 2] + rng.uniform(-1, 1)) * (lo[1][i % 2] + rng.uniform(-1, 1)) for i in range(2 * topk.LEVELS[0])) for _ in range(500)]
    assert max(inside) <= reach


# Personal data


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


TEXTS = {
    1: "card 4539 1488 0343 6467 and 4539148803436467, not 4539148803436468",
    2: "mail jöhn.doe99@mail7.example.com, jane@x.org. On 2021-02-28, 28/02/2021, 28.2.2021; not 2021-02-30 nor 31.04.2021",
    3: "call +1 (017) 555-7713 or +1 017 555 7713. ip 97.51.17.173 not 300.1.1.1 nor 1.2.3.4.5; ssn 078-05-1120 not 666-12-3456",
    4: "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not GB83WEST12345698765432",
    5: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here, version 1.2.3, phone 12, year 2024',
    6: "clean text with 3 numbers, 42 and 1000000; a@b and @home.",
    7: None,
    8: "",
}


def test_pseudonyms(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS.items()], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs).collect()}
    assert {i: [p["kind"] for p in got[i]["pii"]] for i in got} == {
        1: ["card"] * 2, 2: ["email"] * 2 + ["date"] * 3, 3: ["phone"] * 2 + ["ipv4", "ssn"], 4: ["iban"] * 2, 5: ["secret"], 6: [], 7: [], 8: [],
    }
    assert all(got[i]["text"] == TEXTS[i] for i in (6, 7, 8)) and got[1]["kind"] == "x"
    text = {i: got[i]["text"] for i in got}
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", text[1])
    assert cards[0].replace(" ", "") == cards[1] != "4539148803436467" and luhn(cards[1]) and cards[2] == "4539148803436468"
    dates = re.search(r"On (\d{4}-\d\d-\d\d), (\d\d/\d\d/\d{4}), (\d+\.\d+\.\d{4}); not 2021-02-30 nor 31.04.2021", text[2]).groups()
    days = {dt.date.fromisoformat(dates[0]), dt.datetime.strptime(dates[1], "%d/%m/%Y").date(), dt.datetime.strptime(dates[2], "%d.%m.%Y").date()}
    assert len(days) == 1 and days != {dt.date(2021, 2, 28)}
    assert "@mail7.example.com" in text[2] and "jane@" not in text[2]
    phones = re.findall(r"\+1[ \d()-]{11,15}\d", text[3])
    assert pii.only_digits(phones[0]) == pii.only_digits(phones[1]) != "10175557713"
    assert "97.51.17.173" not in text[3] and "300.1.1.1" in text[3] and "1.2.3.4.5" in text[3] and "666-12-3456" in text[3] and "078-05-1120" not in text[3]
    for found in re.findall(r"[DG][EB]\d\d[ A-Z0-9]{18,23}", text[4])[:2]:
        plain = found.replace(" ", "")[:22]
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert re.search(r'token = "[0-9a-f]{40}" here, version 1.2.3', text[5]) and "04dbebab" not in text[5]
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, key=b"another").collect()}
    assert all(other[i] != text[i] for i in range(1, 6))
    assert pii.pseudonymise(docs.limit(0)).count() == 0


def replaced(text):
    return [(text[a:b], kind) for a, b, kind, _ in pii.find(text, pii.KEY)]


def test_values_beside_numbers_and_words_go():
    card = "4111 1111 1111 1111"
    for text in (card + " 12/27", "order 12 " + card, card + " 123 45", f"12 {card} 34 {card}", card.replace(" ", "-") + " 50 euro", card.replace(" ", "") + " 123"):
        got = replaced(text)
        assert len(got) == text.replace(" ", "").replace("-", "").count("4111111111111111")
        assert all(kind == "card" and pii.only_digits(v) == pii.only_digits(card) for v, kind in got)
    assert replaced("BE68 5390 0754 7034 PAID") == [("BE68 5390 0754 7034", "iban")] and replaced("BE68539007547034 EUR 50") == [("BE68539007547034", "iban")]
    assert replaced("+1 (017) 555-7713 12") == [("+1 (017) 555-7713", "phone")] == replaced("+1 (017) 555-7713 1234 5678")
    assert replaced("+33 123 45 67 89 20") == [("+33 123 45 67 89", "phone")]


def test_secrets_of_letters_go_without_digits_in_the_text():
    assert replaced("password: correcthorsebatterystaple") == [("correcthorsebatterystaple", "secret")]
    one, two = (pii.replace(t, pii.find(t, pii.KEY)) for t in ("password: correcthorsebatterystaple", "7 password: correcthorsebatterystaple"))
    assert two == "7 " + one


def test_usual_formats_go():
    same = ["1990-05-17T00:00:00Z", "1990/05/17", "17-05-1990", "05/17/1990", "5-17-1990", "17.5.1990"]
    found = [pii.find(t, pii.KEY) for t in same]
    assert all(len(f) == 1 and f[0][2] == "date" for f in found)
    assert len({frozenset(map(int, re.findall(r"\d+", f[0][3]))) for f in found}) == 1 and "1990" not in found[0][0][3]
    assert pii.replace(same[0], found[0]).endswith("T00:00:00Z")
    for text in ("1990-05/17", "17-05-1990-3", "31-04-2021", "99/99/2021", "1990-05-17Today"):
        assert replaced(text) == []
    phones = ["(212) 555-1234", "212-555-1234", "212.555.1234", "1-212-555-1234", "+1 212 555 1234"]
    assert all(replaced(f"call {t} now") == [(t, "phone")] for t in [*phones, "030 1234567", "020 7946 0958", "01 23 45 67 89"])
    assert len({pii.only_digits(pii.find(t, pii.KEY)[0][3])[-10:] for t in phones}) == 1
    for name in ("access_token=", "client_secret = ", "AWS_SECRET: ", "x-api-key: "):
        assert replaced(name + "abcdefghijklmnop") == ([("abcdefghijklmnop", "secret")])
    assert replaced("mytoken=abcdefghijklmnop") == []


def test_number_lists_are_mostly_left():
    rng = random.Random(1)
    lists = [" ".join(str(rng.randrange(10, 100)) for _ in range(20)) for _ in range(300)]
    assert sum(bool(replaced(x)) for x in lists) < 0.25 * len(lists)


def test_digits_of_other_scripts_are_no_numbers():
    for text in ("Room 5, id ١٢٣-٤٥-٦٧٨٩ ok", "٤٥٣٩ ١٤٨٨ ٠٣٤٣ ٦٤٦٧ 1", "on ٢٠٢١-٠٢-٢٨ at 7", "ip ٩٧.٥١.١٧.١٧٣ 1", "+١ ٠١٧ ٥٥٥ ٧٧١٣ 1", "१२३-४५-६७८९ 1"):
        assert replaced(text) == []


def test_names_in_all_scripts_go():
    for address in ("иван@example.com", "李雷@example.com", "Ωmega.β@x.org", "jöhn@x.org", "महेश७@x.org"):
        (place,) = pii.find(f"to {address}.", pii.KEY)
        name, domain = place[3].split("@")
        assert place[2] == "email" and domain == address.split("@")[1] and name != address.split("@")[0] and len(name) == len(address.split("@")[0])
        assert [c.isalnum() for c in name] == [c.isalnum() for c in address.split("@")[0]]
    small = [pii.permute_text(x, b"t", b"k", scripts=True) for x in "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
    assert len(set(small)) == 32


def test_many_values_and_long_runs_take_linear_time():
    began = time.process_time()
    assert len(replaced(" ".join(f"user{i}@mail{i}.example.com" for i in range(8000)))) == 8000
    assert replaced("a" * 1_000_000 + " @") == [] and len(replaced("1 " * 300_000)) >= 0 and replaced("x@" * 200_000) == []
    assert time.process_time() - began < 12


def unfeistel(value, a, b, tweak, key):
    """The rounds in reverse order, subtracting what feistel() adds."""
    left, right = divmod(value, b)
    f = lambda i, x: int.from_bytes(blake2b(b"%s|%d|%d|%d|%d" % (tweak, a, b, i, x), key=key[:64], digest_size=32).digest(), "big")
    for i in reversed(range(pii.ROUNDS)):
        if i % 2 == 0:
            left = (left - f(i, right)) % a
        else:
            right = (right - f(i, left)) % b
    return left * b + right


def test_pseudonyms_can_be_undone_with_the_key_alone():
    rng = random.Random(3)
    for a, b in ((10, 10), (26**3, 26**4), (271, 270), (1, 50), (256**2, 256**2)):
        for _ in range(20):
            n = rng.randrange(a * b)
            assert unfeistel(pii.feistel(n, a, b, b"tweak", b"key"), a, b, b"tweak", b"key") == n


def brute_found(text):
    """Planted kinds found another way: word by word, each tried whole and without what stands around it."""
    out = []
    for word in (text or "").split():
        word = word.strip(".,;:!?()[]\"'<>%&#$*")
        if re.fullmatch(r"\w[\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+", word):
            out.append("email")
        elif word.count(".") == 3 and all(p.isdecimal() and p.isascii() for p in word.split(".")):
            try:
                ipaddress.IPv4Address(word)
                out.append("ipv4")
            except ValueError:
                pass
        elif word.isdecimal() and word.isascii() and 13 <= len(word) <= 19 and luhn(word) and len(set(word)) > 1:
            out.append("card")
    return out


def test_found_values_equal_a_search_word_by_word(documents):
    kinds = ("email", "ipv4", "card")
    for r in documents.collect():
        text = r["text"] or ""
        got = sorted(k for a, b, k, _ in pii.find(text, pii.KEY) if k in kinds and not re.search(r"\s", text[a:b]))
        assert got == sorted(brute_found(text)), text[:200]


def test_permutations_are_one_to_one():
    assert len({pii.permute_text(f"{n:03d}", b"t", b"k") for n in range(1000)}) == 1000
    assert len({pii.feistel(n, 7, 11, b"t", b"k") for n in range(77)}) == 77
    days = {pii.day((pii.FIRST_DAY + dt.timedelta(n)).isoformat(), b"k") for n in range(0, 73049, 7)}
    assert len(days) == len(range(0, 73049, 7)) and all(pii.FIRST_DAY <= dt.date.fromisoformat(d) <= pii.LAST_DAY for d in days)


def test_planted_values_go(documents):
    got = pii.pii_digest(documents).collect()
    old = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(got) == len(old) and sum(r["n_found"] for r in got) > 10
    for r in got:
        for m in re.findall(r"\S+@\S+\.com|\+1 \(\d{3}\) 555-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b", old[r["doc_id"]]):
            assert m not in r["text"]
        for m in re.findall(r"\b\d{16}\b", old[r["doc_id"]]):
            assert (m in r["text"]) != luhn(m)
        assert r["n_found"] or r["text"] == old[r["doc_id"]]


def test_the_session_gives_the_key(spark):
    assert pii.session_key(spark) == pii.KEY
    spark.conf.set(pii.KEY_SETTING, "another secret")
    try:
        assert pii.session_key(spark) == b"another secret"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_odd_documents_keep_rows(odd_docs):
    assert sorted(map(str, pii.pseudonymise(odd_docs).drop("pii").collect())) == sorted(map(str, odd_docs.collect()))


# Toxicity


def made_up(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(3, 200))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(["idiot", "Scum", "WORTHLESS", "nastyword"])
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = made_up(3000, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string, toxicity string")
    known = spark.createDataFrame(labels[:2000] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.classify(df, known).collect()}
    held = [(got[i]["toxic"], bool(t)) for i, _, t in labels[2000:]]
    assert sum(a == b for a, b in held) > 0.98 * len(held)
    insult = [got[i]["p_insult"] for i, t, _ in docs if "idiot" in t]
    assert np.mean(insult) > 0.8 > 0.1 > np.mean([got[i]["p_insult"] for i, t, _ in docs if "idiot" not in t])


def test_later_links_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    docs, words = np.repeat(np.arange(800), 4), rng.integers(0, 40, 3200)
    first = np.zeros(800, bool)
    first[docs[words < 4]] = True
    chain, _ = toxicity.fit_arrays(docs, words, {"a": first, "b": first})
    assert chain.links[1].before[0] > 0.5 and len(chain.links[0].before) == 0


def brute_chain(texts, labels, seeds):
    """The chain over dense tables: one column a word, plain gradient steps until nothing moves. texts, labels: in the order of the folds."""
    words = [set(toxicity.word_hashes(x, {}).tolist()) for x in texts]
    every = sorted(set().union(*words))
    x = np.array([[h in w for h in every] for w in words], dtype=float)
    wanted = {name: np.array([bool(w & set(toxicity.word_hashes(" ".join(s), {}).tolist())) for w in words]) & labels for name, s in seeds.items()} | {"toxic": labels}

    def fit(rows, before, y):
        n, pos = len(rows), y[rows].sum()
        if pos in (0, n):
            rate = (pos + 0.5) / (n + 1)
            return np.zeros(len(every)), np.zeros(before.shape[1]), np.log(rate / (1 - rate))
        held, hit = x[rows].sum(0), x[rows][y[rows] > 0].sum(0)
        due = held * pos / n
        chi = np.where(held >= 5, (hit - due) ** 2 / np.maximum(due * (1 - pos / n), 1e-9), 0)
        best = [j for j in sorted(range(len(every)), key=lambda j: (-chi[j], j))[: toxicity.WORDS] if chi[j] > 6.6]
        z = np.column_stack((x[rows][:, best], before[rows], np.ones(n)))
        beta, t = np.zeros(z.shape[1]), y[rows].astype(float)
        weight = np.array([toxicity.L2] * (z.shape[1] - 1) + [0.0])
        for _ in range(200):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            beta -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(weight + 1e-12), z.T @ (p - t) + weight * beta)
        full = np.zeros(len(every))
        full[best] = beta[: len(best)]
        return full, beta[len(best) : -1], beta[-1]

    def predict(model, rows, before):
        return 1 / (1 + np.exp(-(x[rows] @ model[0] + before[rows] @ model[1] + model[2])))

    before, final = np.zeros((len(texts), 0)), np.zeros((len(texts), 0))
    for y in wanted.values():
        own, rows = np.zeros(len(texts)), np.arange(len(texts))
        for k in range(toxicity.FOLDS):
            own[rows % toxicity.FOLDS == k] = predict(fit(rows[rows % toxicity.FOLDS != k], before, y), rows % toxicity.FOLDS == k, before)
        final = np.column_stack((final, predict(fit(rows, before, y), rows, final)))
        before = np.column_stack((before, own))
    return final


def test_probabilities_equal_dense_models(spark):
    docs, labels = made_up(600, 4)
    df = spark.createDataFrame(docs, "doc_id long, text string, other string")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    place = np.random.default_rng(7).permutation(len(docs))
    order = np.argsort(place)
    expected = brute_chain([docs[i][1] for i in order], np.array([labels[i][2] > 0 for i in order]), toxicity.SEEDS)
    for name, column in zip([*toxicity.SEEDS, "toxic"], expected.T, strict=True):
        assert np.abs(np.array([got[i][f"p_{name}"] for i in order]) - column).max() < 0.02, name


def test_of_rows_that_share_an_id_the_same_one_counts(spark):
    docs, labels = made_up(300, 6)
    twice = [*docs, *[(i, t[::-1], "x") for i, t, _ in docs[:50]]]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chains = [toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, other string").repartition(n), known) for rows, n in ((twice, 2), (twice[::-1], 7))]
    assert chains[0] == chains[1]


def test_few_or_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    clean = spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, clean, one):
        got = toxicity.classify(odd_docs, labels).collect()
        assert len(got) == odd_docs.count()
        assert labels is one or not any(r["toxicity"]["toxic"] for r in got)
    assert toxicity.classify(no_docs, clean).count() == 0


def test_the_secret_comes_from_the_session_and_its_absence_is_told(spark):
    assert pii.KEY_SETTING.endswith("secret")
    with pytest.warns(UserWarning, match="demonstration key"):
        assert pii.session_key(spark) == pii.KEY
    spark.conf.set(pii.KEY_SETTING, "s3")
    try:
        assert pii.session_key(spark) == b"s3"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_the_sample_is_fitted_off_the_driver(spark, monkeypatch):
    rows = [(i, f"word{i % 7} {'stupid fool' if i % 3 == 0 else 'kind friend'} text{i}") for i in range(60)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    taken, real = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: taken.append(real(self)) or taken[-1])
    chain = toxicity.fit(docs, known)
    assert [got.num_rows for got in taken] == [1] and chain.predict(toxicity.word_hashes("stupid fool", {}))[-1] > 0.5
    assert toxicity.fit(docs, known.filter("toxic is null")) is None
