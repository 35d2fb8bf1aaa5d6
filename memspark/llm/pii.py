"""Personal data replaced by format-preserving pseudonyms.

Validated numbers and dates, addresses and secrets are permuted within their own format by a keyed Feistel network.
The same value under the same key gives the same pseudonym in every document, however it is punctuated.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
import warnings
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: For tests and examples; real work passes its own secret.
KEY = b"memspark demonstration key"
ROUNDS = 10
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def feistel(value: int, a: int, b: int, tweak: bytes, key: bytes) -> int:
    """A keyed permutation of range(a * b): the two halves are added to in turn by a hash of the other."""
    left, right = divmod(value, b)

    def f(i: int, x: int) -> int:
        return int.from_bytes(blake2b(b"%s|%d|%d|%d|%d" % (tweak, a, b, i, x), key=key[:64], digest_size=32).digest(), "big")

    for i in range(ROUNDS):
        if i % 2 == 0:
            left = (left + f(i, right)) % a
        else:
            right = (right + f(i, left)) % b
    return left * b + right


def permute_symbols(values: list[int], radices: list[int], tweak: bytes, key: bytes) -> list[int]:
    """A keyed permutation of all sequences with these radices."""
    half = len(radices) // 2
    a, b = 1, 1
    for r in radices[:half]:
        a *= r
    for r in radices[half:]:
        b *= r
    number = 0
    for v, r in zip(values, radices, strict=True):
        number = number * r + v
    number = feistel(number, a, b, tweak, key)
    out = []
    for r in reversed(radices):
        number, v = divmod(number, r)
        out.append(v)
    return out[::-1]


@lru_cache(4096)
def script_class(x: str) -> str | None:
    """The letters or digits that a character beyond ASCII moves among: those of its kind in its row of 256, or all of the row where it is alone."""
    if x.isascii() or not x.isalnum():
        return None
    row = [chr(c) for c in range(ord(x) & ~0xFF, (ord(x) & ~0xFF) + 256) if chr(c).isalnum() and c > 127]
    kind = "".join(c for c in row if unicodedata.category(c) == unicodedata.category(x))
    return kind if len(kind) > 1 else "".join(row)


def permute_text(text: str, tweak: bytes, key: bytes, classes: tuple[str, ...] = (DIGITS, LOWER, UPPER), scripts: bool = False) -> str:
    """Each character moves within its class; characters outside the classes stay. scripts: letters and digits beyond ASCII move too."""
    own = [next((c for c in classes if x in c), script_class(x) if scripts else None) for x in text]
    places = [i for i, c in enumerate(own) if c]
    moved = permute_symbols([own[i].index(text[i]) for i in places], [len(own[i]) for i in places], tweak, key)
    out = list(text)
    for i, v in zip(places, moved, strict=True):
        out[i] = own[i][v]
    return "".join(out)


def put_digits(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if x in DIGITS else x for x in text)


def only_digits(text: str) -> str:
    return "".join(x for x in text if x in DIGITS)


def luhn_sum(digits: str) -> int:
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(digits)))


def card(text: str, key: bytes) -> str | None:
    """13 to 19 digits with a right check digit; the pseudonym has one too."""
    d = only_digits(text)
    if not 13 <= len(d) <= 19 or luhn_sum(d) % 10 or len(set(d)) == 1:
        return None
    body = permute_text(d[:-1], b"card", key)
    return put_digits(text, body + str(-luhn_sum(body + "0") % 10))


def iban_check(country: str, bban: str) -> str:
    number = int("".join(str(int(x, 36)) for x in bban + country + "00"))
    return f"{98 - number % 97:02d}"


def iban(text: str, key: bytes) -> str | None:
    """Right check digits; country and layout stay."""
    plain = text.replace(" ", "")
    country, check, bban = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or iban_check(country, bban) != check:
        return None
    moved = permute_text(bban, b"iban" + country.encode(), key)
    it = iter(country + iban_check(country, moved) + moved)
    return "".join(x if x == " " else next(it) for x in text)


def ssn(text: str, key: bytes) -> str | None:
    def right(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    d = only_digits(text)
    if not right(d):
        return None
    d = permute_text(d, b"ssn", key)
    while not right(d):  # walk the permutation's cycle back into the format
        d = permute_text(d, b"ssn", key)
    return put_digits(text, d)


def phone(text: str, key: bytes) -> str | None:
    """8 to 15 digits after a plus; the first digit of the country code stays."""
    d = only_digits(text)
    return put_digits(text, d[0] + permute_text(d[1:], b"phone" + d[:1].encode(), key)) if 8 <= len(d) <= 15 else None


def national(text: str, key: bytes) -> str | None:
    """Without a country code: ten digits have the pseudonym they have after +1; behind a leading zero all others move."""
    d = only_digits(text)
    if d[0] == "0":
        return put_digits(text, "0" + permute_text(d[1:], b"phone0", key)) if 8 <= len(d) <= 12 else None
    return put_digits(text, d[:-10] + permute_text(d[-10:], b"phone1", key)) if len(d) in (10, 11) else None


def address(text: str, key: bytes) -> str | None:
    """IPv4: four numbers up to 255."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return ".".join(map(str, permute_symbols([int(p) for p in parts], [256] * 4, b"ipv4", key)))


def day(text: str, key: bytes) -> str | None:
    """Real days from 1900 to 2099 with -, / or ., year first or last, a day's pseudonym being the same in all. Year last: d/m/y, or m/d/y where that is no day."""
    parts, sign = re.split(r"[-/.]", text), re.search(r"[-/.]", text)[0]
    first = len(parts[0]) == 4
    for order in ((0, 1, 2),) if first else ((2, 1, 0), (2, 0, 1)):
        y, m, d = (parts[i] for i in order)
        try:
            n = (dt.date(int(y), int(m), int(d)) - FIRST_DAY).days
            break
        except ValueError:
            continue
    else:
        return None
    days = (LAST_DAY - FIRST_DAY).days + 1
    if not 0 <= n < days:
        return None
    a = 271
    b = -(-days // a)
    n = feistel(n, a, b, b"day", key)
    while n >= days:
        n = feistel(n, a, b, b"day", key)
    got = FIRST_DAY + dt.timedelta(n)
    out = [f"{got.year:04d}", f"{got.month:0{len(m)}d}", f"{got.day:0{len(d)}d}"]
    return sign.join(out[order.index(i)] for i in range(3))


def mail(text: str, key: bytes) -> str | None:
    """The part before the @ is permuted by itself, letters of all scripts, so an address keeps its domain."""
    name, _, domain = text.rpartition("@")
    return f"{permute_text(name, b'mail' + domain.lower().encode(), key, scripts=True)}@{domain}"


def secret(text: str, key: bytes) -> str | None:
    hexadecimal = all(x in HEX for x in text)
    return permute_text(text, b"secret", key, (HEX,) if hexadecimal else (DIGITS, LOWER, UPPER))


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}
#: Digits after the country code, where a country's numbers have a fixed length.
PHONE_LENGTHS = {"1": 10, "7": 10, "30": 10, "33": 9, "34": 9, "41": 9, "45": 8, "47": 8, "48": 9, "91": 10, "351": 9, "380": 9, "420": 9}
#: Groups in which cards are usually written; tried before other groupings, so a number beside a card is not taken for its part.
CARD_GROUPS = {*((n,) for n in range(13, 20)), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3), (4, 4, 4, 4, 3)}
#: First digits of payment cards.
ISSUER = re.compile("[3-6]|2[2-7]")


def card_spans(m: re.Match) -> Iterator[tuple[int, int]]:
    """Whole groups of a run of digits that make up 13 to 19 of them with a right check digit: usual groupings first, then from each start the longest first.

    The longest windows one after the other may be grouped in any way. Others need an issuer's first digit and, but for the last, groups of 4 digits
    or a usual grouping: one in ten windows has a right check digit, so nearly every list of small numbers would be hit.
    """
    text, groups = m.string, [x.span() for x in re.finditer("[0-9]+", m[0])]
    groups = [(m.start() + a, m.start() + b) for a, b in groups]
    if re.match(r"[\w.+-]", text[m.start() - 1 : m.start()]):
        groups = groups[1:]
    if re.match(r"[\w-]|\.[0-9]", text[m.end() : m.end() + 2]):
        groups = groups[:-1]
    usual, other, chained = [], [], 0
    for i in range(len(groups)):
        sizes, windows = [], []
        for a, b in groups[i : i + 19]:
            sizes.append(b - a)
            if sum(sizes) > 19:
                break
            if sum(sizes) >= 13:
                windows.append((tuple(sizes), (groups[i][0], b)))
        if windows and i >= chained:
            chain, chained = windows[-1], i + len(windows[-1][0])
        else:
            chain = None
        for sizes, (a, b) in reversed(windows):
            likely = ISSUER.match(text, a) and (sizes in CARD_GROUPS or min(sizes[:-1]) >= 4)
            if (likely or (sizes, (a, b)) == chain or len(sizes) == 1) and luhn_sum(only_digits(text[a:b])) % 10 == 0:
                (usual if sizes in CARD_GROUPS else other).append((a, b))
    yield from usual
    yield from other


_NAME = re.compile(r"[\w.+%-]")


def mail_spans(m: re.Match) -> Iterator[tuple[int, int]]:
    """The address whose domain was found: its name is the run before the @, marks on letters included, from the first letter or digit on. Runs end at an @, so all of them are read once."""
    text, a = m.string, m.start()
    while a > 0 and (_NAME.match(text, a - 1) or unicodedata.category(text[a - 1])[0] == "M"):
        a -= 1
    while a < m.start() and not text[a].isalnum():
        a += 1
    if a < m.start():
        yield a, m.end()


def iban_spans(m: re.Match) -> Iterator[tuple[int, int]]:
    """From the start of a possible IBAN to the length of its country; where that is unknown, all lengths, longest first."""
    ends = [m.start(1) + i + 1 for i, x in enumerate(m[1]) if x != " "]
    known = IBAN_LENGTHS.get(m[1][:2])
    for n in (known,) if known else range(34, 14, -1):
        if n <= len(ends) and not re.match(r"\w", m.string[ends[n - 1] : ends[n - 1] + 1]):
            yield m.start(1), ends[n - 1]


def phone_spans(m: re.Match) -> Iterator[tuple[int, int]]:
    """To the country's length, if a group of digits ends there; else the most groups that a number may have."""
    ends = [m.start() + x.end() for x in re.finditer("[0-9]+", m[0])]
    sizes = {b: len(only_digits(m.string[m.start() : b])) for b in ends}
    code = next((c for c in (only_digits(m[0])[:n] for n in (3, 2, 1)) if c in PHONE_LENGTHS), None)
    fixed = [b for b in ends if code and sizes[b] == len(code) + PHONE_LENGTHS[code]]
    yield from ((m.start(), b) for b in fixed or [b for b in reversed(ends) if sizes[b] <= 15][:1])


#: Numbers with a zero for the country code: 030 1234567, (030) 123 4567, 020 7946 0958, 01 23 45 67 89.
TRUNK = r"\(0[0-9]{1,4}\) ?[0-9]{3,4}[ -]?[0-9]{3,4}|0[0-9]{2,4}[ /-][0-9]{6,8}|0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}|0[1-9](?:[ .-][0-9][0-9]){4}"
#: Kind, pattern, group that is replaced, pseudonym (None: not valid, left alone). Earlier ones win where they overlap.
DETECTORS: tuple[tuple[str, re.Pattern, int, Callable[[str, bytes], str | None]], ...] = (
    ("email", re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"), 0, mail),
    ("secret", re.compile(r"(?i)(?<![^\W_])(?:token|secret|password|passwd|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_-]{12,})"), 1, secret),
    ("iban", re.compile(r"\b(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))"), 1, iban),
    ("card", re.compile(r"[0-9](?:[ -]?[0-9]){12,}"), 0, card),
    ("phone", re.compile(r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?!\w)"), 0, phone),
    ("phone", re.compile(rf"(?<![\w+.)/-])(?:(?:1[ .-])?(?:\([2-9][0-9][0-9]\) ?|[2-9][0-9][0-9][ .-])[2-9][0-9][0-9][ .-][0-9]{{4}}|{TRUNK})(?![\w/-]|\.[0-9])"), 0, national),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), 0, ssn),
    ("ipv4", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"), 0, address),
    ("date", re.compile(r"(?<![\w./-])(?:[0-9]{4}([/-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([/.-])[0-9]{1,2}\2[0-9]{4})(?=T[0-9])|(?<![\w./-])(?:[0-9]{4}([/-])[0-9]{1,2}\3[0-9]{1,2}|[0-9]{1,2}([/.-])[0-9]{1,2}\4[0-9]{4})(?![\w/-]|\.[0-9])"), 0, day),
)
#: Kinds whose pattern gives a run in which the value is looked for; the others' values are the group itself.
SPANS: dict[str, Callable[[re.Match], Iterator[tuple[int, int]]]] = {"email": mail_spans, "iban": iban_spans, "card": card_spans, "phone": phone_spans}


class Taken:
    """Disjoint places in a text; whether another one is free takes a search, not a pass over all."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.places: list[tuple[int, int, str, str]] = []

    def free(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b)
        return at == 0 or self.places[at - 1][1] <= a

    def add(self, a: int, b: int, kind: str, pseudonym: str) -> None:
        at = bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.places.insert(at, (a, b, kind, pseudonym))


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of what is replaced, in order."""
    possible = {"email": "@" in text, "secret": "=" in text or ":" in text}
    digits = re.search("[0-9]", text) is not None
    taken = Taken()
    for kind, pattern, group, pseudonym in DETECTORS:
        if not possible.get(kind, digits):
            continue
        for m in pattern.finditer(text):
            for a, b in SPANS[kind](m) if kind in SPANS and pseudonym is not national else (m.span(group),):
                if taken.free(a, b) and (got := pseudonym(text[a:b], key)) is not None:
                    taken.add(a, b, kind, got)
    return taken.places


def replace(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for a, b, _, got in found:
        out += [text[at:a], got]
        at = b
    return "".join([*out, text[at:]])


#: Session setting that holds the secret, as text. Spark redacts settings of such names in its pages and logs.
KEY_SETTING = "spark.memspark.pii.secret"


def session_key(spark: SparkSession) -> bytes:
    """The secret that the session's settings give; without one the demonstration key, under which pseudonyms are no protection, and a warning."""
    given = spark.conf.get(KEY_SETTING, None)
    if not given:
        warnings.warn(f"{KEY_SETTING} is not set: the demonstration key is used, under which pseudonyms are no protection", stacklevel=2)
        return KEY
    return given.encode()


def pseudonymise(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """docs with text_col replaced and a column pii array<struct<start, length, kind>> of places in the old text.

    Null texts stay null with no places. All other columns and rows stay as they are; an empty table gives an empty result.
    """
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                i, new, places = batch.schema.get_field_index(text_col), [], []
                for text in batch.column(i).to_pylist():
                    found = find(text, key) if text else []
                    new.append(replace(text, found) if found else text)
                    places.append([{"start": a, "length": b - a, "kind": k} for a, b, k, _ in found])
                columns = [pa.array(new, pa.string()) if j == i else c for j, c in enumerate(batch.columns)]
                yield pa.record_batch([*columns, pa.array(places, found_type)], [*batch.schema.names, "pii"])

    docs = docs.drop("pii")
    place = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("kind", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("pii", T.ArrayType(place))])
    return docs.mapInArrow(run, schema)


def pii_digest(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text (pseudonymised), n_found, kinds for every row."""
    got = pseudonymise(docs.select("doc_id", "text"), key)
    return got.select("doc_id", "text", F.size("pii").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"]))), ",").alias("kinds"))
