"""Chat formatting: heterogeneous records to canonical turns, a template, and a loss mask. Only DataFrame operations.

A record is a JSON text. Its nested field paths, without the leaves' types, are hashed; the hash selects a
declarative mapping that says where the turns stand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


@dataclass(frozen=True)
class Mapping:
    """name; the field paths it stands for, as written by field_paths(); (role, field) pairs in order, or the field of an
    array of turns with its role and text fields."""

    name: str
    paths: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: tuple[str, str, str] | None = None


MAPPINGS = (
    Mapping("prompt", "OBJECT<completion, prompt>", (("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", "OBJECT<instruction, output>", (("user", "instruction"), ("assistant", "output"))),
    Mapping("system-instruction", "OBJECT<instruction, output, system>", (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", turns=("messages", "role", "content")),
    Mapping("share", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", turns=("conversations", "from", "value")),
)
#: All fields of all mappings, read in one pass.
RECORD = (
    "prompt string, completion string, instruction string, output string, system string, "
    "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>"
)
ROLE_NAMES = {"human": "user", "gpt": "assistant"}
#: Fixed marks of the template.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
#: A control string without its first character, after "<" and after "[".
AFTER_ANGLE, AFTER_BRACKET = r"(?:/?s>|</?SYS>>)", r"(?:/?INST\]|/?TURN)"


def layout(record: Column) -> Column:
    """The record with empty texts and with equal neighbours in arrays of objects folded into one: the same field paths in few bytes."""
    plain = F.regexp_replace(record, r"\\.", "_")
    bare = F.regexp_replace(plain, r'"([^"]*+)"(\s*+:)|"[^"]*+"', '"$1"$2')
    return F.regexp_replace(bare, r"(\{[^{}]*+\})\s*+,\s*+(?=\1)", "")


def field_paths(record: Column) -> Column:
    """The record's nested field names in order, e.g. OBJECT<messages: ARRAY<OBJECT<content, role>>>; null if it isn't JSON.

    A VARIANT holds 128 MiB at most, so the record's layout is parsed, whose texts are empty.
    """
    shape = F.schema_of_variant(F.try_parse_json(layout(record)))
    return F.regexp_replace(shape, r": (?:[A-Z_]+)(?:\([0-9,]*\))?(?=[,>])", "")


def choose_mapping(fingerprint: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    out = F.lit(None).cast("string")
    for m in mappings:
        out = F.when(fingerprint == F.xxhash64(F.lit(m.paths)), F.lit(m.name)).otherwise(out)
    return out


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _listed(array: Column, mapping: Mapping) -> Column:
    _, role, body = mapping.turns
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])

    def turn(t: Column) -> Column:
        named = _text(t[role])
        if mapping.name == "share":
            named = F.coalesce(names[named], named)
        return F.struct(named.alias("role"), _text(t[body]).alias("text"))

    return F.transform(array, turn)


def canonical_turns(records: DataFrame, key: str = "conv_id", record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """key, schema_fp, mapping, turns array<struct<role, text>>. A layout without a mapping gives a null mapping and no turns."""
    rows = records.select(key, record, F.xxhash64(field_paths(F.col(record))).alias("schema_fp"))
    rows = rows.select(key, "schema_fp", choose_mapping(F.col("schema_fp"), mappings).alias("mapping"), F.from_json(record, RECORD, {"maxStringLen": "2147483647"}).alias("r"))
    turns = F.array().cast("array<struct<role:string,text:string>>")
    for m in mappings:
        if m.turns:
            own = _listed(F.col(f"r.{m.turns[0]}"), m)
        else:
            own = F.array(*[F.struct(F.lit(role).alias("role"), _text(F.col(f"r.{field}")).alias("text")) for role, field in m.fields])
        turns = F.when(F.col("mapping") == m.name, own).otherwise(turns)
    return rows.select(key, "schema_fp", "mapping", turns.alias("turns"))


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string, so none is left."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"(<)(?={AFTER_ANGLE})|(\[)(?={AFTER_BRACKET})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?:(?<=<)\\(?={AFTER_ANGLE})|(?<=\[)\\(?={AFTER_BRACKET}))|\\(\\)", "$1")


def _open_close(role: Column) -> tuple[Column, Column]:
    start, end = F.concat(F.lit("[TURN "), F.hex(role), F.lit("]")), F.lit("[/TURN]")
    for name, (a, b) in MARKS.items():
        start, end = F.when(role == name, F.lit(a)).otherwise(start), F.when(role == name, F.lit(b)).otherwise(end)
    return start, end


def format_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, formatted, spans array<struct<start, length, loss>>: one span a turn, of the escaped text within formatted, in code points.

    Loss is on assistant texts only, without marks. Other roles than system, user and assistant get a mark that names them.
    """
    start, end = _open_close(F.col("role"))
    rows = turns.select(key, F.posexplode_outer("turns").alias("i", "t")).select(key, "i", F.col("t.role").alias("role"), F.col("t.text").alias("text"))
    rows = rows.select(key, "i", "role", start.alias("a"), escape(F.col("text")).alias("body"), end.alias("b"))
    before = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    size = F.char_length("a") + F.char_length("body") + F.char_length("b")
    at = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("a")
    rows = rows.select(key, "i", F.concat("a", "body", "b").alias("piece"), at.alias("start"), F.char_length("body").cast("long").alias("length"), (F.col("role") == "assistant").alias("loss"))
    listed = F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "piece", "start", "length", "loss"))))
    rows = rows.groupBy(key).agg(listed.alias("all"))
    return rows.select(key, F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["loss"].alias("loss"))).alias("spans"))


PIECE = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|\[TURN [0-9A-F]*\].*?\[/TURN\]"


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns array<struct<role, text>> and loss_text, from the formatted text and its spans alone."""
    pieces = F.regexp_extract_all("formatted", F.lit(PIECE), F.lit(0))

    def turn(p: Column) -> Column:
        role, a, b = F.decode(F.unhex(F.regexp_extract(p, r"^\[TURN ([0-9A-F]*)\]", 1)), "UTF-8"), F.locate("]", p), F.lit(7)
        for name, (x, y) in MARKS.items():
            mine = p.startswith(x)
            role, a, b = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, F.lit(len(x))).otherwise(a), F.when(mine, F.lit(len(y))).otherwise(b)
        return F.struct(role.alias("role"), unescape(F.substring(p, a + 1, F.char_length(p) - a - b)).alias("text"))

    rows = formatted.select("*", F.transform(pieces, turn).alias("turns"))
    loss = F.filter(F.arrays_zip("turns", "spans"), lambda x: x["spans"]["loss"])
    return rows.withColumn("loss_text", F.array_join(F.transform(loss, lambda x: x["turns"]["text"]), ""))


def pack_records(rows: DataFrame) -> DataFrame:
    """conv_id, record: turn rows of a conversation as one JSON record in one of the layouts, chosen by its roles and id.

    Rows go by turn; ties by role, then text. Null roles and texts are empty.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    roles = F.array_join(F.transform(F.slice("ts", 1, 4), lambda t: t["role"]), ",")
    text = lambda k: F.get("ts", F.lit(k))["text"]
    messages = F.to_json(F.struct(F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    names = {v: k for k, v in ROLE_NAMES.items()}
    named = lambda c: F.when(c == "user", F.lit(names["user"])).when(c == "assistant", F.lit(names["assistant"])).otherwise(c)
    share = F.to_json(F.struct(F.transform("ts", lambda t: F.struct(named(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations")))
    usual = F.forall("ts", lambda t: t["role"].isin("system", "user", "assistant"))
    even = F.coalesce(F.col("conv_id") % 2 == 0, F.lit(False))
    record = (
        F.when((roles == "user,assistant") & even, F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(roles == "user,assistant", F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when(roles == "system,user,assistant", F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .when(usual & even, share)
        .otherwise(messages)
    )
    return convs.select("conv_id", record.alias("record"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, mapping; all but the last read back from the output."""
    spark = conversations.sparkSession
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    turns = canonical_turns(pack_records(rows))
    unknown = F.raise_error(F.concat(F.lit("no mapping for the record of conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    turns = turns.withColumn("turns", F.when(F.col("mapping").isNull(), unknown).otherwise(F.col("turns")))
    back = read_back(format_turns(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
