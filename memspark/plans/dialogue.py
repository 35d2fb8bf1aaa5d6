"""Turns with sentences that people say, for queries whose rules look for such sentences.

The tables' texts are invented words. Each turn keeps its whole text and gets one of these sentences, chosen by its ids, before or
behind it; every fourth turn asks. In one of five conversations all turns say one sentence again and again, and little else. So cues,
questions, scenes, lasting states, echoes and repeats occur wherever the tables grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCES = (
    "Вчера вечером Анна и Борис обсуждали план и решили перенести встречу на утро",
    "После этого Анна и Борис решили обсудить план ещё раз и перенести встречу",
    "Они снова доверяют друг другу в работе, и Борис поддержал Анну при всей команде",
    "Что они решили после разговора про план",
    "Между ними осталось напряжение, Анна держит дистанцию и осторожна",
    "Анна начала ссору, а Борис сорвался на крик, но они помирились",
    "Что у них сейчас, они уже помирились или нет",
    "Борис прикрыл Анну и помогает ей вместе с фильмом, они снова работают вместе",
    "Анна любит кофе и предпочитает тихие утра",
    "Борис живёт в Самаре и работает врачом",
    "Анна хочет уехать, она устала и тревожится о важном деле",
    "Борис сказал, что они договорились держать друг друга в курсе",
    "Я люблю джаз и старые фильмы",
    "У Анны зелёные глаза, она владеет тремя языками",
    "Борис собирается в Рим и обещает вернуться позже",
    "Как Борис относится к Анне",
    "Yesterday evening Alice and Robert discussed the garden party and decided to move it",
    "Later Alice and Robert decided to discuss the garden party again",
    "I like strong coffee and my favorite garden is quiet",
    "She prefers trains, and Alice loves old maps",
    "Robert is from Norwich and works as a night nurse",
    "Alice is a doctor and has green eyes",
    "Robert is my brother, we trust him and care about Alice",
    "They argued about the conflict and later had a fight",
    "Alice wants to visit Norwich tomorrow, Robert will call",
    "He speaks Latin and she owns a bakery",
    "what did Robert say about the garden",
    "Did Alice and Robert meet at the garden party",
    "понятно",
    "ok",
    "Утром они встретились, и на что они договорились, никто не сказал",
    "Они сотрудничают, но Борис не до конца расслаблен и полагается на Анну",
)


def dialogue(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, role, text of every row of conversations (or rows, such as a stream of it), with a sentence added."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet") if rows is None else rows
    k = F.col("conv_id") * 7 + F.col("turn")
    said = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.pmod(k, F.lit(len(SENTENCES))) + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    both = F.when(k % 3 == 2, F.concat(text, F.lit(" "), said)).otherwise(F.concat(said, F.lit(". "), text))
    asked = F.when(k % 4 == 1, F.lit("?")).otherwise(F.lit(""))
    # The shortest contents of the gate stand alone.
    alone = F.char_length(said) < 12
    turn = F.col("turn")
    again = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.pmod(F.col("conv_id"), F.lit(len(SENTENCES))) + 1).cast("int"))
    again = F.concat(again, F.when(turn % 2 == 1, F.lit(" и ещё раз")).otherwise(F.lit("")), F.when(turn % 3 == 1, F.lit("")).otherwise(F.lit("?")))
    return rows.select("conv_id", "turn", "role", F.when(F.col("conv_id") % 5 == 2, again).when(alone, said).otherwise(F.concat(both, asked)).alias("text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same turns in SQL, under the table's name, so that what is defined over conversations reads them.
SQL = f"""conversations AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 2 THEN again || CASE WHEN turn % 2 = 1 THEN ' и ещё раз' ELSE '' END || CASE WHEN turn % 3 = 1 THEN '' ELSE '?' END WHEN length(said) < 12 THEN said ELSE CASE WHEN k % 3 = 2 THEN t || ' ' || said ELSE said || '. ' || t END || CASE WHEN k % 4 = 1 THEN '?' ELSE '' END END AS text
  FROM (SELECT conv_id, turn, role, conv_id * 7 + turn AS k, coalesce(text, '') AS t, [{", ".join(map(_quoted, SENTENCES))}][(conv_id * 7 + turn) % {len(SENTENCES)} + 1] AS said,
    [{", ".join(map(_quoted, SENTENCES))}][conv_id % {len(SENTENCES)} + 1] AS again FROM main.conversations))"""
