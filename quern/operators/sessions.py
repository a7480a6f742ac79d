"""Conversations: turns out of stored JSON, bounded history, titles, follow-ups, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "array<struct<query: string, answer: string, intent: string, sources: array<struct<filename: string, page: bigint, score: double>>, timestamp: string>>"


def turns(sessions: DataFrame) -> DataFrame:
    """(session_id, updated_at, turn, query, answer, intent, sources, timestamp); sessions whose JSON is broken have no turns."""
    whole = sessions.filter(F.try_parse_json("entries").isNotNull())
    t = whole.select("session_id", "updated_at", F.posexplode(F.from_json("entries", SCHEMA)).alias("turn", "t"))
    return t.select("session_id", "updated_at", F.col("turn").cast("bigint").alias("turn"), "t.*")


def last_turns(t: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    return t.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n).drop("age")


def summaries(t: DataFrame, keep: int = 10) -> DataFrame:
    """(session_id, title, turns, updated_at): the title is the first question that is kept."""
    return last_turns(t, keep).groupBy("session_id").agg(F.min_by("query", "turn").alias("title"), F.count("*").alias("turns"), F.max("updated_at").alias("updated_at"))


def with_previous(t: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("turn")
    return t.withColumn("last_query", F.lag("query").over(w)).withColumn("last_answer", F.lag("answer").over(w))


def markdown(t: DataFrame, keep: int = 10) -> DataFrame:
    """(session_id, markdown): numbered turns, each with its sources once in the order they first stand."""
    w = Window.partitionBy("session_id").orderBy("turn")
    rows = last_turns(t, keep).withColumn("n", F.row_number().over(w))
    names = F.array_distinct(F.transform(F.coalesce("sources", F.array()), lambda s: F.concat(F.lit("- "), s["filename"], F.when(F.coalesce(s["page"], F.lit(0)) != 0, F.concat(F.lit(", page "), s["page"].cast("string"))).otherwise(F.lit("")))))
    cited = F.when(F.size(names) > 0, F.concat(F.lit("\n\n**Sources:**\n"), F.array_join(names, "\n"))).otherwise(F.lit(""))
    block = F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), F.coalesce("query", F.lit("")), F.lit("\n\n"), F.coalesce("answer", F.lit("")), cited, F.lit("\n\n---\n"))
    return rows.select("session_id", F.struct("n", block.alias("b")).alias("x")).groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["b"]), "\n").alias("markdown"))


def messages(t: DataFrame) -> DataFrame:
    """Each turn as its two messages: (session_id, seq, role, content)."""
    two = F.explode(F.array(F.struct((2 * F.col("turn")).alias("seq"), F.lit("user").alias("role"), F.col("query").alias("content")), F.struct((2 * F.col("turn") + 1).alias("seq"), F.lit("bot").alias("role"), F.col("answer").alias("content"))))
    return t.select("session_id", two.alias("m")).select("session_id", "m.*")


def frames(t: DataFrame, size: int = 4) -> DataFrame:
    """(session_id, turn, seq, frame): the answer in frames of fixed size."""
    n = F.ceil(F.char_length("answer") / size).cast("int")
    at = t.filter(F.char_length("answer") > 0).select("session_id", "turn", "answer", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return at.select("session_id", "turn", F.col("seq").cast("bigint").alias("seq"), F.substring("answer", F.col("seq") * size + 1, F.lit(size)).alias("frame"))
