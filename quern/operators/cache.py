"""The semantic cache as a table: (key, embedding, result, used, version), one row a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evidence import lru_keep
from .retrieval import cache_lookup

THRESHOLD, CAPACITY = 0.97, 200


def lookup(cache: DataFrame, questions: DataFrame, version: int, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, hit, cached_id, similarity) of questions (query_id, embedding); entries of another store version answer nothing."""
    return cache_lookup(questions, cache.filter(F.col("version") == version), threshold, id_="key")


def store(cache: DataFrame, new: DataFrame, version: int, capacity: int = CAPACITY) -> DataFrame:
    """The cache with new entries: a key stored again replaces the old one, the least recently used go beyond the capacity, and
    entries of an older store version go at once (documents changed)."""
    rows = cache.filter(F.col("version") == version).unionByName(new.withColumn("version", F.lit(version)))
    last = rows.groupBy("key").agg(F.max_by(F.struct("embedding", "result"), "used").alias("r"), F.max("used").alias("used")).withColumn("cache", F.lit("semantic"))
    kept = lru_keep(last.select("cache", "key", "used"), capacity).select("key")
    return last.join(kept, "key", "left_semi").select("key", "r.embedding", "r.result", "used", F.lit(version).alias("version"))


def touch(cache: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """The cache after a lookup: entries that were hit count as used now."""
    hit = found.filter("hit").select(F.col("cached_id").alias("key")).distinct().withColumn("hit", F.lit(True))
    return cache.join(hit, "key", "left").withColumn("used", F.when(F.col("hit"), F.lit(now)).otherwise(F.col("used"))).drop("hit")
