"""Pipeline counters over a log of answered requests: histograms with every bucket, outcome shares, rolling means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAILURES = ("RETRIEVAL_FAILURE", "INSUFFICIENT_CONTEXT", "HALLUCINATION", "OUTDATED_DATA", "FORMAT_ERROR", "UNKNOWN", "NONE")
ACTIONS = ("REWRITE_QUERY", "INCREASE_TOP_K", "STRICT_PROMPT", "REINGEST", "NONE")
REFUSED = ("explicit_not_found", "no_chunks_retrieved", "answer_too_short_max_attempts", "ungrounded_numbers_strong_model_failed", "no_results_after_retry")


def histogram(rows: DataFrame, column: str, buckets: tuple[str, ...], unknown: str, missing: str = "NONE") -> DataFrame:
    """(bucket, n) with a row for every bucket; unknown values count in `unknown`, nulls and blanks in `missing`."""
    c = F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit(missing)).when(F.col(column).isin(*buckets), F.col(column)).otherwise(F.lit(unknown))
    counts = rows.groupBy(c.alias("bucket")).agg(F.count("*").alias("k"))
    every = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("k", F.lit(0)).alias("n"))


def outcomes(log: DataFrame) -> DataFrame:
    """One row: requests, blocked, flagged, models, refused, best effort, retries by kind, accepted by attempt, mean confidence, tokens."""
    reason = F.coalesce("reflection_reason", F.lit(""))
    attempts = F.coalesce("attempts", F.lit(1))
    retried = attempts > 1
    return log.agg(
        F.count("*").alias("total_queries"), F.count_if(F.col("safety_decision").isin("regex", "classifier")).alias("blocked"), F.count_if("flagged").alias("flagged"),
        F.count_if(F.col("model") == "fast").alias("fast"), F.count_if(F.col("model") == "strong").alias("strong"), F.count_if(~F.coalesce("model", F.lit("none")).isin("fast", "strong")).alias("none"),
        F.count_if(reason.isin(*REFUSED)).alias("refused"), F.count_if(~reason.isin(*REFUSED) & reason.endswith("_max_attempts_reached")).alias("best_effort"),
        F.count_if(retried & F.col("healing_action").isin("REWRITE_QUERY", "INCREASE_TOP_K")).alias("retry_search"), F.count_if(retried & (F.col("healing_action") == "STRICT_PROMPT")).alias("retry_model"),
        *[F.count_if(F.least(attempts, F.lit(3)) == k).alias(f"attempt_{k}") for k in (1, 2, 3)], F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint").alias("tokens"),
    )


def rolling_mean(log: DataFrame, value: str, by: str, order: list, rows: int = 100) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return log.withColumn("rolling", F.round(F.avg(value).over(w), 8))


def latest_mean(log: DataFrame, value: str, order: list, rows: int = 100) -> DataFrame:
    """The mean of the latest rows: a top-k, so nothing is sorted as a whole."""
    return log.orderBy(*order).limit(rows).agg(F.round(F.avg(value), 1).alias("avg_latency"), F.count("*").alias("samples"))


def rate_limited(requests: DataFrame, user: str, ts: str, limit: int, per: str = "1 minute") -> DataFrame:
    """(user, window start, n) for windows with more requests than the limit."""
    out = requests.groupBy(F.col(user), F.window(ts, per).alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return out.select(user, F.col("w.start").alias("window_start"), "n")
