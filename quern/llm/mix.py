"""Mixing of sources to target weights, as a subset-sum fit of token budgets.

Documents are sized in tokens of a public vocabulary. The mixture's total is the largest one at which
no source needs more tokens than it has with every record used the most times allowed (or the total
asked for, where that is smaller). Per source the budget is its share of the total. Whole passes over
the source fill it as far as they go; for the rest, documents are counted by exact token length, and a
bounded knapsack over (length, count) finds the lengths to take whose sum comes nearest the budget. Of
each length the needed number of documents is drawn by a seeded hash.

Budgets are fitted on counts by exact length, however many there are: a source of T tokens has fewer than
sqrt(2 T) different lengths, so the counts are a small table; documents themselves never leave the
executors. The knapsack runs over the last stretch of the budget only, after a fill in proportion and by
whole length groups, so it is bounded too.

Defined cases: names of sources are compared without case, surrounding blanks, and with "_" as "-"; a
listed source without (non-empty) documents gets nothing, which its row says, and the shares of the
others are fitted among themselves; documents of other sources, and null, empty or zero-token texts, are not
used; equal texts under other ids are records of their own; a null or non-positive weight is no target;
a null or non-positive max_repeats counts as 1; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .encode import count_tokens

#: The knapsack's bound: tokens of the last stretch of a budget.
STRETCH = 60_000
#: Slices by hash of the documents of one length.
SLICES = 256


def norm_source(c):
    return F.regexp_replace(F.lower(F.trim(c)), "_", "-")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, stretch: int = STRETCH) -> np.ndarray:
    """How many documents of each length to take (each at most counts) so that their sum comes nearest budget from below.

    Lengths are ascending. Long ones are taken in proportion first, so that the mixture keeps the source's
    spread of lengths; the rest, at most `stretch` tokens, is an exact bounded knapsack.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not len(lengths):
        return np.zeros_like(counts)
    # In proportion, rounded down: at most one document a length is left open.
    take = (counts * budget) // total
    rest = budget - int((take * lengths).sum())
    # More of the longest that fit, until the rest is short enough for the knapsack.
    for i in np.argsort(-lengths, kind="stable").tolist():
        if rest <= stretch:
            break
        n = min(int(counts[i] - take[i]), max(0, (rest - stretch // 2) // int(lengths[i])))
        take[i] += n
        rest -= n * int(lengths[i])
    free = counts - take
    # Bounded knapsack by binary splitting; reach[s] is the item that first reached sum s.
    reach = np.full(rest + 1, -1, np.int64)
    reach[0] = -2
    items: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable").tolist():
        left, part = int(free[i]), 1
        while left > 0 and reach[rest] == -1:
            n = min(part, left)
            size = n * int(lengths[i])
            if size > rest:
                break
            fresh = np.nonzero((reach[:-size] != -1) & (reach[size:] == -1))[0] + size
            reach[fresh] = len(items)
            items.append((i, n))
            left -= n
            part *= 2
        if reach[rest] != -1:
            break
    s = int(np.nonzero(reach != -1)[0].max())
    while s > 0:
        i, n = items[int(reach[s])]
        take[i] += n
        s -= n * int(lengths[i])
    return take


def plan_mixture(stats: list[dict], targets: list[dict], total_tokens: int | None = None) -> tuple[list[dict], int]:
    """Per source: share, budget, whole passes, and documents to take of each length.

    stats: rows (source, n_tokens, n). targets: rows (source, weight, repeats).
    """
    by: dict[str, list[tuple[int, int]]] = {}
    for r in stats:
        by.setdefault(r["source"], []).append((r["n_tokens"], r["n"]))
    weight = sum(t["weight"] for t in targets) or 1.0
    have = {t["source"]: sum(a * n for a, n in by.get(t["source"], ())) for t in targets}
    live = [t for t in targets if have[t["source"]] > 0]
    live_weight = sum(t["weight"] for t in live)
    most = min((have[t["source"]] * t["repeats"] / (t["weight"] / live_weight) for t in live), default=0)
    total = int(most if total_tokens is None else min(most, total_tokens))
    plans = []
    for t in targets:
        rows = sorted(by.get(t["source"], ()))
        lengths, counts = np.array([a for a, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)
        size = have[t["source"]]
        budget = round(total * t["weight"] / live_weight) if size else 0
        passes = min(budget // size, t["repeats"]) if size else 0
        rest = budget - passes * size if passes < t["repeats"] else 0
        take = fit_counts(lengths, counts, rest) if size else np.zeros(0, np.int64)
        plans.append({"source": t["source"], "target_share": t["weight"] / weight, "max_repeats": t["repeats"], "available": size, "budget": budget, "passes": int(passes), "lengths": lengths, "take": take})
    return plans, total


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(records, report). records (key, source, n_tokens, repeats): each used record once, with how often it is used.

    report (source, target_share, actual_share, tokens, documents, max_repeats, most_repeats): one row a target source.
    """
    spark = documents.sparkSession
    wanted = targets.select(norm_source(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("weight"), F.coalesce("max_repeats", F.lit(1)).alias("repeats"))
    wanted = wanted.filter("source IS NOT NULL AND weight > 0").groupBy("source").agg(F.sum("weight").alias("weight"), F.greatest(F.max("repeats"), F.lit(1)).alias("repeats"))
    goal = sorted((r.asDict() for r in wanted.collect()), key=lambda r: r["source"])  # one row a source, by definition small
    names = [g["source"] for g in goal]
    rows = documents.select(F.col(key).alias("key"), norm_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    rows = rows.filter(F.col("source").isin(names) & (F.length("text") > 0))
    sized = materialise(count_tokens(rows, "key", "text", vocabulary, ("source",)).filter("n_tokens > 0"))
    stats = sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).toArrow().to_pylist()
    plans, _ = plan_mixture(stats, goal, total_tokens)
    passes = [(p["source"], p["passes"]) for p in plans]
    takes = [(p["source"], int(a), int(n)) for p in plans for a, n in zip(p["lengths"], p["take"]) if n]
    whole = spark.createDataFrame(passes, "source string, passes int")
    drawn = spark.createDataFrame(takes, "source string, n_tokens bigint, take bigint")
    # Of each length the documents least by a seeded hash. Hash slices are counted; those before the border are taken
    # whole, and only rows of the slice on the border are ranked.
    hashed = sized.withColumn("draw", F.xxhash64(F.lit(seed), "key")).withColumn("slice", F.pmod(F.shiftright("draw", 20), F.lit(SLICES)).cast("int"))
    same = ["source", "n_tokens", "slice"]
    by_slice = hashed.groupBy(*same).agg(F.count("*").alias("n")).join(drawn, ["source", "n_tokens"])
    upto = by_slice.withColumn("before", F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("slice")) - F.col("n"))
    upto = upto.filter(F.col("before") < F.col("take")).withColumn("border", F.col("before") + F.col("n") > F.col("take")).drop("n")
    rows = hashed.join(upto, same, "left")
    border = F.coalesce("border", F.lit(False))
    ranked = rows.filter(border).withColumn("rank", F.row_number().over(Window.partitionBy(*same).orderBy("draw", "key")))
    extra = rows.filter(~border).withColumn("extra", F.col("take").isNotNull()).select("key", "source", "n_tokens", "extra")
    extra = extra.unionByName(ranked.select("key", "source", "n_tokens", (F.col("before") + F.col("rank") <= F.col("take")).alias("extra")))
    joined = extra.join(F.broadcast(whole), "source", "left")  # one row a source
    used = joined.select(F.col("key").alias(key), "source", "n_tokens", (F.coalesce("passes", F.lit(0)) + F.col("extra").cast("int")).cast("int").alias("repeats")).filter("repeats > 0")
    sums = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    goals = spark.createDataFrame([(p["source"], float(p["target_share"]), p["max_repeats"]) for p in plans], "source string, target_share double, max_repeats int")
    report = goals.join(sums, "source", "left")
    all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())
    report = report.select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.greatest(all_tokens, F.lit(1))).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    return used, report
