"""Table maintenance as DataFrame -> DataFrame: inserts, merges, deletes, leases, limits.

Each returns the new version of a table; the caller writes it beside the old one and swaps the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, and those rows of new whose key it doesn't have; of equal keys in new, one row."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str, sticky_or: tuple[str, ...] = (), clear: tuple[str, ...] = ()) -> DataFrame:
    """new's fields win where new has the key; sticky_or columns keep a true; clear columns become null on update."""
    o, n = old.alias("o"), new.alias("n")
    hit = F.col(f"n.{key}").isNotNull()
    out = []
    for c in old.columns:
        a = F.col(f"o.{c}")
        if c == key:
            out.append(F.coalesce(F.col(f"n.{c}"), a).alias(c))
        elif c in clear:
            out.append(F.when(~hit, a).alias(c))
        elif c in new.columns:
            b = F.col(f"n.{c}")
            b = F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)) if c in sticky_or else b
            out.append(F.when(hit, b).otherwise(a).alias(c))
        else:
            out.append(a.alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*out)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents that new has are replaced by new's."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def soft_delete(documents: DataFrame, gone: DataFrame, when, key: str = "id") -> DataFrame:
    mark = documents.join(gone.select(F.col(key)).distinct().withColumn("gone", F.lit(True)), key, "left")
    hit = F.coalesce("gone", F.lit(False)) & ~F.coalesce("is_deleted", F.lit(False))
    return mark.withColumn("deleted_at", F.when(hit, when).otherwise(F.col("deleted_at"))).withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)) | hit).drop("gone")


def set_status(documents: DataFrame, which, status: str, message: str | None = None) -> DataFrame:
    """Active documents that `which` holds for get the status, and their lease is released."""
    hit = which & ~F.coalesce("is_deleted", F.lit(False))
    out = documents.withColumn("hit", F.coalesce(hit, F.lit(False)))
    out = out.withColumn("status", F.when(F.col("hit"), F.lit(status)).otherwise(F.col("status"))).withColumn("status_message", F.when(F.col("hit"), F.lit(message)).otherwise(F.col("status_message")))
    return out.withColumn("ocr_worker", F.when(~F.col("hit"), F.col("ocr_worker"))).withColumn("ocr_heartbeat", F.when(~F.col("hit"), F.col("ocr_heartbeat"))).drop("hit")


def claimable(documents: DataFrame, worker: str, now, expiry_seconds: int) -> DataFrame:
    """Unfinished active documents a worker may claim: unowned, its own, or with a heartbeat that is too old."""
    free = F.col("ocr_worker").isNull() | (F.col("ocr_worker") == worker) | F.col("ocr_heartbeat").isNull() | (F.col("ocr_heartbeat").cast("double") < now - expiry_seconds)
    return documents.filter((F.col("status") == "processing") & ~F.coalesce("is_deleted", F.lit(False)) & free)


def adopt(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """Pending records of both sides; the local one stays where the status is the same."""
    lo, re = local.alias("l"), remote.alias("r")
    keep = F.col(f"l.{key}").isNotNull() & (F.col(f"r.{key}").isNull() | (F.col("l.status") == F.col("r.status")))
    cols = [F.when(keep, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in local.columns]
    return lo.join(re, F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer").select(*cols, F.when(keep, "local").otherwise("remote").alias("origin"))


def running_limit(rows: DataFrame, order: str, size: str, limit: int) -> DataFrame:
    """Adds `before` (sum of sizes of the rows ahead) and `fits` (no overflow up to here), without a global sort in one task.

    Rows are cut by range of (order, id), however alike their names are; only the sums of the cuts are ordered globally.
    """
    cut = materialise(rows.repartitionByRange(order, "id").withColumn("cut", F.spark_partition_id()))
    sums = cut.groupBy("cut").agg(F.sum(size).alias("s"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("s").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    w = Window.partitionBy("cut").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(ahead), "cut").withColumn("before", F.col("ahead") + F.coalesce(F.sum(size).over(w), F.lit(0)))  # one row a partition
    return out.withColumn("fits", F.col("before") + F.col(size) <= limit).drop("cut", "ahead")


def load_report(files: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """(name, outcome, before) of files (id, name, content_hash, chunk_count, failed) in the order of their names: `failed` where reading
    failed, `skipped` where the hash is known or an earlier file has it, `stopped` from the first that would pass the limit, else `loaded`."""
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy("name", "id")) > 1
    again = files.withColumn("again", first & F.col("content_hash").isNotNull()).join(known.select("content_hash").distinct().withColumn("known", F.lit(True)), "content_hash", "left")
    bad = F.coalesce("failed", F.lit(False))
    skip = F.coalesce("known", F.lit(False)) | F.col("again")
    sized = again.withColumn("take", F.when(bad | skip, 0).otherwise(F.coalesce("chunk_count", F.lit(0))))
    out = running_limit(sized, "name", "take", limit)
    # Once a file doesn't fit, all that would be loaded after it is left out, too.
    stop = out.filter(~F.col("fits")).agg(F.min(F.struct("name", "id")).alias("stop"))
    late = F.coalesce(F.struct("name", "id") >= F.col("stop"), F.lit(False))
    return out.crossJoin(F.broadcast(stop)).select("name", "id", F.when(bad, "failed").when(skip, "skipped").when(late, "stopped").otherwise("loaded").alias("outcome"))


def fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """(fingerprint): the same for the same set of keys in any order; digests of 256 buckets, then their digest."""
    bucket = F.substring(F.md5(key), 1, 2)
    part = rows.select(F.col(key)).distinct().groupBy(bucket.alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(key)), ","), 256).alias("d"))
    return part.groupBy().agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("b", F.lit(":"), "d"))), ","), 256).alias("fingerprint"))


def evenly_spaced(rows: DataFrame, group: str, order: list, total: int = 30) -> DataFrame:
    """Up to `total` rows: of each group max(1, total div groups) rows evenly spaced, interleaved by slot."""
    groups = rows.select(group).distinct().count()
    k = max(1, total // max(1, groups))
    w = Window.partitionBy(group)
    seq = rows.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))
    slot = F.when(F.col("n") <= k, F.col("i")).otherwise(F.ceil(F.col("i") * k / F.col("n")).cast("int"))
    hit = (F.col("n") <= k) | ((slot < k) & (F.floor(slot * F.col("n") / k).cast("int") == F.col("i")))
    return seq.withColumn("slot", slot.cast("bigint")).filter(hit).orderBy("slot", group).limit(total).drop("i", "n")
