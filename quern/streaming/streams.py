"""Structured Streaming forms: counters, rate limits, bounded history, change feed.

Each builds a query on any streaming source; `drain` runs it over what is there and gives the result as a batch
DataFrame, through files in the shared checkpoint folder (no memory sink, nothing on one machine alone).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def source(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 1) -> DataFrame:
    """A table of the data folder as a stream of files; time stamps without zone become instants in UTC."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs_path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    df = reader.parquet(path) if is_dir else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    for f in schema:
        if f.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def drain(query_df: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over all available input; every batch is written under its own id, so a repeated batch replaces itself."""
    spark = query_df.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    q = query_df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in query_df.schema) + ", batch_id int"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def latest(drained: DataFrame) -> DataFrame:
    """Of a stream in complete mode: what the last batch said."""
    last = drained.agg(F.max("batch_id").alias("batch_id"))  # one row
    return drained.join(F.broadcast(last), "batch_id").drop("batch_id")


def rate_limits(events: DataFrame, limit: int = 1, per: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """(user_id, window_start, n) of users over the limit, once a window is closed by the watermark."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", per)).agg(F.count("*").alias("n"))
    return w.filter(F.col("n") > limit).select("user_id", F.col("window.start").alias("window_start"), "n")


def last_events(events: DataFrame, keep: int = 10) -> DataFrame:
    """(user_id, seq, event_id): each user's latest events, kept as bounded state that is updated batch by batch."""
    import pandas as pd

    def update(key, batches, state):
        kept = list(zip(*state.get)) if state.exists else []
        for b in batches:
            kept += list(zip(b["micros"].tolist(), b["event_id"].tolist()))
        kept = sorted(kept)[-keep:]
        state.update(([k[0] for k in kept], [k[1] for k in kept]))
        yield pd.DataFrame({"user_id": [key[0]] * len(kept), "seq": range(len(kept)), "event_id": [k[1] for k in kept]})

    rows = events.select("user_id", "event_id", F.unix_micros("ts").alias("micros"))
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, seq bigint, event_id bigint", "micros array<bigint>, ids array<bigint>", "update", "NoTimeout")


def newest_per_key(drained: DataFrame, key: str) -> DataFrame:
    """Of a stream in update mode: each key's rows of its last batch."""
    w = Window.partitionBy(key)
    return drained.withColumn("last", F.max("batch_id").over(w)).filter("batch_id = last").drop("batch_id", "last")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once each, however often they are delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def versions(changes: DataFrame, key: str, root: str | None = None) -> DataFrame:
    """A change feed into a versioned table: (version, changed, added). Each batch is one version and writes what it changed
    under its own number, so a batch that is run again replaces itself; `at_version` gives the table as of a version.

    With `root`, a folder all executors share, versions outlive the call and a later one goes on from there.
    """
    spark = changes.sparkSession
    root = root or f"{ensure_checkpoint_dir(spark)}/versions-{uuid.uuid4().hex}"
    schema = changes.schema

    def apply(batch: DataFrame, version: int) -> None:
        new = batch.dropDuplicates([key])
        new.write.mode("overwrite").parquet(f"{root}/delta/version={version}")
        mine = spark.read.schema(schema).parquet(f"{root}/delta/version={version}")
        old = at_version(spark, root, key, schema, version - 1).select(key)
        counts = mine.agg(F.count("*").alias("changed")).crossJoin(mine.join(old, key, "left_anti").agg(F.count("*").alias("added")))
        counts.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{root}/log/{version}")

    q = changes.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(apply).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("changed bigint, added bigint, version int").option("recursiveFileLookup", "true").parquet(f"{root}/log")


def at_version(spark: SparkSession, root: str, key: str, schema, version: int) -> DataFrame:
    """The table as of a version: of each key the row of its latest change."""
    if version < 0:
        return spark.createDataFrame([], schema)
    every = spark.read.schema(schema).option("basePath", f"{root}/delta").parquet(*[f"{root}/delta/version={v}" for v in range(version + 1)])
    if "version" not in every.columns:
        every = every.withColumn("version", F.regexp_extract(F.input_file_name(), r"version=(\d+)", 1).cast("int"))
    row = F.struct(*[F.col(f"`{c}`") for c in schema.names])
    return every.groupBy(key).agg(F.max_by(row, "version").alias("r")).select(*[F.col(f"r.`{c}`") for c in schema.names])


def changed_since(log: DataFrame, seen: int) -> bool:
    """Whether a reader that loaded version `seen` has anything to load."""
    return not log.filter(F.col("version") > seen).isEmpty()
