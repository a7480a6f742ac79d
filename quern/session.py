"""Session factory and the few runtime rules every operator shares."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow. On a cluster the master comes from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # Checkpoints go when nothing refers to them any more, so rounds of an iteration don't pile up.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir where the cluster names one.

    Only where it is unset and the master is local (tests, one machine) a temporary folder is made.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="quern-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared checkpoint folder, so a lost executor costs one stage at most."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that can run at once, at least 1."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan has fewer partitions than there are (few files, large row groups).

    For plans of scans, filters and projections only. With as many partitions as cores nothing is shuffled, so this
    costs nothing on large tables.
    """
    n = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once an application: their Python workers need not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="quern-code-")) / "quern.zip"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(file))
    _SHIPPED.add(sc.applicationId)
