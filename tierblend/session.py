"""Session settings and the shared working folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Most rows a side may have before it is no longer broadcast or brought to the driver.
BROADCAST_ROWS = 100_000

_fallback_dirs: dict[str, str] = {}


def build_session(app: str = "tierblend", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where neither that setting nor a checkpoint folder exists and the master is local (tests) a
    temporary folder is made and registered as the checkpoint folder; a cluster must name a shared one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="tierblend-")
        spark.sparkContext.setCheckpointDir(_fallback_dirs[app])
    return _fallback_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the working folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, order_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The copy has no lineage and survives the loss of executors. With ``order_by`` each file is sorted,
    so that filters on those columns skip pages by their statistics.
    """
    path = scratch_path(df.sparkSession, name)
    (df.sortWithinPartitions(*order_by) if order_by else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """Number of ranges used to spread an ordered computation over the cluster."""
    return max(8, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))


def small_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> list | None:
    """All rows of ``df`` when there are at most ``limit``, otherwise None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def ship_by_value(module: str) -> None:
    """Send the functions of a module inside the task, so workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
