"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. AQE splits skewed join partitions, so
# a key that holds a large share of the rows does not end up in one task.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A union may not pass for partitioned by the keys of its sides: once their partitions
    # are coalesced at run time this is not so, and equal keys stay in several tasks.
    "spark.sql.unionOutputPartitioning": "false",
    # Rows of a group that a task may keep before the shuffle of a top-n.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # Open sessions of a hot key are merged in each task before they move.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's checkpoint folder.

    Only a local session may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chatlake-"))
    return sc.getCheckpointDir().rstrip("/")


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/chatlake/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table of this application."""
    return f"{_own_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Fixes values that a recomputation could change (such as partition numbers)
    and cuts the lineage; it survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, once no result still reads them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
