"""Session defaults, and the one place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "siftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    Cluster sizing (shuffle partitions, memory, split size) is left to the cluster;
    AQE merges shuffle partitions that turn out small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session may go without it: a cluster must name a folder that every
    executor can reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="siftline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def release(spark: SparkSession) -> None:
    """Remove every intermediate table that this application has written.

    For the end of a job: tables that still read them can't be used any more.
    """
    remove(spark, f"{shared_dir(spark).rstrip('/')}/siftline/{spark.sparkContext.applicationId}")


def remove(spark: SparkSession, path: str) -> None:
    """Remove one folder, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def new_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/siftline/{app}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where a result is read several times: the work is done once, the lineage
    ends at files that survive the loss of any executor, and later readers still get
    column pruning and pushed filters (which `checkpoint()` would lose).
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
