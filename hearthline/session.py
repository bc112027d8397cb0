"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hearthline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew-join splitting on.

    Shuffle parallelism starts high and AQE coalesces small partitions, so the same settings
    hold from a laptop to a cluster.
    """
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


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        root = configured
    elif spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="hearthline-")
        spark.conf.set("spark.checkpoint.dir", root)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created until Spark writes to it."""
    return f"{shared_dir(spark).rstrip('/')}/hearthline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """The frame written once to the shared folder and read back: computed once, lineage cut, and
    still there when an executor is lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_shuffles_short(spark: SparkSession) -> None:
    """Shuffle files go as soon as the job that wrote them has ended; results that later jobs need are tables."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
