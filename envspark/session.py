"""Session defaults and the shared folder used between stages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The zone of the domain's wall clocks.
ZONE = "America/New_York"


def build_session(app: str = "envspark", master: str | None = None, shuffle_partitions: int | None = None, zone: str | None = None) -> SparkSession:
    """A session with AQE (coalescing, skew-join splitting) on. Cluster settings win over these defaults.

    ``zone`` (ZONE for this domain's sources) is the session's time zone; left
    out, the cluster's stays.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # wide cleaning projections outgrow what the JVM compiles; beyond this size Spark splits them into small methods
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    if zone:
        builder = builder.config("spark.sql.session.timeZone", zone)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; a scratch folder is made
    only where that is unset, as in local tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="envspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back.

    For tables that several jobs read (a model's training rows, say): the work
    behind them is done once and outlives lost executors. It is removed when
    the application ends.
    """
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        folder = context._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have a written folder removed when the application ends."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)


def shared_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), spark.sparkContext.applicationId, name)
