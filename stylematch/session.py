"""Session settings and the shared folder used for checkpoints and stage tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stylematch", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A cluster must name one. Only a local session without one gets a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="stylematch-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; every call gives another one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def stage(df: DataFrame, label: str, group: int | None = None) -> DataFrame:
    """Write a stage table below the shared folder and read it back.

    Later plans start from files that outlive executors, and know the size of the table. ``group`` is the size of a row
    group in bytes; of wide rows a task reads a whole one at a time.
    """
    path = scratch_path(df.sparkSession, label)
    (df.write if group is None else df.write.option("parquet.block.size", group)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(staged: DataFrame) -> None:
    """Delete the files of a stage table that no later plan reads."""
    there = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    there.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished queries now.

    Its cleaner learns that a query is done with when the driver's JVM collects the plan, by default every half hour;
    an operator of many staged steps would hold the shuffles of all of them until then.
    """
    gc.collect()
    spark._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and stops plan growth."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
