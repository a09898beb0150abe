"""Session settings and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


TABLE_PREFIX = "riskloom-"


def build_session(app: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; extra settings as keyword pairs."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All time arithmetic here is on UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` wins.  Only a local session may fall back to a
    temporary folder: on a cluster an executor's own disk is not shared.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            # "local" and "local[8]" are one process; "local-cluster[...]" is a cluster.
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="riskloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and continue from it.

    Used where a result is read several times: later passes see the very same
    rows, read only the columns and row groups they need, and a lost executor
    costs nothing but a re-read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{TABLE_PREFIX}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files behind a materialized table that is no longer needed."""
    spark = df.sparkSession
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[1].startswith(TABLE_PREFIX):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
