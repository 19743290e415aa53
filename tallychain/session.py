"""Session defaults: UTC, adaptive plans, Arrow."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tallychain", **conf: str) -> SparkSession:
    """The running session, or a new one with these defaults; a cluster's own settings for partitions and memory are left alone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    builder = SparkSession.builder.appName(name).config("spark.executorEnv.PYTHONPATH", root)
    return builder.config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


#: Used only by a local master whose session names no shared folder, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/tallychain"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach (spark.checkpoint.dir). A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = LOCAL_SHARED
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there, and a lost executor costs a reread."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
