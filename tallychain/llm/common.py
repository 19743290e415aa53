"""What the corpus operators share: the shared folder and staged tables (of the session's module), tables and bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.session import shared_dir, staged

__all__ = ["SALTS", "bounded_batches", "salt", "salted", "shared_dir", "staged", "table"]

#: Parts over which the rows of one hot key are dealt in a join.
SALTS = 16


def salt(of: str) -> Column:
    """The part of a row, by a column that tells rows of one key apart."""
    return F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")


def salted(few: DataFrame) -> DataFrame:
    """few, with one row for each part in column __salt, to be joined by the key and salt()."""
    return few.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))


def bounded_batches(spark: SparkSession, rows: int = 250) -> None:
    """Arrow batches of at most so many rows and 2 MB, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
