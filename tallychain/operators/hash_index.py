"""A secondary index from a block's hash to its index: two pruned reads find a block in a chain of any number of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a hash that name its bucket, and the columns of the index.
DIGITS = 2
ENTRIES = "hash string, block_index long, bucket string"


def bucket(hash_: Column | str) -> Column:
    """The folder of a hash; hashes with fewer digits, or none, share one."""
    return F.coalesce(F.nullif(F.substring(F.lower(hash_), 1, DIGITS), F.lit("")), F.lit("none"))


def write(blocks: DataFrame, path: str, mode: str = "append") -> None:
    """Add the entries of new blocks(block_index, hash): a folder for each bucket, sorted by hash. An append costs the new blocks only; entries of one
    block that come twice, as when a batch runs again, do no harm."""
    entries = blocks.select("hash", "block_index", bucket("hash").alias("bucket"))
    entries.repartition("bucket").sortWithinPartitions("bucket", "hash").write.mode(mode).partitionBy("bucket").parquet(path)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the index anew to target, one file a bucket, each entry once."""
    write(read(spark, path).select("hash", "block_index").distinct(), target, "errorifexists")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(path)


def index_of(spark: SparkSession, path: str, hash_: str) -> int | None:
    """The least index of the blocks of a hash: one bucket is read."""
    found = read(spark, path).where((F.col("bucket") == bucket(F.lit(hash_))) & (F.col("hash") == hash_))
    return found.agg(F.min("block_index")).first()[0]


def by_hash(blocks: DataFrame, path: str, hash_: str) -> DataFrame:
    """The first block of a hash, or no row, as lookups.by_hash has it. The second read has the index, and the range of indices where blocks are
    laid out by it (tables.read_blocks)."""
    index = index_of(blocks.sparkSession, path, hash_)
    found = blocks.where((F.col("block_index") == F.lit(index).cast("long")) & (F.col("hash") == hash_))
    if "index_range" in blocks.columns:
        from tallychain.sources.tables import PER_RANGE

        found = found.where(F.col("index_range") == F.lit(None if index is None else index // PER_RANGE).cast("long"))
    return found.limit(1)
