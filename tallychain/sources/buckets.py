"""Tables in folders by a hash of their key: a change rewrites the folders of the keys that it names and leaves the others as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.operators import anchors as anchor_rows
from tallychain.operators import registry

#: Folders of a table, to be chosen so that one holds few files; every writer and reader of a table must name the same number.
BUCKETS = 64
MODELS = "model_id string, name string, version string, created_at long"


def bucket(key: Column | str, buckets: int = BUCKETS) -> Column:
    """The folder of a key; rows with a null key share one."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _laid(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumns({"bucket": bucket(key, buckets), "kept": F.lit(True)})


def _put(rows: DataFrame, path: str, mode: str) -> None:
    """Write rows with bucket; with mode overwrite only the folders that rows have."""
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _all(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from tallychain.streaming.append import read_written

    return read_written(spark, path, f"{schema}, kept boolean, bucket int")


def write(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A new table. A path that has one is an error."""
    _put(_laid(rows, key, buckets), path, "errorifexists")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows, of the columns of schema. Empty before anything is written."""
    return _all(spark, path, schema).where("kept").drop("kept", "bucket")


def of_key(spark: SparkSession, path: str, schema: str, key: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of one key: one folder is read."""
    asked = (F.col("bucket") == bucket(F.lit(value), buckets)) & (F.col(key) == value)
    return _all(spark, path, schema).where("kept").where(asked).drop("kept", "bucket")


def _log(spark: SparkSession, path: str) -> DataFrame:
    from tallychain.streaming.append import read_written

    return read_written(spark, f"{path}-log", "run long, phase string")


def _noted(spark: SparkSession, path: str, run: int, phase: str) -> None:
    spark.createDataFrame([(1,)], "noted int").coalesce(1).write.mode("overwrite").parquet(f"{path}-log/run={run}/phase={phase}")


def _redo(spark: SparkSession, path: str, schema: str, run: int) -> None:
    """Replace the folders that the change `run` wrote down by what it wrote down. To do it again is no harm."""
    _put(spark.read.schema(f"{schema}, kept boolean, bucket int").parquet(f"{path}-changes/run={run}"), path, "overwrite")
    _noted(spark, path, run, "done")


def recover(spark: SparkSession, path: str, schema: str) -> int:
    """Finish a change that was written down whole but may have reached a part of the folders; the number of the next change. A change that was
    not written down whole has touched nothing and is forgotten. One writer at a time."""
    phases = _log(spark, path).groupBy("run").agg(F.collect_set("phase").alias("phases")).orderBy(F.desc("run")).first()
    if phases is None:
        return 0
    if "done" not in phases.phases:
        _redo(spark, path, schema, phases.run)
    return phases.run + 1


def change(spark: SparkSession, path: str, schema: str, key: str, keys: DataFrame, changed: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> int:
    """Replace the rows in the folders of keys(key) by changed(rows), which may alter and drop rows and add some of these keys. How many folders were
    touched. Only these are read and written, each with a row that is no data, so that a folder that loses its last row is replaced too.

    The new folders are written down beside the table before they replace the old ones, so a run that fails in between is finished by the
    next change or by recover(). No keys touch nothing.
    """
    run = recover(spark, path, schema)
    touched = keys.select(bucket(key, buckets).alias("bucket")).distinct()
    names = sorted(r.bucket for r in touched.collect())  # as many as there are folders at most
    if not names:
        return 0
    old = _all(spark, path, schema).where(F.col("bucket").isin(names)).where("kept").drop("kept", "bucket")
    new = _laid(changed(old), key, buckets)
    held = spark.createDataFrame([(n,) for n in names], "bucket int").withColumn("kept", F.lit(False))
    new.unionByName(held, allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}-changes/run={run}")
    _noted(spark, path, run, "ready")
    _redo(spark, path, schema, run)
    return len(names)


def update_models(spark: SparkSession, path: str, changes: DataFrame, schema: str = MODELS) -> int:
    """registry.update of a table by model_id."""
    return change(spark, path, schema, "model_id", changes, lambda old: registry.update(old, changes))


def delete_models(spark: SparkSession, path: str, ids: DataFrame, schema: str = MODELS) -> int:
    """registry.delete of a table by model_id."""
    return change(spark, path, schema, "model_id", ids, lambda old: registry.delete(old, ids))


def confirm_anchors(spark: SparkSession, path: str, receipts: DataFrame) -> int:
    """anchors.confirm of a table by tx_hash: receipts without a block touch nothing."""
    from tallychain.streaming.append import ANCHORS

    mined = receipts.where("block_number is not null")
    return change(spark, path, ANCHORS, "tx_hash", mined, lambda old: anchor_rows.confirm(old, mined))
