"""Statistics kept up with the chain: each batch adds its own blocks to the sums of the batch before, and reading them scans no block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.functions.text import iso
from tallychain.operators import chain, lookups
from tallychain.session import staged

#: One row for each batch: the sums over all blocks up to its end, and the last of these blocks.
TOTALS = "blocks long, models long, bad_hash long, broken_links long, last_index long, last_hash string, last_ts long, batch_id long"
#: A batch's own blocks by model, in folders by a hash of the model; first: no batch before had that model.
PER_MODEL = "model_id string, blocks long, inferences long, last_block_index long, first boolean, batch_id long, bucket int"
#: Folders that a batch's models are dealt to.
BUCKETS = 16


def bucket(model_id: Column | str) -> Column:
    return F.pmod(F.xxhash64(model_id), F.lit(BUCKETS)).cast("int")


def _totals(spark: SparkSession, path: str) -> DataFrame:
    from tallychain.streaming.append import read_written

    return read_written(spark, f"{path}/totals", TOTALS)


def _models(spark: SparkSession, path: str) -> DataFrame:
    from tallychain.streaming.append import read_written

    return read_written(spark, f"{path}/models", PER_MODEL)


def fold_batch(blocks: DataFrame, path: str, number: int) -> None:
    """Add batch `number` of blocks (with type and model_id, as tables.promoted has them) to the statistics under path, after batch number - 1.

    What is read is the batch, one row of the batch before, and the names of models so far in the folders that the batch's models have: these
    grow with the models, not with the blocks. A batch that runs again overwrites its own folders. Batches come in order of the index: a block
    that does not come after those of the batches before is an error, since the links of stored sums can't be judged anew. A block without an
    index is counted, as a broken link. An empty batch keeps the sums. A null model is no model and is counted by per_model alone.
    """
    spark = blocks.sparkSession
    before = _totals(spark, path).where(F.col("batch_id") == number - 1).first()
    if before is None and number > 0:
        raise ValueError(f"batch {number - 1} has no statistics")
    own = staged(blocks.select("block_index", "ts", "data", "previous_hash", "hash", "type", "model_id"), "batch")
    bounds = own.agg(F.min("block_index").alias("least")).first()
    if before is not None and before.last_index is not None and bounds.least is not None and bounds.least <= before.last_index:
        raise ValueError(f"block {bounds.least} comes after block {before.last_index} was counted")

    per = own.groupBy("model_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("type") == "inference").alias("inferences"), F.max("block_index").alias("last_block_index"))
    per = staged(per.withColumn("bucket", bucket("model_id")), "models")
    touched = [r.bucket for r in per.select("bucket").distinct().collect()]  # BUCKETS at most
    known = _models(spark, path).where((F.col("batch_id") < number) & F.col("first") & F.col("bucket").isin(touched)).select("model_id", F.lit(True).alias("known"))
    per = per.join(known, "model_id", "left").withColumn("first", F.col("known").isNull() & F.col("model_id").isNotNull()).drop("known")
    per.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/models/batch_id={number}")
    new = _models(spark, path).where((F.col("batch_id") == number) & F.col("first")).count()

    # the last block before stands in front of the batch for its hash alone
    tip = [(before.last_index, before.last_hash)] if before is not None and before.last_index is not None else []
    front = spark.createDataFrame(tip, "block_index long, hash string").select("block_index", F.lit(None).cast("long").alias("ts"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("string").alias("previous_hash"), "hash", F.lit(False).alias("own"))
    c = chain.checked(front.unionByName(own.select("block_index", "ts", "data", "previous_hash", "hash", F.lit(True).alias("own")))).where("own")
    found = c.agg(F.count("*").alias("blocks"), F.count_if("bad_hash").alias("bad_hash"), F.count_if("broken_link").alias("broken_links"), F.max(F.when(F.col("block_index").isNotNull(), F.struct("block_index", "hash", "ts"))).alias("last")).first()
    sums = {"blocks": found.blocks, "models": new, "bad_hash": found.bad_hash, "broken_links": found.broken_links}
    if before is not None:
        sums = {k: n + before[k] for k, n in sums.items()}
    last = tuple(found.last) if found.last is not None else (before.last_index, before.last_hash, before.last_ts) if before is not None else (None, None, None)
    row = spark.createDataFrame([(*sums.values(), *last)], TOTALS.removesuffix(", batch_id long"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/batch_id={number}")


def keeping(path: str) -> Callable[[DataFrame, int], None]:
    """A `then` for append_stream that keeps the statistics under path: a batch reads its own blocks only."""
    from tallychain.sources.tables import promoted

    def then(blocks: DataFrame, number: int) -> None:
        fold_batch(promoted(blocks.where(F.col("batch_id") == number).drop("batch_id")), path, number)

    return then


def stats(spark: SparkSession, path: str, anchors: DataFrame, number: int | None = None) -> DataFrame:
    """lookups.stats of all blocks of the batches so far, or up to batch `number`, from one row."""
    rows = _totals(spark, path)
    rows = rows.orderBy(F.desc("batch_id")).limit(1) if number is None else rows.where(F.col("batch_id") == number)
    a = rows.agg(F.max(F.struct("batch_id", *[c.split()[0] for c in TOTALS.split(", ")[:-1]])).alias("t")).select("t.*")  # one row, of nulls before the first batch
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    errors = n("bad_hash") + n("broken_links")
    own = a.select(
        n("blocks").alias("total_blocks"), F.greatest(n("models") - 1, F.lit(0)).cast("long").alias("total_models"), n("last_index").alias("last_block_index"), F.coalesce("last_hash", F.lit("")).alias("last_block_hash"),
        iso(F.col("last_ts")).alias("last_block_timestamp"), n("last_ts").alias("last_block_timestamp_unix"), (errors == 0).alias("chain_valid"), errors.alias("error_count"),
    )
    return own.join(F.broadcast(lookups.anchor_columns(anchors)), F.lit(True), "left")  # one row each


def per_model(spark: SparkSession, path: str, model_id: str | None = None) -> DataFrame:
    """lookups.per_model from the batches' sums; of one model, only its folders are read."""
    rows = _models(spark, path)
    if model_id is not None:
        rows = rows.where((F.col("bucket") == bucket(F.lit(model_id))) & (F.col("model_id") == model_id))
    return rows.groupBy("model_id").agg(F.sum("blocks").alias("blocks"), F.sum("inferences").alias("inferences"), F.max("last_block_index").alias("last_block_index"))
