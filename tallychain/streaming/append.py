"""Appending to the chain from a stream of requests."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallychain.functions.hashing import unhex_strict
from tallychain.operators import anchors, chain, frontier, merkle

ANCHORS = "merkle_root string, last_block_index long, tx_hash string, block_number long, chain_id long, anchored_at long, status string"


TIP = "block_index long, hash string"


def append_stream(rows: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, now: int | None = None) -> StreamingQuery:
    """Append a stream of rows(ord, ts, data) to the chain under path, one job per micro-batch, until no more input is there.

    Each batch overwrites its own folder batch_id=N, so a batch that runs again after a failure leaves one copy. The chain's tip after each batch is
    a row of its own under path-tip, so that a batch reads nothing of the chain, however many empty batches were before it. Rows later than
    `now` are dropped first, if it is given. `then` gets the chain and the batch's number.
    """
    spark = rows.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        if now is not None:
            batch = batch.where(F.col("ts") <= now)
        before = read_written(spark, f"{path}-tip", f"{TIP}, batch_id long").where(F.col("batch_id") == number - 1).select("block_index", "hash")
        chain.append(before, batch).write.mode("overwrite").parquet(f"{path}/batch_id={number}")
        own = read_chain(spark, path).where(F.col("batch_id") == number).select("block_index", "hash")
        tip = before.union(own).agg(F.max(F.struct("block_index", "hash")).alias("t")).where("t is not null").select("t.*")
        tip.coalesce(1).write.mode("overwrite").parquet(f"{path}-tip/batch_id={number}")
        if then:
            then(read_chain(spark, path), number)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_chain(spark, path: str) -> DataFrame:
    """The chain's blocks with their batch; empty before the first batch."""
    schema = f"{chain.BLOCKS}, batch_id long"
    return read_written(spark, path, schema)


def read_written(spark, path: str, schema: str) -> DataFrame:
    """What is written under path; empty before anything is."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def anchoring(path: str, send: Callable[[str], str], step: int = 50, now: Callable[[], int] = lambda: int(time.time()), tree: merkle.Tree = merkle.SORTED) -> Callable[[DataFrame, int], None]:
    """A `then` for append_stream that anchors the chain after a batch where an anchor is due. send publishes a root and gives its transaction's
    hash. Anchors are appended under path, one folder a batch, overwritten if the batch runs again.

    The tree's frontier after each batch is kept under path-frontier, so a batch reads its own blocks and the frontier of the batch before, at most
    63 rows, and not the chain."""

    def then(blocks: DataFrame, number: int) -> None:
        spark = blocks.sparkSession
        of = lambda folder, schema, batch: read_written(spark, folder, f"{schema}, batch_id long").where(batch)
        before = frontier.taken(of(f"{path}-frontier", frontier.NODES, F.col("batch_id") == number - 1).collect())
        own = blocks.where(F.col("batch_id") == number).select(F.col("block_index").alias("pos"), unhex_strict(F.col("hash")).alias("leaf"))
        peaks = frontier.extended(before, own, tree)
        frontier.frame(spark, peaks).coalesce(1).write.mode("overwrite").parquet(f"{path}-frontier/batch_id={number}")
        done = of(path, ANCHORS, F.col("batch_id") < number).agg(F.coalesce(F.max("last_block_index"), F.lit(-1))).first()[0]
        last = frontier.length(peaks) - 1
        if last >= 0 and last - done >= step:
            root = "0x" + frontier.root(peaks, tree).hex()
            spark.createDataFrame([(root, last, send(root), None, 11155111, now(), "pending")], ANCHORS).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return then


def confirm_stream(receipts: DataFrame, start: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Confirm pending anchors from a stream of receipts(tx_hash, block_number): each micro-batch writes the anchors as they are then under
    path/batch_id=N, from those of the batch before, or from start. With `every` (a trigger interval such as '10 minutes') it runs on."""
    spark = receipts.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        now = read_written(spark, path, f"{ANCHORS}, batch_id long").where(F.col("batch_id") == number - 1).drop("batch_id")
        anchors.confirm(start.select(*now.columns) if now.isEmpty() else now, batch).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    writer = receipts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
