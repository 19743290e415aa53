"""Event time: rows that are late or lie in the future are put aside, the others are counted by windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallychain.streaming.append import read_written

#: Why a row is put aside.
FUTURE, LATE, UNDATED = "future", "late", "undated"
BOUND = "bound long"


def judged(rows: DataFrame, bound: int | None, now: int, ahead: int = 0) -> DataFrame:
    """rows(ts in seconds, …) with `aside`: why a row is put aside, null for the others. A time past now + ahead is the future, one before the bound is
    late, none is undated."""
    late = F.when(F.col("ts") < F.lit(bound), LATE) if bound is not None else F.lit(None).cast("string")
    return rows.withColumn("aside", F.when(F.col("ts").isNull(), UNDATED).when(F.col("ts") > now + ahead, FUTURE).otherwise(late))


def divided(rows: DataFrame, path: str, checkpoint: str, now: int, lateness: int = 3600, ahead: int = 0) -> StreamingQuery:
    """Divide a stream of rows(ts in seconds, …) into path/accepted and path/aside (with the reason), until no more input is there.

    A row is late if it is more than `lateness` seconds before the latest accepted one of the micro-batches before its own. Rows of the future never
    count for that, so that they do not make all others late. The bound after each batch is one row under path/bound; folders are named by
    batches and overwritten if one runs again.
    """
    spark = rows.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        known = read_written(spark, f"{path}/bound", f"{BOUND}, batch_id long").where(F.col("batch_id") == number - 1).first()
        bound = known.bound if known else None
        own = judged(batch, bound, now, ahead)
        own.where("aside is null").drop("aside").write.mode("overwrite").parquet(f"{path}/accepted/batch_id={number}")
        own.where("aside is not null").write.mode("overwrite").parquet(f"{path}/aside/batch_id={number}")
        kept = read_written(spark, f"{path}/accepted", f"{rows_schema}, batch_id long").where(F.col("batch_id") == number)
        most = kept.agg(F.max("ts")).first()[0]
        new = max((x for x in (bound, None if most is None else most - lateness) if x is not None), default=None)
        spark.createDataFrame([(new,)], BOUND).coalesce(1).write.mode("overwrite").parquet(f"{path}/bound/batch_id={number}")

    rows_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(accepted: DataFrame, by: list[str], window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """(start, *by, events) for each window of a stream of accepted rows(ts in seconds, *by), in append mode: a window comes once, when the
    watermark has passed its end. On a table it is the count of each window."""
    dated = accepted.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", lateness)
    found = dated.groupBy(F.window("at", window).alias("w"), *by).agg(F.count("*").alias("events"))
    return found.select(F.unix_timestamp("w.start").alias("start"), *by, "events")


def confirmations(anchors: DataFrame, receipts: DataFrame, within: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """anchors(tx_hash, anchored_at, status, block_number, …) and receipts(tx_hash, block_number, mined_at), two streams with times in seconds -> anchors,
    each once: confirmed with its receipt's block, whichever of the two comes first, or as it is when the watermark has passed all receipts
    that could be its own. Two tables give the same at once.

    A receipt is an anchor's if it is of the same transaction and at most `within` before or after it; one without a block confirms nothing, and
    one that is repeated counts once. State is kept of both sides for `within` and `delay`, not for ever. Only pending anchors change.
    """
    a = anchors.withColumn("anchored", F.timestamp_seconds("anchored_at")).withWatermark("anchored", delay).alias("a")
    r = receipts.where("block_number is not null").withColumn("mined", F.timestamp_seconds("mined_at")).withWatermark("mined", delay)
    r = (r.dropDuplicatesWithinWatermark(["tx_hash"]) if receipts.isStreaming else r.dropDuplicates(["tx_hash"])).alias("r")
    near = F.expr(f"r.mined >= a.anchored - interval {within} and r.mined <= a.anchored + interval {within}")
    met = a.join(r, (F.col("a.tx_hash") == F.col("r.tx_hash")) & (F.col("a.status") == "pending") & near, "leftOuter")
    hit = F.col("r.tx_hash").isNotNull()
    changed = {"block_number": F.when(hit, F.col("r.block_number")).otherwise(F.col("a.block_number")), "status": F.when(hit, "confirmed").otherwise(F.col("a.status"))}
    return met.select(*[changed.get(c, F.col(f"a.{c}")).alias(c) for c in anchors.columns])
