"""Verification that goes on where the last one ended: stored checkpoints, and only the blocks after them are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallychain.operators.chain import checked

SUMS = ("total", "bad_hash", "broken_links", "invalid_blocks")
#: The last block by index and hash, how many blocks have its index, and the sums over all blocks with an index so far.
CHECKPOINT = "last_index long, last_hash string, at_last long, " + ", ".join(f"{c} long" for c in SUMS)


def _sums(where) -> list:
    n = lambda c, name: F.count_if(where & c).alias(name)
    return [n(F.lit(True), "total"), n(F.col("bad_hash"), "bad_hash"), n(F.col("broken_link"), "broken_links"), n(F.col("bad_hash") | F.col("broken_link"), "invalid_blocks")]


def advance(blocks: DataFrame, seen: Row | None = None) -> tuple[Row | None, Row]:
    """(the checkpoint after all blocks, or None where the prefix of `seen` was rewritten; what chain.verify says of all blocks, as a row).

    Only blocks from the checkpoint's last one on are read, and those without an index, which stand nowhere and are counted anew each time. The prefix
    counts as rewritten if its last block is not there any more with its hash, as every sound chain with another prefix has another head.
    A later block of the last one's index counts for that too if its hash is less.
    An edit inside the prefix that leaves the head as it is is not seen; for that, verify all from time to time.
    """
    placed, own = F.col("block_index").isNotNull(), blocks
    new = F.lit(True)
    if seen is not None:
        own = blocks.where((F.col("block_index") >= seen.last_index) | F.col("block_index").isNull())
        new = ~((F.col("block_index") == seen.last_index) & (F.col("hash") <= seen.last_hash))
    c = checked(own).withColumn("new", F.coalesce(new, F.lit(True)))
    found = c.agg(
        F.struct(*_sums(placed & F.col("new"))).alias("own"),
        F.struct(*_sums(~placed)).alias("lost"),
        F.max(F.when(placed, F.struct("block_index", F.coalesce("hash", F.lit("")).alias("hash")))).alias("last"),
        F.count_if(~F.col("new")).alias("old"),
        F.max(F.when(~F.col("new"), F.col("hash"))).alias("old_hash"),
    ).first()
    if seen is not None and (found.old, found.old_hash) != (seen.at_last, seen.last_hash):
        return None, Row(**{k: None for k in SUMS}, is_valid=False)
    sums = {k: found.own[k] + (seen[k] if seen is not None else 0) for k in SUMS}
    told = {k: sums[k] + found.lost[k] for k in SUMS}
    if found.last is None:
        return None, Row(**told, is_valid=told["invalid_blocks"] == 0)
    at_last = blocks.where((F.col("block_index") == found.last.block_index) & (F.col("hash") <= found.last.hash)).count()
    return Row(last_index=found.last.block_index, last_hash=found.last.hash, at_last=at_last, **sums), Row(**told, is_valid=told["invalid_blocks"] == 0)


def verify_on(blocks: DataFrame, path: str) -> DataFrame:
    """chain.verify of blocks, and whether the prefix was rewritten since the last run, which then verifies all anew. The checkpoint under path is read
    and replaced; the new one is in a folder of its own, so a run that fails leaves the one before."""
    from tallychain.streaming.append import read_written

    spark = blocks.sparkSession
    known = read_written(spark, path, f"{CHECKPOINT}, run long").orderBy(F.desc("run")).first()
    after, told = advance(blocks, known)
    rewritten = known is not None and after is None
    if rewritten:
        after, told = advance(blocks)
    if after is not None:
        spark.createDataFrame([after], CHECKPOINT).coalesce(1).write.mode("overwrite").parquet(f"{path}/run={known.run + 1 if known else 0}")
    return spark.createDataFrame([(*[told[k] for k in SUMS], told.is_valid, rewritten)], ", ".join(f"{c} long" for c in SUMS) + ", is_valid boolean, rewritten boolean")
