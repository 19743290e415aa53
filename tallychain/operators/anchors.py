"""Anchors: when to make one, confirming pending ones, contract events, checking a root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.functions.hashing import keccak256_many, unhex_prefixed
from tallychain.operators import merkle


def decide(blocks: DataFrame, anchors: DataFrame, step: int = 50) -> DataFrame:
    """One row: last_block_index, last_anchored (-1 if none), new_blocks, due, reason."""
    last = blocks.agg(F.max("block_index").alias("last_block_index"))
    done = anchors.agg(F.coalesce(F.max("last_block_index"), F.lit(-1)).alias("last_anchored"))
    rows = last.join(F.broadcast(done)).withColumn("new_blocks", F.col("last_block_index") - F.col("last_anchored"))  # one row each
    due = F.coalesce(F.col("new_blocks") >= step, F.lit(False))
    few = F.concat(F.lit("Not enough new blocks ("), F.col("new_blocks").cast("string"), F.lit(f"), wait for {step}."))
    return rows.withColumns({"due": due, "reason": F.when(F.col("last_block_index").isNull(), "No blocks yet.").when(~due, few)})


def confirm(anchors: DataFrame, receipts: DataFrame) -> DataFrame:
    """anchors with pending ones confirmed where their transaction has a block; the others as they are."""
    r = receipts.groupBy("tx_hash").agg(F.max("block_number").alias("mined"))
    hit = (F.col("status") == "pending") & F.col("mined").isNotNull()
    out = anchors.join(r, "tx_hash", "left")
    return out.withColumns({"block_number": F.when(hit, F.col("mined")).otherwise(F.col("block_number")), "status": F.when(hit, "confirmed").otherwise(F.col("status"))}).select(*anchors.columns)


def pending(anchors: DataFrame) -> DataFrame:
    return anchors.where("status = 'pending'")


def by_address(events: DataFrame, address: str) -> DataFrame:
    return events.where(F.lower("technical_address") == address.lower())


def by_organization(events: DataFrame, organization_id: str) -> DataFrame:
    """Events of an organisation, (…, organization_hash): the Keccak-256 that the contract's index holds of its id. Equal ids have equal hashes, so the
    filter is on the id and only the asked one is hashed."""
    return events.where(F.col("organization_id") == organization_id).withColumn("organization_hash", F.lit(keccak256_many([organization_id.encode()])[0].hex()))


def from_args(logs: DataFrame, args: str = "args") -> DataFrame:
    """logs with an array of positional texts (address, root, hash of the organisation's id, its name, domain, seconds) -> the named record; nulls
    where there are no args or not all six."""
    names = ("technical_address", "merkle_root", "organization_id", "organization_name", "domain")
    whole = F.size(args) >= 6
    fields = [F.when(whole, F.col(args)[n]).alias(c) for n, c in enumerate(names)]
    return logs.select(*[c for c in logs.columns if c != args], *fields, F.when(whole, F.col(args)[5].try_cast("bigint")).alias("ts"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An exported event log, JSON lines with args: an array of texts or nothing."""
    return from_args(spark.read.schema("event_no long, args array<string>").json(path))


def new_anchor(blocks: DataFrame, anchors: DataFrame, leaves: DataFrame, tx_hash: str, ts: int, step: int = 50, chain_id: int = 11155111, tree: merkle.Tree = merkle.SORTED) -> DataFrame:
    """The anchor row to append where one is due, else no row: the root over all blocks, pending. The transaction is the caller's."""
    due = decide(blocks, anchors, step).where("due").select("last_block_index")
    return due.join(F.broadcast(merkle.root(leaves, tree))).select(  # one row with one row
        F.concat(F.lit("0x"), "root").alias("merkle_root"), "last_block_index", F.lit(tx_hash).alias("tx_hash"), F.lit(None).cast("long").alias("block_number"), F.lit(chain_id).cast("long").alias("chain_id"), F.lit(ts).cast("long").alias("anchored_at"), F.lit("pending").alias("status")
    )


def manual_anchor(leaves: DataFrame, tx_hash: str, ts: int, block_number: int | None = None, chain_id: int = 11155111) -> DataFrame:
    """An anchor made by hand: due or not, without the index of its last block and without a status."""
    return merkle.root(leaves, merkle.SORTED).select(
        F.concat(F.lit("0x"), "root").alias("merkle_root"), F.lit(None).cast("long").alias("last_block_index"), F.lit(tx_hash).alias("tx_hash"), F.lit(block_number).cast("long").alias("block_number"), F.lit(chain_id).cast("long").alias("chain_id"), F.lit(ts).cast("long").alias("anchored_at"), F.lit(None).cast("string").alias("status")
    )


def anchored(anchors: DataFrame, address: str, organization_id: str, name: str, domain: str) -> DataFrame:
    """The contract event of each anchor, as the log holds it: the organisation's id as its Keccak-256."""
    digest = "0x" + keccak256_many([organization_id.encode()])[0].hex()
    return anchors.select(F.lit(address).alias("technical_address"), "merkle_root", F.lit(digest).alias("organization_id"), F.lit(name).alias("organization_name"), F.lit(domain).alias("domain"), F.col("anchored_at").alias("ts"))


def check_roots(leaves: DataFrame, anchors: DataFrame, tree: merkle.Tree = merkle.POSITIONAL) -> DataFrame:
    """anchors(last_block_index, merkle_root) with the root of the blocks up to there and whether it is the anchor's, whose hex digits may be of either
    case and have 0x before them, as published ones have. Anchors that new_anchor made have the tree merkle.SORTED. An anchor without an
    index or past the last block is not proven."""
    lengths = anchors.select((F.col("last_block_index") + 1).alias("length")).distinct()
    made = merkle.prefix_roots(leaves, lengths, tree).select((F.col("length") - 1).alias("last_block_index"), "root")
    return anchors.join(made, "last_block_index", "left").withColumn("proven", F.coalesce(unhex_prefixed(F.col("merkle_root")) == F.unhex("root"), F.lit(False)))
