"""Verification in several runs against one of all blocks, and what it reads."""

from pyspark.sql import functions as F

from tallychain.operators import chain, verification
from tallychain.sources import tables

NAMES = ["total", "bad_hash", "broken_links", "invalid_blocks", "is_valid"]


def test_runs_equal_one_of_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PER_RANGE", 50)
    path, store = str(tmp_path / "checkpoints"), str(tmp_path / "blocks")
    made = chain.fold(spark.range(300).selectExpr("id as block_index", "id as ts", "'{}' as data"))
    tables.write_blocks(tables.tampered(made), store)
    blocks = tables.read_blocks(spark, store).drop("index_range")
    lost = blocks.where("block_index = 7").withColumn("block_index", F.lit(None).cast("long"))
    fork = blocks.where("block_index = 149").withColumn("hash", F.lit("zz"))
    whole = lambda df: tuple(chain.verify(df).select(*NAMES).first())
    for df in (blocks.where("block_index < 120"), blocks.where("block_index < 120"), blocks.where("block_index < 150").union(lost), blocks.where("block_index < 150").union(fork).union(lost), blocks.union(fork)):
        found = verification.verify_on(df, path).first()
        assert tuple(found[n] for n in NAMES) == whole(df) and not found.rewritten
    seen = spark.read.parquet(path).orderBy(F.desc("run")).first()
    assert (seen.last_index, seen.total, seen.run) == (299, 301, 4)
    # a chain with another prefix has another head
    other = chain.fold(spark.range(320).selectExpr("id as block_index", "id + 1 as ts", "'{}' as data"))
    found = verification.verify_on(other, path).first()
    assert found.rewritten and tuple(found[n] for n in NAMES) == whole(other) == (320, 0, 0, 0, True)
    assert not verification.verify_on(other, path).first().rewritten


def test_an_empty_chain_has_no_checkpoint(spark, tmp_path):
    found = verification.verify_on(spark.createDataFrame([], chain.BLOCKS), str(tmp_path / "c")).first()
    assert (found.total, found.is_valid, found.rewritten) == (0, True, False)


def test_only_new_blocks_are_read(spark):
    seen = spark.createDataFrame([(250, "x", 1, 9, 0, 0, 0)], verification.CHECKPOINT).first()
    stored = tables.write_chain(chain.fold(spark.range(300).selectExpr("id as block_index", "id as ts", "'{}' as data")), 100)
    own = stored.where((F.col("block_index") >= seen.last_index) | F.col("block_index").isNull())
    plan = own._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(block_index,250)" in plan[plan.index("PushedFilters") :]
    assert verification.advance(stored, seen)[0] is None  # that block has another hash
