"""Statistics kept batch by batch against those of all blocks."""

import pytest
from pyspark.sql import functions as F

from tallychain.operators import chain, lookups, maintained
from tallychain.sources import tables
from tallychain.streaming import append

ANCHORS = [("0x1", 9, "0xt", 90, 1, 5, "confirmed")]


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def made(spark, n=60):
    kind = F.when(F.col("id") % 3 == 0, "model_registration").otherwise("inference")
    model = F.when(F.col("id") == 0, "genesis").when(F.col("id") % 11 != 5, F.concat(F.lit("m"), (F.col("id") % 7).cast("string")))
    rows = spark.range(n).select(F.col("id").alias("block_index"), (F.col("id") + 1700000000).alias("ts"), F.to_json(F.struct(model.alias("modelId"), kind.alias("type"))).alias("data"))
    return chain.fold(rows)


def test_every_batch_equals_the_whole(spark, tmp_path):
    path, anchors = str(tmp_path / "stats"), spark.createDataFrame(ANCHORS, append.ANCHORS)
    blocks = tables.write_chain(tables.tampered(made(spark)).withColumn("previous_hash", F.when(F.col("block_index") == 20, "x").otherwise(F.col("previous_hash"))))
    assert rows_of(maintained.stats(spark, path, anchors)) == rows_of(lookups.stats(blocks.limit(0), anchors))
    edges = [0, 1, 20, 20, 47, 60]
    for number, (lo, hi) in enumerate(zip(edges, edges[1:])):
        own = blocks.where((F.col("block_index") >= lo) & (F.col("block_index") < hi))
        for _ in range(2 if number == 2 else 1):  # a batch that runs again counts once
            maintained.fold_batch(own, path, number)
        so_far = blocks.where(F.col("block_index") < hi)
        assert rows_of(maintained.stats(spark, path, anchors)) == rows_of(lookups.stats(so_far, anchors))
        assert rows_of(maintained.stats(spark, path, anchors, number)) == rows_of(lookups.stats(so_far, anchors))
        assert rows_of(maintained.per_model(spark, path)) == rows_of(lookups.per_model(so_far))
    last = maintained.stats(spark, path, anchors).first()
    assert (last.total_blocks, last.error_count, last.chain_valid) == (60, 2, False)  # block 20 has a wrong hash and a broken link
    assert rows_of(maintained.per_model(spark, path, "m3")) == rows_of(lookups.per_model(blocks).where("model_id = 'm3'"))


def test_batches_out_of_order_are_an_error(spark, tmp_path):
    path, blocks = str(tmp_path / "stats"), tables.promoted(made(spark, 6))
    with pytest.raises(ValueError, match="batch 0 has no statistics"):
        maintained.fold_batch(blocks, path, 1)
    maintained.fold_batch(blocks.where("block_index >= 3"), path, 0)
    with pytest.raises(ValueError, match="block 0 comes after block 5"):
        maintained.fold_batch(blocks.where("block_index < 3"), path, 1)


def test_a_block_without_an_index_is_a_broken_link(spark, tmp_path):
    path, blocks = str(tmp_path / "stats"), tables.promoted(made(spark, 6))
    odd = blocks.where("block_index = 4").withColumn("block_index", F.lit(None).cast("long"))
    maintained.fold_batch(blocks.union(odd), path, 0)
    found = maintained.stats(spark, path, spark.createDataFrame([], append.ANCHORS)).first()
    whole = chain.verify(blocks.union(odd)).first()
    assert (found.total_blocks, found.error_count, found.last_block_index) == (7, whole.bad_hash + whole.broken_links, 5) and found.anchor_tx_hash is None


def test_a_stream_keeps_them(spark, tmp_path):
    source, sink, mark, kept = (str(tmp_path / x) for x in ("in", "out", "mark", "kept"))
    rows = spark.range(30).select(F.col("id").alias("ord"), (F.col("id") + 1700000000).alias("ts"), F.concat(F.lit('{"modelId":"m'), (F.col("id") % 4).cast("string"), F.lit('","type":"inference"}')).alias("data"))
    for part in (rows.where("ord < 11"), rows.where("ord >= 11")):
        part.coalesce(1).write.mode("append").parquet(source)
        append.append_stream(spark.readStream.schema(rows.schema).parquet(source), sink, mark, maintained.keeping(kept)).awaitTermination(120)
    anchors = spark.createDataFrame(ANCHORS, append.ANCHORS)
    whole = tables.promoted(append.read_chain(spark, sink).drop("batch_id"))
    assert rows_of(maintained.stats(spark, kept, anchors)) == rows_of(lookups.stats(whole, anchors))
    assert rows_of(maintained.per_model(spark, kept)) == rows_of(lookups.per_model(whole))
