"""Rows without a key and keys that repeat: numbered, verified under their own name, acknowledged once."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallychain.operators import chain, numbering, writes


def test_null_keys_come_last(spark):
    rows = spark.createDataFrame([(3, "c"), (None, "y"), (-(10**15), "a"), (None, "x"), (3, "d")], "k long, v string").repartition(2)
    for span in (2, 1 << 16):
        assert [r.v for r in numbering.numbered(rows, "k", "n", 5, "v", span).orderBy("n").collect()] == ["a", "c", "d", "x", "y"]
        assert {r.v: r.b for r in numbering.with_previous(rows, "k", "v", "b", "v", span).collect()} == {"a": None, "c": "a", "d": "c", "x": "d", "y": "x"}


@pytest.mark.parametrize("mode", ["writer", "reader"])
def test_a_block_without_an_index_is_reported_itself(spark, mode):
    blocks = chain.fold(spark.range(10).select(F.col("id").alias("block_index"), F.lit(1).cast("long").alias("ts"), F.lit("{}").alias("data")))
    lost = blocks.where("block_index = 4").withColumn("block_index", F.lit(None).cast("long"))
    found = chain.verify(blocks.union(lost), mode).first()
    assert (found.total, found.broken_links, found.invalid_blocks, found.is_valid) == (11, 1, 1, False)
    messages = [(r.block_index, r.message) for r in chain.errors(blocks.union(lost), mode).collect()]
    assert {i for i, _ in messages} == {None} and all(m.startswith("Block without index: ") for _, m in messages)
    only = chain.verify(lost, mode).first()
    assert (only.total, only.is_valid) == (1, False)


def test_every_request_has_one_acknowledgement(spark):
    asked = [(None, 5, "m", f"i{n}", f'{{"n":{n}}}') for n in range(3)] + [(7, 5, "m", f"j{n}", f'{{"n":{n},"j":1}}') for n in range(4)] + [(1, None, "m", None, '{"n":9}'), (None, 5, None, "k", "{}"), (2, 5, "m", "z", None)]
    df = spark.createDataFrame(asked, "ord long, ts long, model_id string, inference_id string, payload string").repartition(4)
    models = spark.createDataFrame([("m",)], "model_id string")
    made = writes.log_inferences(spark.createDataFrame([], chain.BLOCKS), models, df, 3)
    acks = made.acks.collect()
    assert Counter(r.inference_id for r in acks) == Counter(r[3] for r in asked)
    blocks = {b.block_index: b for b in made.blocks.collect()}
    good = [r for r in acks if r.success]
    assert sorted(r.block["index"] for r in good) == list(range(1, 9)) == sorted(set(blocks) - {0})
    payload = {"i0": 0, "i1": 1, "i2": 2, "j0": 0, "j1": 1, "j2": 2, "j3": 3, None: 9}
    for r in good:
        own = blocks[r.block["index"]]
        assert own.hash == r.block.hash and f'"n":{payload[r.inference_id]}' in own.data and ('"j"' in own.data) == str(r.inference_id).startswith("j")
    assert chain.verify(made.blocks).first().is_valid
    assert {r.inference_id: r.reason for r in acks if not r.success} == {"k": "Model ID null does not exist", "z": "no payload"}
