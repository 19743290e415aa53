"""Chains whose stored payloads keep keys that the hash leaves out, and what registrations and requests are told."""

import hashlib
import json

from tallychain.operators import chain, writes

MODEL = "model_id string, name string, version string"
ASKED = "ord long, ts long, model_id string, inference_id string, payload string"
ROWS = [
    (1, 10, "m", "i1", '{"modelId":"m","createdAt":"then","inputHash":"aa","outputHash":"bb","nested":{"hash":"stays"},"hash":"zz"}'),
    (2, 11, "m", "i2", '{"modelId":"m","inputHash":"cc"}'),
    (3, 12, "m", "i3", "no json"),
    (4, 13, "other", "i4", '{"inputHash":"dd"}'),
]


def test_kept_keys_are_stored_and_not_hashed(spark):
    models = spark.createDataFrame([("m", "n", "1")], MODEL)
    written = writes.log_inferences(spark.createDataFrame([], chain.BLOCKS), models, spark.createDataFrame(ROWS, ASKED), 5, keep=True)
    blocks = written.blocks.orderBy("block_index").collect()
    assert json.loads(blocks[1].data)["createdAt"] == "then" and json.loads(blocks[1].data)["hash"] == "zz"
    covered = '{"inputHash":"aa","modelId":"m","nested":{"hash":"stays"},"outputHash":"bb"}'
    assert blocks[1].hash == hashlib.sha256(f"1|10|{covered}|{blocks[0].hash}".encode()).hexdigest()
    assert blocks[0].hash == hashlib.sha256(f"0|5|{chain.GENESIS_DATA}|0".encode()).hexdigest()
    assert chain.verify(written.blocks, "excluding").first().is_valid
    assert chain.verify(written.blocks).first().bad_hash == 1  # by its stored text the first request's block reads as changed
    acks = {r.inference_id: r for r in written.acks.collect()}
    assert tuple(acks["i1"].hashes) == ("aa", "bb") and tuple(acks["i2"].hashes) == ("cc", None) and tuple(acks["i3"].hashes) == (None, None)
    assert acks["i4"].hashes.input == "dd" and not acks["i4"].success and acks["i4"].block is None


def test_texts_that_are_not_canonical_or_no_json(spark):
    made = chain.fold(spark.createDataFrame([(0, 1, '{"b": 1, "a": 2, "_id": 3}', '{"a":2,"b":1}'), (1, 2, "plain", None), (2, 3, None, None)], "block_index long, ts long, data string, covered string"))
    assert made.columns == ["block_index", "ts", "data", "previous_hash", "hash"]
    assert chain.verify(made, "excluding").first().is_valid and chain.errors(made, "excluding").isEmpty()
    assert [r.block_index for r in chain.errors(made).collect()] == [0]


def test_registry_rows_have_the_payloads_parts(spark):
    asked = spark.createDataFrame([(1, 10, "m", "n", "1", '{"params":{"a":[1,{"b":"x"}]},"metrics":{"f1":0.5},"mlflow":{"modelHash":"h","gitCommit":"g"}}'), (2, 11, "k", "o", "1", '{"modelHash":"flat"}'), (3, 12, "m", "n", "1", "{}")], "ord long, ts long, model_id string, name string, version string, payload string")
    written = writes.register_models(spark.createDataFrame([], chain.BLOCKS), spark.createDataFrame([], MODEL), asked, 5)
    rows = {r.model_id: r for r in written.models.collect()}
    assert tuple(rows["m"])[4:] == ('{"a":[1,{"b":"x"}]}', '{"f1":0.5}', None) and tuple(rows["k"])[4:] == (None, None, None)
    acks = {r.ord: r for r in written.acks.collect()}
    assert tuple(acks[1].mlflow) == ("h", "g") and tuple(acks[2].mlflow) == ("flat", None) and tuple(acks[3].mlflow) == (None, None)
    assert [acks[n].success for n in (1, 2, 3)] == [True, True, False]
