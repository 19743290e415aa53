"""Golden vectors and properties of canonical texts, digests, the chain and Merkle trees."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallychain.functions import canonical, hashing
from tallychain.operators import chain, lookups, merkle, registry

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)
LEAVES = [hashlib.sha256(x.encode()).digest() for x in "abcde"]
POSITIONAL = {
    1: "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb",
    2: "e5a01fee14e0ed5c48714f22180f25ad8365b53f9779f79dc4a3d7e93963f94a",
    3: "d31a37ef6ac14a2db1470c4316beb5592e6afd4465022339adafda76a18ffabe",
    5: "dd14d0ba516bb654a3052b76f051db026f4e322d0be081468fab99440f9e7305",
}
SORTED = {
    1: "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb",
    2: "0f37367a629552a9b68f64ce688d1eb0a4820ad50ac4baed79496c8fb93fa1b7",
    3: "a946150c2c3313a1083a335b6ee2b5889b3cc3f19d999e8a84cf4f2882f78705",
    5: "14e90dbf467bb33f8b30a7f54fc7f601e03ae8dbf4073048925212510e0d3b36",
}


def plain_root(nodes, tree):
    while len(nodes) > 1:
        nodes = tree.up(nodes)
    return nodes[0]


@pytest.mark.parametrize("number, text", [(1.0, "1"), (1e21, "1e+21"), (1e-7, "1e-7"), (-0.0, "0"), (0.1, "0.1"), (1e20, "100000000000000000000"), (123, "123")])
def test_number_text(number, text):
    assert canonical.number_text(number) == text


@given(VALUES)
@settings(max_examples=100, deadline=None)
def test_canonical_is_json_and_ignores_key_order(value):
    text = canonical.canonical(value)
    assert json.loads(text) == value
    turned = json.loads(text, object_pairs_hook=lambda kv: dict(reversed(kv)))
    assert canonical.canonical(turned) == text


@pytest.mark.parametrize("mode", ["writer", "reader"])
@given(value=VALUES)
@settings(max_examples=60, deadline=None)
def test_reader_cleaning_is_idempotent(mode, value):
    once = canonical.clean({"k": value}, "reader")
    assert canonical.clean(once, "reader") == once


def test_clean_keeps_zero_and_false_and_drops_empty():
    value = {"a": 0, "b": False, "c": None, "d": "", "e": {}, "f": {"g": None}, "h": [1, None, ""]}
    assert canonical.clean(value, "reader") == {"a": 0, "b": False, "h": [1]}
    written = canonical.clean(value, "writer")
    assert written["a"] == 0 and written["b"] is False and "c" not in written and "d" not in written


@pytest.mark.parametrize("data, digest", [
    (b"", "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"),
    (b"abc", "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"),
    (b"5b87e82b-6f7b-44b3-bf45-93dc84ef7110", "b3f83fcbaa18a8a6ed16c779a3158280c64c5bbd1337f89f51503a3b43dadd06"),
])
def test_keccak_golden(data, digest):
    assert hashing.keccak256_many([data])[0].hex() == digest


def test_keccak_with_the_other_padding_is_sha3():
    items = [bytes([i % 251]) * n for i, n in enumerate([0, 1, 135, 136, 137, 271, 272, 1000])]
    assert hashing.keccak256_many(items, pad=6) == [hashlib.sha3_256(x).digest() for x in items]


@pytest.mark.parametrize("tree, golden", [(merkle.POSITIONAL, POSITIONAL), (merkle.SORTED, SORTED)])
def test_merkle_golden(tree, golden):
    assert {n: plain_root(LEAVES[:n], tree).hex() for n in golden} == golden


@pytest.mark.parametrize("tree", [merkle.POSITIONAL, merkle.Tree(sort_pairs=True, duplicate=False)])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 4096, 4097, 9000])
def test_merkle_root_on_spark_equals_the_plain_one(spark, tree, n):
    leaves = spark.range(n).select(F.col("id").alias("pos"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    plain = plain_root([hashlib.sha256(str(i).encode()).digest() for i in range(n)], tree)
    row = merkle.root(leaves, tree).collect()
    assert [(r.n_leaves, r.root) for r in row] == [(n, plain.hex())]


@pytest.mark.parametrize("tree", [merkle.POSITIONAL, merkle.SORTED])
def test_prefix_roots_equal_the_plain_ones(spark, tree, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    plain = [hashlib.sha256(str(i).encode()).digest() for i in range(70)]
    leaves = spark.createDataFrame([(i, x) for i, x in enumerate(plain)], "pos long, leaf binary").repartition(3)
    wanted = [*range(-1, 20), 31, 32, 33, 64, 65, 69, 70, 70, 71]
    found = merkle.prefix_roots(leaves, spark.createDataFrame([(n,) for n in wanted], "length long"), tree).collect()
    assert {r.length: r.root for r in found} == {n: plain_root(plain[:n], tree).hex() for n in wanted if 0 < n <= 70}
    assert len(found) == len(set(wanted)) - 3


def test_merkle_without_leaves_has_no_row(spark):
    assert merkle.root(spark.createDataFrame([], "pos long, leaf binary")).count() == 0


@pytest.mark.parametrize("tree", [merkle.POSITIONAL, merkle.SORTED])
def test_proofs(tree):
    for pos in range(5):
        siblings = merkle.proof(LEAVES, pos, tree)
        assert merkle.proves(LEAVES[pos], siblings, plain_root(LEAVES, tree), tree)
        assert not merkle.proves(LEAVES[pos - 1], siblings, plain_root(LEAVES, tree), tree)


def test_strict_hex_raises(spark):
    one = spark.createDataFrame([("not_valid_hex",)], "h string")
    with pytest.raises(Exception, match="invalid hex"):
        one.select(hashing.unhex_strict(F.col("h"))).collect()


def test_block_hash_golden(spark):
    data = '{"executedAt":"2023-11-14T22:13:21.000Z","inferenceId":"i-1","inputHash":"aa","modelId":"m-1","outputHash":"bb","type":"inference"}'
    before = "29d53a04417b7d91e6246207cfddd2d01e0687ce6407bf42b8d01bb4ca293995"
    row = spark.createDataFrame([(1, 1700000001, data, before)], "i long, ts long, data string, p string")
    found = row.select(hashing.block_hash(F.col("i"), F.col("ts"), F.col("data"), F.col("p"))).first()[0]
    assert found == "b371a0b9a737303c6c0765d6a0c7b771c107cdea5c6ba40f39749457c7f26f6b"


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    rows = spark.range(3000).select(F.col("id").alias("block_index"), (F.col("id") + 1700000000).alias("ts"), F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}")).alias("data"))
    path = str(tmp_path_factory.mktemp("chain"))
    chain.fold(rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_built_chain_is_valid(spark, blocks):
    last = "0"
    for i in range(3000):
        last = hashlib.sha256(f'{i}|{1700000000 + i}|{{"n":{i}}}|{last}'.encode()).hexdigest()
    assert lookups.by_index(blocks, 2999).first().hash == last
    assert chain.verify(blocks).first().asDict() == {"total": 3000, "bad_hash": 0, "broken_links": 0, "invalid_blocks": 0, "is_valid": True}


@pytest.mark.parametrize("column, value, bad, broken", [("data", "x", 1, 0), ("ts", 5, 1, 0), ("previous_hash", "x", 1, 1), ("hash", "x", 1, 1)])
def test_one_tampered_block(blocks, column, value, bad, broken):
    off = blocks.withColumn(column, F.when(F.col("block_index") == 1500, F.lit(value)).otherwise(F.col(column)))
    row = chain.verify(off).first()
    assert (row.bad_hash, row.broken_links, row.is_valid) == (bad, broken, False)
    at = {1500} | ({1501} if column == "hash" else set())
    assert {r.block_index for r in chain.errors(off).collect()} == at


def test_empty_chain_is_valid(spark):
    assert chain.verify(spark.createDataFrame([], chain.BLOCKS)).first().is_valid


def test_gap_and_fork(blocks):
    off = blocks.where("block_index <> 7").unionByName(blocks.where("block_index = 20"))
    assert sorted(tuple(r) for r in chain.gaps(off).collect()) == [(8, 6), (20, 20)]


def test_page_without_limit(blocks):
    assert lookups.page(blocks, ["block_index"], 0, 2990).count() == 10
    assert lookups.page(blocks, ["block_index"], 10, 5000).count() == 0


def test_guards(spark):
    models = spark.createDataFrame([("m-1", "n", "1")], "model_id string, name string, version string")
    asked = spark.createDataFrame([("m-1", "a"), ("m-2", "b"), (None, "c")], "model_id string, inference_id string")
    assert [r.inference_id for r in registry.accept_inferences(asked, models).collect()] == ["a"]
    assert sorted(r.inference_id for r in registry.reject_inferences(asked, models).collect()) == ["b", "c"]
