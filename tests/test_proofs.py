"""Roots of all anchors' prefixes and inclusion proofs against brute force."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tallychain.operators import merkle
from tallychain.plans import registry
from tallychain.sources import tables as t

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_root(nodes, tree):
    while len(nodes) > 1:
        nodes = tree.up(nodes)
    return nodes[0]


@pytest.mark.parametrize("tree", [merkle.POSITIONAL, merkle.SORTED])
def test_inclusion_proofs_equal_the_plain_ones(spark, tree, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    plain = [hashlib.sha256(str(i).encode()).digest() for i in range(37)]
    leaves = spark.createDataFrame(list(enumerate(plain)), "pos long, leaf binary").repartition(3)
    asked = [(n, p) for n in (1, 2, 3, 5, 16, 17, 21, 37) for p in range(n)] + [(5, 5), (5, -1), (38, 0), (5, 2)]
    found = merkle.inclusion_proofs(leaves, spark.createDataFrame(asked, "length long, pos long"), tree)
    rows = {(r.length, r.pos): ([(s.on_left, bytes(s.node)) for s in r.siblings], r.root) for r in found.collect()}
    assert rows == {(n, p): (merkle.proof(plain[:n], p, tree), plain_root(plain[:n], tree).hex()) for n, p in set(asked) if 0 <= p < n <= 37}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_anchor_is_checked(spark):
    leaves = [bytes.fromhex(r.hash) for r in t.ledger(spark, SF).orderBy("block_index").select("hash").collect()]
    last = [r.last_block_index for r in t.anchors(spark, SF).select("last_block_index").collect()]
    assert len(last) == (len(leaves) - 1) // t.ANCHOR_STEP
    found = {r.last_block_index: r for r in registry.queries()["anchor_proofs"](spark, SF).collect()}
    assert {i: r.root for i, r in found.items()} == {i: plain_root(leaves[: i + 1], merkle.POSITIONAL).hex() for i in last}
    assert {i for i, r in found.items() if not r.proven} == {i for i in last if i // t.ANCHOR_STEP % t.WRONG_ROOT == 0}
    blocks = registry.queries()["inclusion_proofs"](spark, SF).collect()
    assert sorted(r.pos for r in blocks) == list(range(len(leaves))) and all(r.proven for r in blocks)


@pytest.mark.parametrize("tree", [merkle.POSITIONAL, merkle.SORTED, merkle.Tree("sha256", True, False)])
def test_proofs_of_one_run_in_slices_lead_to_the_root(spark, tree, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 3)
    monkeypatch.setattr(merkle, "SLICE", 4)
    plain = [hashlib.sha256(str(i).encode()).digest() for i in range(21)]
    leaves = spark.createDataFrame(list(enumerate(plain)), "pos long, leaf binary").repartition(3)
    asked = [(n, p) for n in range(1, 22) for p in range(n)]
    made = merkle.inclusion_proofs(leaves, spark.createDataFrame(asked, "length long, pos long"), tree)
    wrong = F.when(F.col("pos") % 5 == 0, F.unhex(F.sha2("leaf", 256))).otherwise(F.col("leaf"))
    rows = made.select("length", "pos", "leaf", "siblings", merkle.proven(F.col("leaf"), F.col("siblings"), F.col("root"), tree).alias("right"), merkle.proven(wrong, F.col("siblings"), F.col("root"), tree).alias("other")).collect()
    assert {(r.length, r.pos): [(s.on_left, bytes(s.node)) for s in r.siblings] for r in rows} == {(n, p): merkle.proof(plain[:n], p, tree) for n, p in asked}
    assert all(r.right and bytes(r.leaf) == plain[r.pos] and r.other == (r.pos % 5 > 0) for r in rows)


def test_nodes_beside_a_leaf_are_made_by_the_task_of_its_run(spark):
    leaves = spark.range(10).select(F.col("id").alias("pos"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    plan = merkle.inclusion_proofs(leaves, leaves.selectExpr("10L as length", "pos"))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
