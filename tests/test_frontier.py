"""Growing Merkle trees: the frontier against whole trees, and published anchors checked against them."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallychain.functions import hashing
from tallychain.operators import anchors, chain, frontier, merkle
from tallychain.streaming import append

TREES = [merkle.POSITIONAL, merkle.SORTED, merkle.Tree("sha256", True, False)]
LEAVES = [hashlib.sha256(str(i).encode()).digest() for i in range(300)]


def plain_root(nodes, tree):
    while len(nodes) > 1:
        nodes = tree.up(nodes)
    return nodes[0]


@pytest.mark.parametrize("tree", TREES)
def test_root_of_every_length(tree):
    peaks = {}
    for n, leaf in enumerate(LEAVES):
        left, up = frontier.climb(n, [leaf], peaks, 0, 12, tree)
        peaks = {level: x for level, _, x in left}
        assert not up and frontier.length(peaks) == n + 1
        assert all(pos == (n + 1 >> level) - 1 for level, pos, _ in left)
        assert frontier.root(peaks, tree) == plain_root(LEAVES[: n + 1], tree)
    assert frontier.root({}, tree) is None


@pytest.mark.parametrize("tree, levels", [(TREES[0], 1), (TREES[1], 3)])
def test_batches_of_any_size(spark, tree, levels):
    r, done, peaks = random.Random(levels), 0, {}
    for size in (1, 0, 6, 57, 64, 103):
        rows = list(enumerate(LEAVES))[done : done + size]
        r.shuffle(rows)
        peaks = frontier.extended(peaks, spark.createDataFrame(rows, "pos long, leaf binary").repartition(3), tree, levels)
        done += size
        assert frontier.length(peaks) == done and frontier.root(peaks, tree) == plain_root(LEAVES[:done], tree)
        assert frontier.taken(frontier.frame(spark, peaks).collect()) == peaks


@pytest.mark.parametrize("positions", [[1, 2], [0, 2], [0, 0], [None]])
def test_leaves_that_do_not_follow_are_an_error(spark, positions):
    with pytest.raises(ValueError, match="do not follow"):
        frontier.extended({}, spark.createDataFrame([(p, LEAVES[0]) for p in positions], "pos long, leaf binary"))


def test_streamed_anchors_are_proven(spark, tmp_path, monkeypatch):
    source, sink, mark, kept = (str(tmp_path / x) for x in ("in", "out", "mark", "anchors"))
    read = []
    extended = frontier.extended
    monkeypatch.setattr(frontier, "extended", lambda peaks, leaves, tree: (read.append(leaves.count()), extended(peaks, leaves, tree))[1])
    for start, size in ((0, 30), (30, 0), (30, 5), (35, 40), (75, 1)):
        spark.range(start, start + size).selectExpr("id as ord", "id as ts", "'{}' as data").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ord long, ts long, data string").parquet(source)
        append.append_stream(stream, sink, mark, append.anchoring(kept, lambda root: "0xtx", 10, lambda: 3)).awaitTermination(120)
    assert [x for x in read if x] == [30, 5, 40, 1]  # each batch's own blocks
    blocks = append.read_chain(spark, sink)
    assert chain.verify(blocks).first().is_valid and blocks.count() == 76
    leaves = blocks.select(F.col("block_index").alias("pos"), hashing.unhex_strict(F.col("hash")).alias("leaf"))
    made = spark.read.parquet(kept).select("last_block_index", "merkle_root")
    wrong = made.limit(1).select("last_block_index", F.lit("0x00").alias("merkle_root")).union(spark.createDataFrame([(None, "0x1"), (500, "zz"), (29, None)], made.schema))
    found = anchors.check_roots(leaves, made.union(wrong), merkle.SORTED).collect()
    assert sorted(r.last_block_index for r in found if r.proven) == [29, 74] and sum(not r.proven for r in found) == 4
    assert not any(r.proven for r in anchors.check_roots(leaves, made, merkle.POSITIONAL).collect())
