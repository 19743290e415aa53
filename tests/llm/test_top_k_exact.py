"""Exact top-k scores of any size, over many blocks, with ties, negative, equal, short and repeated vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallychain.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score string, block long"


def plain(rows, k=5):
    whole = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault(i, []).append([int(np.floor(256 * x)) for x in v])
    out = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(min(whole[q]), w)), j) for j, ws in whole.items() if j != q for w in ws)[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)
    return sorted((r.query_id, r["rank"], r.vec_id, int(r.digits)) for r in topk.top_k(df, **how).collect())


@pytest.fixture
def small_cells(monkeypatch):
    for name, value in {"BLOCK_ROWS": 16, "CELL_BLOCKS": 2, "BATCH_LEAST": 2, "BATCH_MOST": 3, "AT_ONCE": 2}.items():
        monkeypatch.setattr(topk, name, value)


@pytest.mark.parametrize("most", [1, 3e5, 1e9, 1e15, 1e300])
def test_components_of_any_size(spark, small_cells, most):
    r, most = random.Random(str(most)), float(most)
    rows = [(i, [r.uniform(-most, most) for _ in range(6)]) for i in range(180)]
    rows += [(200 + i, rows[i][1]) for i in range(9)] + [(0, rows[0][1]), (100, rows[3][1])]
    rows += [(400, [most, 1.0]), (401, [most / 2, 1.0]), (402, [-most] * 6), (450, [0.0] * 6), (403, []), (404, None), (405, [most, None])]
    assert found(spark, rows) == plain(rows)


def test_scores_beyond_the_old_bound(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e6, 1.0]), (2, [5e5, 1.0])]
    assert found(spark, rows) == [(0, 1, 1, 65536065536), (0, 2, 2, 32768065536)]


def test_all_equal(spark, small_cells):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(120)]
    assert found(spark, rows) == plain(rows)


def test_scores_of_any_length_are_ranked(spark):
    rows = [(0, [1e300, 1.0]), (1, [1.0, 0.0]), (2, [1e300, 0.0]), (3, [-1e300, 3.0]), (4, [1e306, 0.0]), (5, [3e14, 1e9]), (50, [1e9, 1e-3])]
    assert found(spark, rows) == plain([x for x in rows if x[0] != 4])
    df = topk.top_k(spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)).withColumn("long", topk.as_long(F.col("score"), F.col("digits"))).collect()
    far = {(r.query_id, r.vec_id): (r.score, r.long) for r in df}
    assert far[0, 2] == (None, 2**63 - 1) and far[0, 3] == (None, -(2**63)) and far[50, 1] == (256 * 256 * 10**9, 256 * 256 * 10**9)
    assert far[50, 5][1] == 2**63 - 1 and int(far[50, 5][0]) == 65536 * 3 * 10**23


def test_texts_have_the_order_of_numbers():
    r = random.Random(7)
    numbers = [r.choice([-1, 1]) * r.randrange(10 ** r.randrange(1, 700)) for _ in range(500)] + [0, 9, 10, -9, -10, 99, 100]
    assert sorted(numbers) == sorted(numbers, key=topk.ordered_text)


def test_wide_vectors_make_small_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i)] * 3000) for i in range(200)], "vec_id long, embedding array<double>").coalesce(1)
    sizes = [len(r.ids) // 8 for r in topk.blocks(topk.quantized(rows)).collect()]
    assert sum(sizes) == 200 and max(sizes) == topk.BLOCK_CELLS // 3000


def test_blocks_under_the_floor_are_not_read(monkeypatch):
    r = np.random.default_rng(1)
    near, far = r.integers(200, 256, (64, 8)).astype(float), r.integers(0, 50, (64, 8)).astype(float)
    batch = topk.Batch(np.array([-1]), np.full((1, 8), 100.0), 5)
    batch.search(np.arange(64), topk.SortedLists(near))
    lists = topk.SortedLists(far)
    monkeypatch.setattr(lists, "qualify", lambda *a: pytest.fail("read"))
    before = list(batch.found[0])
    batch.search(np.arange(64, 128), lists)
    assert batch.found[0] == before and len(before) == 5


def test_half_of_the_lists_leaves_few(monkeypatch):
    r = np.random.default_rng(2)
    data = np.floor(256 * r.standard_normal((4096, 64)) / 8)
    lists, q = topk.SortedLists(data), np.floor(256 * r.standard_normal((1, 64)) / 8)
    floor = np.sort(data @ q[0])[-5]
    rows = lists.qualify(q, 5, np.array([floor]), np.zeros((1, 4096), bool))[0]
    assert max(d for d, _ in lists.stages) <= 0.65 * 4096 and len(rows) <= 4096 // 20
    assert set(np.argsort(data @ q[0])[-5:]) <= set(rows)
