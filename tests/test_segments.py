"""What one task may read: segments of a chain, pages without a limit."""

import random

import pytest
from pyspark.sql import functions as F

from tallychain.operators import chain, lookups


@pytest.mark.parametrize("indices", [range(100), [*range(0, 5000, 50)], [None, *range(7, 90), 10**12, 10**12 + 1], [3], []])
def test_segments_make_the_same_chain(spark, indices, monkeypatch):
    rows = [(i, 7 if i is None else i + 5, f"d{i}", None if n % 3 else f"c{n}") for n, i in enumerate(indices)]
    random.Random(2).shuffle(rows)
    given = spark.createDataFrame(rows, "block_index long, ts long, data string, covered string").repartition(5)
    read, real = [], chain._hashed

    def seen(dealt, *rest):
        read.append(dealt.count())
        assert dealt.rdd.getNumPartitions() <= 1
        return real(dealt, *rest)

    monkeypatch.setattr(chain, "_hashed", seen)
    columns = ["block_index", "ts", "data", "previous_hash", "hash"]
    found = chain.fold(given, "first", segment=16)
    assert found.columns == columns and max(read, default=0) <= 16 and sum(read) == len(rows)
    last, want = "first", []
    for i, ts, data, covered in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        hashed = chain.hashlib.sha256(f"{'' if i is None else i}|{ts}|{covered or data}|{last}".encode()).hexdigest()
        want.append((i, ts, data, last, hashed))
        last = hashed
    order = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in found.collect()), key=order) == want
    assert sorted((tuple(r) for r in chain.fold(given, "first").collect()), key=order) == want


@pytest.mark.parametrize("skip", [0, 1, 37, 299, 300, 999])
@pytest.mark.parametrize("order", [lambda: ["a", "b"], lambda: [F.desc_nulls_last("b"), F.col("a")]])
def test_pages_without_a_limit_are_many_tasks(spark, order, skip):
    rows = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("a"), (F.col("id") * 37 % 300).alias("b")).repartition(6)
    order = order()
    found = lookups.page(rows, order, 0, skip)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in rows.orderBy(*order).collect()][skip:]
    assert "Offset" not in found._jdf.queryExecution().optimizedPlan().toString()
