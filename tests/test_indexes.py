"""The index of hashes by what its reads touch, and registrations in chains of clashes."""

import math
import random

import pytest

from tallychain.operators import chain, components, hash_index, lookups, registry
from tallychain.sources import tables


def files_read(df):
    """Rows, and the files that the scans of df read."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        total += metrics.apply("numFiles").value() if metrics.contains("numFiles") else 0
    return rows, total


@pytest.mark.parametrize("batches", [4])
def test_a_lookup_reads_one_bucket_and_one_range(spark, tmp_path, monkeypatch, batches):
    monkeypatch.setattr(tables, "PER_RANGE", 100)
    monkeypatch.setattr(hash_index, "DIGITS", 1)
    blocks, index, tip = str(tmp_path / "blocks"), str(tmp_path / "hashes"), spark.createDataFrame([], chain.BLOCKS)
    for n in range(batches):
        rows = spark.range(n * 1000 // batches, (n + 1) * 1000 // batches).selectExpr("id as ord", "id as ts", "'{}' as data")
        tables.write_blocks(chain.append(tip, rows), blocks)
        tip = tables.read_blocks(spark, blocks).select(*tip.columns)
    stored = tables.read_blocks(spark, blocks)
    for n in range(batches):
        hash_index.write(stored.where(f"block_index div {1000 // batches} = {n}").coalesce(1), index)
    wanted = {r.block_index: r.hash for r in stored.where("block_index in (0, 99, 100, 777, 999)").collect()}
    for i, hash_ in wanted.items():
        rows, files = files_read(hash_index.by_hash(stored, index, hash_))
        assert [r.block_index for r in rows] == [i] and files <= batches + 1 < len(stored.inputFiles())
        entries = hash_index.read(spark, index).where(f"bucket = '{hash_[:1]}' and hash = '{hash_}'")
        assert files_read(entries)[1] <= batches
        assert rows[0].asDict() == lookups.by_hash(stored, hash_).first().asDict()
    assert hash_index.by_hash(stored, index, "zz").count() == 0 == hash_index.by_hash(stored, index, "").count()
    hash_index.compact(spark, index, str(tmp_path / "compact"))
    assert hash_index.read(spark, str(tmp_path / "compact")).count() == 1000


def one_by_one(asked):
    names, ids, out = set(), set(), []
    for m, n, v in asked:
        reason = "name and version exist" if (n, v) in names else "model and version exist" if (m, v) in ids else None
        if reason is None:
            names.add((n, v))
            ids.add((m, v))
        out.append(reason is None)
    return out


def test_a_chain_of_clashes_takes_few_rounds(spark, monkeypatch):
    size, rounds, staged = 1500, [], components.staged
    asked = [(f"m{(i + 1) // 2}", f"n{i // 2}", "1") for i in range(size)]
    monkeypatch.setattr(components, "staged", lambda df, name: (rounds.append(name), staged(df, name))[1])
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "ord long, model_id string, name string, version string").repartition(4)
    none = spark.createDataFrame([], "model_id string, name string, version string")
    found = [r.reason is None for r in registry.registrations(df, none, "ord").orderBy("ord").collect()]
    assert found == one_by_one(asked) and 2 < len(rounds) <= 2 * math.log2(size)


def test_nulls_and_ties(spark):
    asked = [(None, None, "1"), (None, "x", "1"), ("a", None, "1"), ("b", "y", None), ("b", "z", None)]
    rows = [(i, *x) for i, x in enumerate(asked)] + [(9, "t", "t", "1"), (9, "t", "t", "1"), (None, "t", "u", "1")]
    df = spark.createDataFrame(rows, "ord long, model_id string, name string, version string")
    none = spark.createDataFrame([], "model_id string, name string, version string")
    found = registry.registrations(df, none, "ord").collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.ord, []).append(r.reason is None)
    assert [by[i] for i in range(5)] == [[True], [False], [False], [True], [False]] and sorted(by[9]) == [False, True] and by[None] == [False]
