"""Changes of stored tables: which folders they rewrite, and what a run that fails leaves."""

import os
import shutil
from glob import glob

import pytest
from pyspark.sql import functions as F

from tallychain.operators import anchors, registry
from tallychain.sources import buckets
from tallychain.streaming.append import ANCHORS

MODELS = [(f"m{i}", f"n{i}", v, i) for i in range(200) for v in ("1", "2")] + [(None, "odd", "1", 0)]


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def files(path):
    """The data files of each folder."""
    found = {}
    for f in glob(f"{path}/bucket=*/*.parquet"):
        found.setdefault(os.path.basename(os.path.dirname(f)), set()).add(os.path.basename(f))
    return found


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "models")
    models = spark.createDataFrame(MODELS, buckets.MODELS)
    buckets.write(models, path, "model_id")
    return path, models


def test_only_the_folders_of_named_keys_change(spark, stored):
    path, models = stored
    assert rows_of(buckets.read(spark, path, buckets.MODELS)) == rows_of(models)
    changes = spark.createDataFrame([("m3", "1", "new"), ("m3", "1", "newer"), ("m4", "9", "none"), ("unknown", "1", "x")], "model_id string, version string, new_name string")
    before, named = files(path), {f"bucket={r[0]}" for r in changes.select(buckets.bucket("model_id")).collect()}
    assert buckets.update_models(spark, path, changes) == len(named)
    after = files(path)
    assert {k for k in after if after[k] != before.get(k)} == named
    assert rows_of(buckets.read(spark, path, buckets.MODELS)) == rows_of(registry.update(models, changes))
    assert buckets.update_models(spark, path, changes) == len(named)  # a second run gives the same
    assert rows_of(buckets.read(spark, path, buckets.MODELS)) == rows_of(registry.update(models, changes))


def test_a_folder_that_loses_its_last_row(spark, stored):
    path, models = stored
    full = models.withColumn("b", buckets.bucket("model_id"))
    least = full.groupBy("b").count().orderBy("count", "b").first().b
    ids = full.where(F.col("b") == least).select("model_id")
    assert buckets.delete_models(spark, path, ids) == 1
    assert rows_of(buckets.read(spark, path, buckets.MODELS)) == rows_of(registry.delete(models, ids))
    assert rows_of(buckets.of_key(spark, path, buckets.MODELS, "model_id", "m7")) == rows_of(registry.delete(models, ids).where("model_id = 'm7'"))
    none = files(path)
    assert buckets.delete_models(spark, path, ids.limit(0)) == 0 and files(path) == none


def test_one_key_reads_one_folder(spark, stored):
    path, models = stored
    found = buckets.of_key(spark, path, buckets.MODELS, "model_id", "m7")
    assert len(found.inputFiles()) >= 1 and rows_of(found) == rows_of(models.where("model_id = 'm7'"))
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().toString()


def test_a_run_that_fails_between_is_finished(spark, stored, monkeypatch):
    path, models = stored
    ids = spark.createDataFrame([("m1",), ("m2",), ("m50",)], "model_id string")
    whole = registry.delete(models, ids)

    def stop(*_):
        for r in ids.select(buckets.bucket("model_id").alias("b")).limit(1).collect():
            shutil.rmtree(f"{path}/bucket={r.b}")  # as a commit that was cut off leaves it
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "_redo", stop)
        with pytest.raises(RuntimeError):
            buckets.delete_models(spark, path, ids)
    assert buckets.recover(spark, path, buckets.MODELS) == 1
    assert rows_of(buckets.read(spark, path, buckets.MODELS)) == rows_of(whole)
    # what was not written down whole is forgotten
    spark.createDataFrame([("m9", "x", "1", 0, True, 0)], f"{buckets.MODELS}, kept boolean, bucket int").write.parquet(f"{path}-changes/run=1")
    assert buckets.recover(spark, path, buckets.MODELS) == 1
    assert buckets.delete_models(spark, path, spark.createDataFrame([("m9",)], "model_id string")) == 1
    assert rows_of(buckets.read(spark, path, buckets.MODELS)) == rows_of(whole.where("model_id is null or model_id <> 'm9'"))


def test_anchors_are_confirmed_where_they_lie(spark, tmp_path):
    path = str(tmp_path / "anchors")
    rows = spark.createDataFrame([(f"r{i}", i, f"0x{i}", None, 1, i, "pending" if i % 2 else "confirmed") for i in range(80)], ANCHORS)
    buckets.write(rows, path, "tx_hash")
    receipts = spark.createDataFrame([("0x5", 50), ("0x6", 60), ("0x7", None), ("0x500", 1)], "tx_hash string, block_number long")
    before = files(path)
    assert buckets.confirm_anchors(spark, path, receipts) == 3
    assert sum(before.get(k) != v for k, v in files(path).items()) == 3
    assert rows_of(buckets.read(spark, path, ANCHORS)) == rows_of(anchors.confirm(rows, receipts))
