"""Payloads as variants: stored with fields of their own, filtered by nested fields, listed by path."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallychain.session import shared_path
from tallychain.sources import variants

TEXTS = [
    '{"params":{"x":1,"y":{"z":"a"}},"tags":[1,"b",{"c":null}]}', '{"params":{"x":2}}', '{"params":{"x":"3"}}', '{"a.b":1,"":{"é":[]}}', "[[1],[2,[3]]]", "7", "{}", "{", None, '{"a":1,"a":2}',
]


@pytest.fixture
def payloads(spark):
    return variants.with_payload(spark.createDataFrame(list(enumerate(TEXTS)), "n long, data string"))


def test_every_path(spark, payloads):
    found = {(r.path, r.kind): r["values"] for r in variants.paths(payloads).collect()}
    assert found == {
        ("$.params", "OBJECT"): 3, ("$.params.x", "BIGINT"): 2, ("$.params.x", "STRING"): 1, ("$.params.y", "OBJECT"): 1, ("$.params.y.z", "STRING"): 1, ("$.tags", "ARRAY"): 1, ("$.tags[]", "BIGINT"): 1,
        ("$.tags[]", "STRING"): 1, ("$.tags[]", "OBJECT"): 1, ("$.tags[].c", "VOID"): 1, ('$["a.b"]', "BIGINT"): 1, ('$[""]', "OBJECT"): 1, ('$[""]["é"]', "ARRAY"): 1, ("$[]", "ARRAY"): 2, ("$[][]", "BIGINT"): 2, ("$[][]", "ARRAY"): 1,
        ("$[][][]", "BIGINT"): 1,
    }
    assert variants.paths(payloads.limit(0)).count() == 0


def test_shredded_files_and_reads_of_single_fields(spark, payloads):
    before = {k: spark.conf.get(k, None) for k in variants.SHREDDING}
    try:
        for k, v in variants.SHREDDING.items():
            spark.conf.set(k, v)
        path = shared_path(spark, "variants")
        variants.write(payloads.drop("data"), path)
        own = variants.read(spark, path, "n long, payload variant")
        asked = own.where(variants.field("$.params.x", "long") >= 2).select("n", variants.field("$.params.x").alias("x"))
        assert sorted(asked.collect()) == [(1, "2"), (2, "3")]
        scan = next(x for x in asked._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
        assert "payload:variant" not in scan.split("ReadSchema")[1] and "payload:struct" in scan.split("ReadSchema")[1]
        files = glob.glob(path.removeprefix("file://") + "/*.parquet")
        assert any("typed_value" in str(pq.ParquetFile(f).schema) for f in files)
        assert [r[0] for r in own.orderBy("n").select(F.to_json("payload")).collect()] == TEXTS[:3] + ['{"":{"é":[]},"a.b":1}', "[[1],[2,[3]]]", "7", "{}", None, None, None]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
