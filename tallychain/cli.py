"""Command line over stored tables: python -m tallychain.cli COMMAND --blocks PATH …; prints JSON lines."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.operators import chain, lookups, writes
from tallychain.session import session, staged
from tallychain.sources import tables


def register(spark: SparkSession, a: argparse.Namespace) -> int:
    """Append the requests of a JSON lines file to the stored chain and registry, and print what became of each; 1 if any was refused."""
    kind = a.command.removeprefix("register-")
    r = tables.read_requests(spark, a.requests, kind)
    type_ = "model_registration" if kind == "model" else "inference"
    payload = F.to_json(F.struct("*", F.lit(type_).alias("type")))
    r = staged(r.withColumns({"ord": F.monotonically_increasing_id(), "ts": F.lit(a.ts).cast("long"), "payload": payload}), "requests")
    blocks, models = stored(spark, a.blocks, chain.BLOCKS), stored(spark, a.models, "model_id string, name string, version string, created_at long")
    own = [F.col("modelId").alias("model_id"), "ord", "ts", "payload"]
    if kind == "model":
        made = writes.register_models(blocks, models, r.select(*own, F.col("modelName").alias("name"), "version"), a.ts)
    else:
        made = writes.log_inferences(blocks, models, r.select(*own, F.col("inferenceId").alias("inference_id")), a.ts)
    told = staged(made.acks, "acks")
    made.blocks.write.mode("append").parquet(a.blocks)
    if made.models is not None:
        staged(made.models, "models").write.mode("append").parquet(a.models)
    for (line,) in told.orderBy("ord").select(F.to_json(F.struct("*"))).toLocalIterator():
        print(line)
    return 0 if told.where("not success").isEmpty() else 1


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, read once before it is written to; empty if it is not there yet."""
    try:
        return staged(spark.read.schema(schema).parquet(path), "before")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallychain")
    p.add_argument("command", choices=["verify", "height", "list", "get-by-index", "get-by-hash", "models-count", "models-list", "models-get", "anchors-list", "register-model", "register-inference"])
    for name in ("--blocks", "--models", "--anchors", "--hash", "--model-id", "--requests"):
        p.add_argument(name)
    p.add_argument("--index", type=int)
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--skip", type=int, default=0)
    p.add_argument("--mode", choices=["writer", "reader", "recleaned"], default="reader")
    p.add_argument("--ts", type=int, default=int(time.time()))
    a = p.parse_args(args)
    spark = session()
    if a.command.startswith("register-"):
        if not (a.blocks and a.models and a.requests):
            p.error("blocks, models and requests are needed")
        return register(spark, a)
    source = a.models if a.command.startswith("models") else a.anchors if a.command.startswith("anchors") else a.blocks
    if not source:
        p.error("the command's table is missing")
    rows = spark.read.parquet(source)
    needed = {"models-get": a.model_id, "get-by-hash": a.hash, "get-by-index": a.index}
    if needed.get(a.command, 0) is None:
        p.error("what to get is missing")
    out = {
        "verify": lambda: chain.verify(rows, a.mode),
        "height": lambda: rows.selectExpr("count(*) - 1 as height"),
        "list": lambda: lookups.page(rows, ["block_index"], a.limit, a.skip),
        "get-by-index": lambda: lookups.by_index(rows, a.index),
        "get-by-hash": lambda: lookups.by_hash(rows, a.hash),
        "models-count": lambda: rows.selectExpr("count(*) as count"),
        "models-list": lambda: lookups.page(rows, ["model_id", "version"], a.limit, a.skip),
        "models-get": lambda: lookups.model_by_id(rows, a.model_id),
        "anchors-list": lambda: lookups.page(rows, ["last_block_index"], a.limit, a.skip),
    }[a.command]()
    n = 0
    for n, (line,) in enumerate(out.select(F.to_json(F.struct("*"))).toLocalIterator(), 1):
        print(line)
    if not n and a.command.split("-")[0] == "get" or a.command == "models-get" and not n:
        print("not found", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
