"""Writes composed of guard, payload, block and registry row, with what is told of each; nothing is stored here."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallychain.functions.canonical import with_text
from tallychain.operators import chain, registry
from tallychain.operators.numbering import numbered
from tallychain.session import staged


class Written(NamedTuple):
    """The blocks and registry rows to append, and one acknowledgement for each request."""

    blocks: DataFrame
    models: DataFrame | None
    acks: DataFrame


def prepared(requests: DataFrame, payload: Column, keep: bool = False) -> DataFrame:
    """requests with data: the payload, a JSON text, cleaned and canonical. What is no JSON has null data. Keys that hashes leave out are not stored;
    with keep they are, and `covered` is the text that the hash covers (such chains are verified in mode `excluding`)."""
    if keep:
        return with_text(with_text(requests, "data", payload, "clean"), "covered", F.col("data"), "jcs")
    return with_text(requests, "data", payload, "payload")


def _part(*paths: str) -> Column:
    """The first of these parts that a payload has: a text as it is, an object or array as JSON text; null where it has none."""
    return F.coalesce(*[F.get_json_object("payload", p) for p in paths])


def _told(accepted: DataFrame, blocks: DataFrame, refused: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each request: its own columns, success, reason, and the block as a struct, which is null for a refused one."""
    place = blocks.select("block_index", F.struct(F.col("block_index").alias("index"), "hash", F.col("ts").alias("timestamp")).alias("block"))
    good = accepted.join(place, "block_index").select(*columns, F.lit(True).alias("success"), F.lit(None).cast("string").alias("reason"), "block")
    bad = refused.select(*columns, F.lit(False).alias("success"), "reason", F.lit(None).cast(good.schema["block"].dataType).alias("block"))
    return good.unionByName(bad)


def _appended(blocks: DataFrame, judged: DataFrame, genesis_ts: int | None) -> tuple[DataFrame, DataFrame]:
    """The new blocks, and the accepted ones of judged with the index of each row's block. Rows are numbered once, so that those of one ord, or of none,
    which come last, have the blocks that they are told of; they are put in order of their payload."""
    accepted = staged(numbered(judged.where("reason is null"), "ord", "place", 0, "data"), "accepted")
    new = staged(chain.append(blocks, accepted.select(F.col("place").alias("ord"), "ts", "data", *[c for c in accepted.columns if c == "covered"]), genesis_ts), "appended")
    last = new.agg(F.max("block_index")).first()[0]
    start = 0 if last is None else last + 1 - accepted.count()
    return new, accepted.withColumn("block_index", F.col("place") + start).drop("place")


def register_models(blocks: DataFrame, models: DataFrame, requests: DataFrame, genesis_ts: int | None = None, keep: bool = False) -> Written:
    """requests(ord, ts, model_id, name, version, payload: JSON text) in order of ord: those that registry.registrations accepts get a block and a
    row of the registry, with the payload's params, metrics and metadata as JSON texts. A payload that is no JSON is refused. Acknowledgements have mlflow: the
    hash and the commit that the payload names."""
    named = F.struct(_part("$.mlflow.modelHash", "$.modelHash").alias("model_hash"), _part("$.mlflow.gitCommit", "$.gitCommit").alias("git_commit"))
    asked = staged(prepared(requests, F.col("payload"), keep).withColumn("mlflow", named), "asked")
    judged = registry.registrations(asked.where("data is not null"), models, "ord")
    judged = staged(judged.unionByName(asked.where("data is null").withColumn("reason", F.lit("no payload"))), "judged")
    new, accepted = _appended(blocks, judged, genesis_ts)
    rows = accepted.select("model_id", "name", "version", F.col("ts").alias("created_at"), _part("$.params").alias("parameters"), _part("$.metrics").alias("metrics"), _part("$.metadata").alias("metadata"))
    return Written(new, rows, _told(accepted, new, judged.where("reason is not null"), ["ord", "model_id", "name", "version", "mlflow"]))


def log_inferences(blocks: DataFrame, models: DataFrame, requests: DataFrame, genesis_ts: int | None = None, keep: bool = False) -> Written:
    """requests(ord, ts, model_id, inference_id, payload: JSON text) in order of ord: those whose model is registered get a block. Acknowledgements have
    hashes: of the input and the output, as the payload names them."""
    known = models.select("model_id", F.lit(True).alias("known")).distinct()
    missing = F.concat(F.lit("Model ID "), F.coalesce("model_id", F.lit("null")), F.lit(" does not exist"))
    hashes = F.struct(_part("$.inputHash").alias("input"), _part("$.outputHash").alias("output"))
    judged = prepared(requests, F.col("payload"), keep).withColumn("hashes", hashes).join(known, "model_id", "left")
    judged = staged(judged.withColumn("reason", F.when(F.col("known").isNull(), missing).when(F.col("data").isNull(), "no payload")).drop("known"), "judged")
    new, accepted = _appended(blocks, judged, genesis_ts)
    return Written(new, None, _told(accepted, new, judged.where("reason is not null"), ["ord", "model_id", "inference_id", "hashes"]))
