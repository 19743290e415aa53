"""The ledger's tables, derived from the test tables, and readers and writers of their own formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallychain.functions.text import iso
from tallychain.operators.chain import fold, genesis
from tallychain.operators.numbering import numbered
from tallychain.session import shared_path

#: The derived ledger's first timestamp, how far its anchors lie apart, and which of them have a wrong root (one in so many).
GENESIS_TS, ANCHOR_STEP, WRONG_ROOT = 1700000000, 50, 20

BLOCK_COLUMNS = "block_index long, ts long, data string, previous_hash string, hash string, type string, model_id string, version string, inference_id string, input_hash string, output_hash string, params string, metadata string, index_range long"
MODEL_REQUEST = "modelId string, modelName string, version string, modelPath string, params string, metrics map<string, double>, metadata string, mlflow struct<modelHash: string, gitCommit: string>"
INFERENCE_REQUEST = "modelId string, inferenceId string, inputHash string, outputHash string, params string, metadata string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(name: str, value) -> list:
    return [F.lit(f'"{name}":"'), value, F.lit('"')]


def _json(**fields) -> F.Column:
    parts = [F.lit("{")]
    for n, (k, v) in enumerate(sorted(fields.items())):
        parts += ([F.lit(",")] if n else []) + _quoted(k, v)
    return F.concat(*parts, F.lit("}"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event, in order: (block_index from 1, ts, type, model_id, version, inference_id, input_hash, output_hash, data)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    e = numbered(e, "event_id", "block_index", 1)
    signup = F.col("event_type") == "signup"
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    e = e.withColumns({
        "type": F.when(signup, "model_registration").otherwise("inference"),
        "model_id": F.concat(F.lit("m-"), F.col("user_id").cast("string")),
        "version": F.when(signup, F.concat(F.lit("1.0."), nth.cast("string"))),
        "inference_id": F.when(~signup, F.concat(F.lit("inf-"), F.col("event_id").cast("string"))),
        "input_hash": F.when(~signup, F.sha2("props", 256)),
        "output_hash": F.when(~signup, F.sha2(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")), 256)),
    })
    model_hash = F.sha2(F.concat("model_id", F.lit("|"), "version"), 256)
    registration = _json(modelHash=model_hash, modelId=F.col("model_id"), modelName=F.concat(F.lit("model-"), F.col("user_id").cast("string")), type=F.col("type"), version=F.col("version"))
    inference = _json(executedAt=iso(F.col("ts")), inferenceId=F.col("inference_id"), inputHash=F.col("input_hash"), modelId=F.col("model_id"), outputHash=F.col("output_hash"), type=F.col("type"))
    return e.withColumn("data", F.when(signup, registration).otherwise(inference)).drop("event_id", "user_id", "event_type", "props")


def promoted(blocks: DataFrame) -> DataFrame:
    """blocks with the payload's fields as columns, so that filters on them reach the Parquet scan once written."""
    fields = "type string, modelId string, version string, inferenceId string, inputHash string, outputHash string, params string, metadata string"
    d = blocks.withColumn("d", F.from_json("data", fields))
    return d.select("block_index", "ts", "data", "previous_hash", "hash", "d.type", F.col("d.modelId").alias("model_id"), "d.version", F.col("d.inferenceId").alias("inference_id"), F.col("d.inputHash").alias("input_hash"), F.col("d.outputHash").alias("output_hash"), "d.params", "d.metadata")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived chain: block_index, ts, data, previous_hash, hash."""
    rows = genesis(spark, GENESIS_TS).unionByName(requests(spark, sf_dir).select("block_index", "ts", "data"))
    return fold(rows)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived chain, folded once, written to the shared folder and read from there, with its payload's fields as columns."""
    return write_chain(ledger(spark, sf_dir))


def tampered(blocks: DataFrame) -> DataFrame:
    """blocks with a space after every 97th payload and 'x' for every 101st previous hash, the first block aside."""
    later = F.col("block_index") > 0
    return blocks.withColumns({
        "data": F.when(later & (F.col("block_index") % 97 == 0), F.concat("data", F.lit(" "))).otherwise(F.col("data")),
        "previous_hash": F.when(later & (F.col("block_index") % 101 == 0), "x").otherwise(F.col("previous_hash")),
    })


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registration as a registry row: (model_id, name, version, created_at in seconds)."""
    r = requests(spark, sf_dir).where("type = 'model_registration'")
    return r.select("model_id", F.concat(F.lit("model-"), F.substring("model_id", 3, 20)).alias("name"), "version", F.col("ts").alias("created_at"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchor every ANCHOR_STEP blocks: (merkle_root, last_block_index, tx_hash, block_number, chain_id, anchored_at, status)."""
    r = requests(spark, sf_dir).where(F.col("block_index") % ANCHOR_STEP == 0)
    n = F.col("block_index")
    root, tx = (F.sha2(F.concat(F.lit(p), n.cast("string")), 256) for p in ("root:", "tx:"))
    status = F.when((n / ANCHOR_STEP) % 3 == 0, "pending").otherwise("confirmed")
    return r.select(root.alias("merkle_root"), n.alias("last_block_index"), F.concat(F.lit("0x"), tx).alias("tx_hash"), F.when(status == "confirmed", n * 10).alias("block_number"), F.lit(11155111).cast("long").alias("chain_id"), F.col("ts").alias("anchored_at"), status.alias("status"))


def rooted_anchors(spark: SparkSession, sf_dir: str, roots: DataFrame) -> DataFrame:
    """anchors with the true roots of their prefixes, from roots(length, root); every WRONG_ROOT-th anchor keeps its made-up root."""
    a, n = anchors(spark, sf_dir), F.col("last_block_index")
    true = roots.select((F.col("length") - 1).alias("last_block_index"), F.col("root").alias("__root"))
    return a.join(true, "last_block_index").withColumn("merkle_root", F.when((n / ANCHOR_STEP) % WRONG_ROOT == 0, F.col("merkle_root")).otherwise(F.col("__root"))).select(*a.columns)


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx_hash, block_number) of two in three anchors; some of these have no block yet."""
    a = anchors(spark, sf_dir).withColumn("n", (F.col("last_block_index") / ANCHOR_STEP).cast("long"))
    return a.where("n % 5 <> 0").select("tx_hash", F.when(F.col("n") % 7 != 0, F.col("last_block_index") * 10).alias("block_number"))


def anchor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract event per customer; every 50th cannot be decoded and has nulls only."""
    c = table(spark, sf_dir, "customer").withColumn("ok", F.col("c_custkey") % 50 != 0)
    row = {
        "technical_address": F.concat(F.lit("0x"), F.substring(F.sha2(F.concat(F.lit("org"), (F.col("c_custkey") % 25).cast("string")), 256), 1, 40)),
        "merkle_root": F.sha2(F.concat(F.lit("root:"), F.col("c_custkey").cast("string")), 256),
        "organization_id": F.concat(F.lit("org-"), (F.col("c_custkey") % 40).cast("string")),
        "organization_name": F.col("c_name"),
        "domain": F.lower("c_mktsegment"),
        "ts": F.lit(GENESIS_TS) + F.col("c_custkey"),
    }
    return c.select(F.col("c_custkey").cast("long").alias("event_no"), *[F.when(F.col("ok"), v).alias(k) for k, v in row.items()])


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as agents' actions: (event_id, agent_id, action_type, model_id, input, output, ts, cost). Some lack a model or lie far ahead."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n,
        F.concat(F.lit("agent-"), (F.col("user_id") % 30).cast("string")).alias("agent_id"),
        F.col("event_type").alias("action_type"),
        F.when(n % 211 != 0, F.concat(F.lit("m-"), (F.col("user_id") + F.when(n % 97 == 0, 1000000).otherwise(0)).cast("string"))).alias("model_id"),
        F.col("props").alias("input"),
        F.concat("event_type", F.lit(":"), (n % 3).cast("string")).alias("output"),
        (F.unix_timestamp(F.col("ts").cast("timestamp")) + F.when(n % 303 == 0, 10**9).otherwise(0)).alias("ts"),
        F.col("value").alias("cost"),
    )


def read_requests(spark: SparkSession, path: str, kind: str = "inference") -> DataFrame:
    """JSON requests of one kind, a line each; free-form parts stay JSON text."""
    return spark.read.schema(INFERENCE_REQUEST if kind == "inference" else MODEL_REQUEST).json(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, model_hash) of every file below path, hashed where it is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("model_hash"))


def generated_events(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n synthetic agent events: kinds in turn, everything else from a hash of the row's number."""
    h = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(1 << 30))
    kind = F.element_at(F.array(*map(F.lit, ("model_version", "model_inference", "agent_action"))), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(n).select(
        "id", kind.alias("type"),
        F.concat(F.lit("model-"), (h("model") % 10).cast("string")).alias("model_id"),
        F.when(F.col("id") % 3 == 2, F.concat(F.lit("agent-"), (h("agent") % 5).cast("string"))).alias("agent_id"),
        F.when(F.col("id") % 3 == 1, (5 + h("latency") % 496).cast("int")).alias("latency_ms"),
        F.when(F.col("id") % 3 == 2, F.round(h("cost") / 1e6, 2)).alias("cost"),
    )


def write_chain(folded: DataFrame, per_file: int = 1 << 18) -> DataFrame:
    """Write a chain as it comes out of the fold, in order of its index, and read it back: files and row groups hold ranges of the index, so that
    filters on block_index, and by their statistics and a bloom filter on hash, leave out most of them."""
    spark = folded.sparkSession
    path = shared_path(spark, "ledger")
    rows = promoted(folded)
    rows.write.option("maxRecordsPerFile", per_file).option("parquet.bloom.filter.enabled#hash", "true").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Indices of one folder of stored blocks.
PER_RANGE = 1 << 20


def write_blocks(blocks: DataFrame, path: str, mode: str = "append", per_range: int | None = None) -> None:
    """Append blocks as Parquet, with the payload's fields beside it: a folder for each range of the index, sorted in it, so that an index reads one
    folder and few of its row groups."""
    rows = promoted(blocks).withColumn("index_range", F.floor(F.col("block_index") / (per_range or PER_RANGE)).cast("long"))
    rows.repartitionByRange("block_index").sortWithinPartitions("block_index").write.mode(mode).option("parquet.bloom.filter.enabled#hash", "true").partitionBy("index_range").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks that write_blocks wrote, with index_range."""
    return spark.read.schema(BLOCK_COLUMNS).parquet(path)
