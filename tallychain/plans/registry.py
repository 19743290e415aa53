"""Named queries over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.functions.canonical import native, with_text
from tallychain.functions.hashing import keccak256, unhex_strict
from tallychain.functions.text import per, type_label
from tallychain.operators import anchors, audit, chain, frontier, hash_index, lookups, maintained, merkle, registry, verification, writes
from tallychain.operators.numbering import numbered
from tallychain.plans.sql import ORACLE
from tallychain.session import shared_path, staged
from tallychain.sources import buckets, logs, variants
from tallychain.sources import tables as t
from tallychain.streaming import event_time, keyed
from tallychain.streaming.append import ANCHORS

MODEL = "m-8"


def _own(blocks: DataFrame) -> DataFrame:
    return blocks.select("block_index", "ts", "data", "previous_hash", "hash")


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    return leaves_of(t.stored(spark, d))


def leaves_of(blocks: DataFrame) -> DataFrame:
    """(pos, leaf) of a chain's blocks, in order."""
    return numbered(blocks.select("block_index", "hash"), "block_index", "pos", 0, "hash").select("pos", unhex_strict(F.col("hash")).alias("leaf"))


def _inferences(spark: SparkSession, d: str) -> DataFrame:
    return t.requests(spark, d).where("type = 'inference'")


def ledger_build(s, d):
    return t.ledger(s, d)


def ledger_head(s, d):
    return t.ledger(s, d).agg(F.max(F.struct("block_index", "hash")).alias("t")).select("t.block_index", "t.hash")


def verify_chain(s, d):
    return chain.verify(t.stored(s, d))


def verify_tampered(s, d):
    return chain.verify(t.tampered(t.stored(s, d)))


def verify_tampered_reader(s, d):
    return chain.verify(t.tampered(t.stored(s, d)), "reader")


def verify_errors(s, d):
    return chain.errors(t.tampered(t.stored(s, d)))


def chain_gaps(s, d):
    return chain.gaps(t.requests(s, d).where("block_index % 10 <> 3").withColumn("hash", F.lit("")))


def block_by_index(s, d):
    return _own(lookups.by_index(t.stored(s, d), 42))


def block_by_hash(s, d):
    blocks = t.stored(s, d)
    wanted = lookups.by_index(blocks, 42).select("hash").first()
    return _own(lookups.by_hash(blocks, wanted.hash if wanted else ""))


def blocks_page(s, d):
    return lookups.page(t.ledger(s, d).select("block_index", "hash"), ["block_index"], 10, 20)


def blocks_page_unlimited(s, d):
    return lookups.page(t.ledger(s, d).select("block_index", "hash"), ["block_index"], 0, 20)


def provenance_history(s, d):
    return lookups.history(t.stored(s, d), MODEL)


def provenance_summary(s, d):
    return lookups.summary(t.stored(s, d), MODEL)


def chain_stats(s, d):
    return lookups.stats(t.stored(s, d), t.anchors(s, d))


def chain_height(s, d):
    return t.ledger(s, d).agg((F.count("*") - 1).alias("height"))


def model_count(s, d):
    return t.models(s, d).agg(F.count("*").alias("models"))


def models_recent(s, d):
    return lookups.recent_models(t.models(s, d)).limit(10)


def models_recent_all(s, d):
    """Every model, newest first."""
    return lookups.recent_models(t.models(s, d))


def models_page(s, d):
    return lookups.page(t.models(s, d), ["model_id", "version"], 10, 5)


def model_by_id(s, d):
    return lookups.model_by_id(t.models(s, d), MODEL)


def model_by_name(s, d):
    return lookups.model_by_name(t.models(s, d), "model-8", "1.0.2")


def model_ids(s, d):
    return t.models(s, d).select("model_id")


def events_per_model(s, d):
    r = t.requests(s, d).agg(F.count("*").alias("n"), F.countDistinct("model_id").alias("m"))
    return r.select(per(F.col("n").cast("double"), F.col("m")).alias("events_per_model"), F.when(F.col("n") > 0, "Active").otherwise("Starting").alias("state"))


def blocks_per_model(s, d):
    return lookups.per_model(t.stored(s, d))


def latest_block(s, d):
    return t.ledger(s, d).orderBy(F.desc("block_index")).limit(1).select("block_index", "ts", "hash")


def type_labels(s, d):
    return t.requests(s, d).groupBy(type_label(F.col("type")).alias("label")).agg(F.count("*").alias("blocks"))


def merkle_root_sha256(s, d):
    return merkle.root(_leaves(s, d), merkle.POSITIONAL)


def merkle_root_sorted_pairs(s, d):
    return merkle.root(_leaves(s, d), merkle.Tree("sha256", True, False))


def merkle_root_keccak(s, d):
    return merkle.root(_leaves(s, d), merkle.SORTED).select("n_leaves", F.concat(F.lit("0x"), "root").alias("root"))


def prefix_roots(s, d):
    lengths = s.createDataFrame([(1,), (51,), (500,)], "length long")
    return merkle.prefix_roots(_leaves(s, d), lengths)


def anchor_prefix_roots(s, d):
    """The root of every anchor's prefix. No SQL: it would build one tree for each anchor."""
    return merkle.prefix_roots(_leaves(s, d), t.anchors(s, d).select((F.col("last_block_index") + 1).alias("length")))


def anchor_proofs(s, d):
    """Every anchor, with its prefix's true root except for one in t.WRONG_ROOT, against the roots of the leaves."""
    leaves = _leaves(s, d)
    true = merkle.prefix_roots(leaves, t.anchors(s, d).select((F.col("last_block_index") + 1).alias("length")))
    return anchors.check_roots(leaves, t.rooted_anchors(s, d, true).select("last_block_index", "merkle_root"))


#: The tree of published anchors with a hash that SQL has too.
SORTED_SHA256 = merkle.Tree("sha256", True, False)


def anchors_checked(s, d):
    """Every anchor as it is published, with the root of its prefix after 0x except for one in t.WRONG_ROOT, against the roots of the leaves."""
    leaves = _leaves(s, d)
    true = merkle.prefix_roots(leaves, t.anchors(s, d).select((F.col("last_block_index") + 1).alias("length")), SORTED_SHA256)
    published = t.rooted_anchors(s, d, true).select("last_block_index", F.upper("merkle_root").alias("merkle_root"))
    return anchors.check_roots(leaves, published.withColumn("merkle_root", F.concat(F.lit("0x"), "merkle_root")), SORTED_SHA256)


def frontier_root(s, d):
    """The root after five batches of blocks, each of which extends the frontier of those before it."""
    leaves = staged(_leaves(s, d), "leaves")
    n, peaks = leaves.count(), {}
    for lo, hi in zip(range(5), range(1, 6)):
        peaks = frontier.extended(peaks, leaves.where((F.col("pos") >= n * lo // 5) & (F.col("pos") < n * hi // 5)), SORTED_SHA256)
    rows = [(frontier.length(peaks), frontier.root(peaks, SORTED_SHA256).hex())] if peaks else []
    return s.createDataFrame(rows, "n_leaves long, root string")


def anchor_due(s, d):
    """The anchor to append after the last block where the last three anchors are not yet made."""
    blocks = t.stored(s, d)
    made = t.anchors(s, d).where(F.col("last_block_index") <= blocks.agg(F.max("block_index")).first()[0] - 3 * t.ANCHOR_STEP)
    new = anchors.new_anchor(blocks, made, leaves_of(blocks), "0xnew", t.GENESIS_TS, t.ANCHOR_STEP, tree=SORTED_SHA256)
    return new.select("merkle_root", "last_block_index", "tx_hash", "chain_id", "anchored_at", "status")


def inclusion_proofs(s, d):
    """For every block, how long its proof in the whole ledger's tree is and whether it leads to the root."""
    leaves = _leaves(s, d)
    length = leaves.agg(F.count("*").alias("length"))
    made = merkle.inclusion_proofs(leaves, leaves.select("pos").join(F.broadcast(length)))  # one row
    return made.select("pos", F.size("siblings").alias("steps"), merkle.proven(F.col("leaf"), F.col("siblings"), F.col("root")).alias("proven"))


def anchor_decision(s, d):
    return anchors.decide(t.stored(s, d), t.anchors(s, d), 20)


def _text(rows: DataFrame, column: str) -> DataFrame:
    """rows with a nullable number as text, the same in every tool that compares results."""
    return rows.withColumn(column, F.col(column).cast("string"))


def anchors_page(s, d):
    return _text(lookups.page(t.anchors(s, d), ["last_block_index"], 10, 10), "block_number")


def anchors_pending(s, d):
    return _text(anchors.pending(t.anchors(s, d)), "block_number")


def anchors_confirm(s, d):
    return _text(anchors.confirm(t.anchors(s, d), t.receipts(s, d)), "block_number")


def contract_events(s, d):
    return _text(t.anchor_events(s, d), "ts")


def events_by_address(s, d):
    e = t.anchor_events(s, d)
    asked = e.where("event_no = 7").select("technical_address").first()
    return anchors.by_address(e, (asked.technical_address if asked else "").upper())


def events_by_org(s, d):
    return anchors.by_organization(t.anchor_events(s, d), "org-7")


def inference_accept(s, d):
    return registry.accept_inferences(_inferences(s, d).select("inference_id", "model_id"), t.models(s, d).where("version = '1.0.14'")).select("inference_id", "model_id")


def inference_reject(s, d):
    return registry.reject_inferences(_inferences(s, d).select("inference_id", "model_id"), t.models(s, d).where("version = '1.0.14'")).select("inference_id", "model_id")


def registration_unique(s, d):
    r = t.requests(s, d).where("type = 'model_registration'")
    asked = r.select("block_index", "model_id", F.concat(F.lit("model-"), F.substring("model_id", 3, 20)).alias("name"), F.concat(F.lit("1."), (F.col("block_index") % 4).cast("string")).alias("version"))
    return registry.registrations(asked, t.models(s, d), "block_index").select("block_index", "model_id", "name", "version", "reason")


def models_update(s, d):
    m = t.models(s, d)
    return registry.update(m, m.where("version = '1.0.1'").select("model_id", "version", F.concat("name", F.lit("-first")).alias("new_name")))


def models_delete(s, d):
    m = t.models(s, d)
    return registry.delete(m, m.where("version = '1.0.9'"))


def model_provenance_join(s, d):
    b = t.stored(s, d).select("model_id", "block_index")
    return t.models(s, d).join(b, "model_id", "left").groupBy("model_id", "version").agg(F.count("block_index").alias("blocks"))


def drift_detect(s, d):
    return audit.drift(_inferences(s, d))


def suspicious_agents(s, d):
    return audit.suspicious_agents(t.agent_events(s, d), 3, 100.0)


def weird_cases(s, d):
    return audit.weird(t.agent_events(s, d), t.models(s, d), 2_000_000_000)


def unknown_models(s, d):
    return audit.unknown_models(t.agent_events(s, d), t.models(s, d))


def action_links(s, d):
    n = F.col("block_index")
    names = F.array(F.concat(F.lit("inf-"), n.cast("string")), F.concat(F.lit("inf-"), (n + 1).cast("string")), F.lit("inf-x"))
    return audit.linked(t.requests(s, d).where("block_index % 100 = 0").select(n.alias("action_id"), names.alias("inference_ids")), _inferences(s, d))


def action_links_all(s, d):
    """action_links with every request as an action."""
    n = F.col("block_index")
    names = F.array(F.concat(F.lit("inf-"), n.cast("string")), F.concat(F.lit("inf-"), (n + 1).cast("string")), F.lit("inf-x"))
    return audit.linked(t.requests(s, d).select(n.alias("action_id"), names.alias("inference_ids")), _inferences(s, d))


def data_structure_keys(s, d):
    return lookups.structure(t.ledger(s, d))


def conversation_hashes(s, d):
    return t.table(s, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("text_hash"))


def per_model_heads(s, d):
    made = chain.fold(t.requests(s, d).select("model_id", "block_index", "ts", "data"), keys=("model_id",))
    return made.groupBy("model_id").agg(F.count("*").alias("blocks"), F.max_by("hash", "block_index").alias("head"))


def canonical_events(s, d):
    e = t.table(s, d, "events")
    e = with_text(e, "canonical", F.col("props"), "jcs")
    e = with_text(e, "cleaned", F.concat(F.lit('{"b":'), "props", F.lit(',"a":null,"c":[null,""]}')), "clean")
    return e.select("event_id", "canonical", "cleaned")


def canonical_paths(s, d):
    """Cleaned texts, and which of them Spark's variant makes without Python: those that only need their keys put in order."""
    more = F.when(F.col("event_id") % 4 == 0, ',"a":""').when(F.col("event_id") % 4 == 1, ',"A":[true, {"c":"é"}]').otherwise("")
    e = t.table(s, d, "events").select("event_id", F.concat(F.lit('{"v":'), F.col("event_id").cast("string"), F.lit(', "props":'), "props", more, F.lit("}")).alias("text"))
    e = with_text(native(e, "by_variant", F.col("text"), "clean"), "canonical", F.col("text"), "clean")
    return e.select("event_id", "canonical", F.col("by_variant").isNotNull().alias("native"))


def keccak_documents(s, d):
    s.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # texts of any length
    return t.table(s, d, "documents").select("doc_id", F.lower(F.hex(keccak256(F.col("text").cast("binary")))).alias("digest"))


NOTE = '"note":"a \\"quoted\\" <word>","x":["",null,1],"params":{"depth":null,"tags":[]}'


def _told(written) -> DataFrame:
    """Acknowledgements with the block's fields beside each other; a nullable index is text."""
    return written.acks.select("*", F.col("block.index").cast("string").alias("block_index"), F.col("block.hash").alias("block_hash")).drop("block", "mlflow", "hashes")


def register_models(s, d):
    """Every registration as a request on an empty chain, whose first versions are registered already; payloads hold quotes and empty parts."""
    r = t.models(s, d).withColumnRenamed("created_at", "ts")
    asked = r.join(t.requests(s, d).where("type = 'model_registration'").select("model_id", "version", F.col("block_index").alias("ord")), ["model_id", "version"])
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    payload = F.concat(F.lit('{"version":'), text("version"), F.lit(',"modelName":'), text("name"), F.lit(',"modelId":'), text("model_id"), F.lit(f',"type":"model_registration",{NOTE}}}'))
    empty = s.createDataFrame([], chain.BLOCKS)
    return _told(writes.register_models(empty, r.where("version = '1.0.1'"), asked.withColumn("payload", payload), t.GENESIS_TS))


def log_inferences(s, d):
    """Every inference as a request on an empty chain; only models with a fourteenth version are registered."""
    r = _inferences(s, d).select(F.col("block_index").alias("ord"), "ts", "model_id", "inference_id", F.col("data").alias("payload"))
    return _told(writes.log_inferences(s.createDataFrame([], chain.BLOCKS), t.models(s, d).where("version = '1.0.14'"), r, t.GENESIS_TS))


def _inferences_written(s: SparkSession, d: str, payload, keep: bool = False):
    r = _inferences(s, d).select(F.col("block_index").alias("ord"), "ts", "model_id", "inference_id", payload.alias("payload"))
    return writes.log_inferences(s.createDataFrame([], chain.BLOCKS), t.models(s, d).where("version = '1.0.14'"), r, t.GENESIS_TS, keep)


def inferences_acknowledged(s, d):
    """log_inferences as a service answers: with the hashes of input and output."""
    told = _inferences_written(s, d, F.col("data")).acks
    return told.select("ord", "inference_id", "success", F.col("hashes.input").alias("input_hash"), F.col("hashes.output").alias("output_hash"), F.col("block.hash").alias("block_hash"))


def verify_excluded(s, d):
    """The chain of log_inferences, of payloads that keep a store's own keys, which the hashes leave out: those keys differ in every block afterwards, and every
    seventh previous hash is wrong."""
    own = lambda time: F.concat(F.lit('{"_id":"x","createdAt":"'), time.cast("string"), F.lit('",'), F.substring("data", 2, 1 << 20))
    blocks = staged(_inferences_written(s, d, own(F.col("ts")), True).blocks, "kept")
    later = F.col("block_index") > 0
    text = F.when(later, F.regexp_replace("data", '"createdAt":"', '"createdAt":"later than ')).otherwise(F.col("data"))
    odd = blocks.withColumns({"data": text, "previous_hash": F.when(later & (F.col("block_index") % 7 == 0), "x").otherwise(F.col("previous_hash"))})
    head = blocks.agg(F.max_by("hash", "block_index").alias("head"), F.count_if(F.col("data").contains('"createdAt"')).alias("kept"))
    return chain.verify(odd, "excluding").join(head)  # one row with one row


def models_registered(s, d):
    """The registry rows that registrations with parameters, metrics and metadata leave, nested parts as JSON texts."""
    r = t.models(s, d).withColumnRenamed("created_at", "ts")
    asked = r.join(t.requests(s, d).where("type = 'model_registration'").select("model_id", "version", F.col("block_index").alias("ord")), ["model_id", "version"])
    n = F.col("ord").cast("string")
    payload = F.concat(F.lit('{"metrics":{"f1":0.5,"n":'), n, F.lit('},"params":{"layers":[1,{"w":'), n, F.lit('}],"note":"a \\"quoted\\" word"},"mlflow":{"modelHash":"h'), n, F.lit('"}}'))
    written = writes.register_models(s.createDataFrame([], chain.BLOCKS), r.where("version = '1.0.1'"), asked.withColumn("payload", payload), t.GENESIS_TS)
    told = written.acks.where("success").select("model_id", "version", F.col("mlflow.model_hash").alias("model_hash"))
    return written.models.join(told, ["model_id", "version"])


def verify_recleaned(s, d):
    return chain.verify(t.tampered(t.stored(s, d)), "recleaned")


def genesis_exists(s, d):
    return chain.has_genesis(t.ledger(s, d))


def anchors_append(s, d):
    """The anchor to append after the last block, where one is due."""
    blocks = t.stored(s, d)
    made = anchors.new_anchor(blocks, t.anchors(s, d), leaves_of(blocks), "0xnew", t.GENESIS_TS, 1)
    return made.select("last_block_index", "tx_hash", "chain_id", "anchored_at", "status", F.length("merkle_root").alias("root_chars"))


def anchored_events(s, d):
    """The contract event of every anchor."""
    return anchors.anchored(t.anchors(s, d), "0xabc", "org-7", "Org", "health")


def provenance_report(s, d):
    """Every model's report over the chain with errors: its history as the hashes of its blocks."""
    blocks = t.tampered(t.stored(s, d))
    r = lookups.report(blocks, blocks.select("model_id"))
    return r.select("model_id", "total_blocks", "chain_valid", F.size("verification_errors").cast("long").alias("errors"), F.element_at("verification_errors", 1).alias("first_error"), F.array_join(F.transform("history", lambda h: h["block_hash"]), ",").alias("hashes"))


def stats_badges(s, d):
    return chain.verify(t.tampered(t.stored(s, d))).select(lookups.badge(F.col("is_valid")).alias("badge"))


def events_from_args(s, d):
    """The contract's events from their positional arguments; those that cannot be decoded have none."""
    e = t.anchor_events(s, d)
    args = F.array("technical_address", "merkle_root", "organization_id", "organization_name", "domain", F.col("ts").cast("string"))
    return _text(anchors.from_args(e.select("event_no", F.when(F.col("technical_address").isNotNull(), args).alias("args"))), "ts")


def requests_ingested(s, d):
    """Inference requests written as JSON lines and read back as a service would get them."""
    path = shared_path(s, "requests")
    fields = {"modelId": "model_id", "inferenceId": "inference_id", "inputHash": "input_hash", "outputHash": "output_hash"}
    _inferences(s, d).select(*[F.col(c).alias(k) for k, c in fields.items()]).write.json(path)
    return t.read_requests(s, path).select(*[F.col(k).alias(c) for k, c in fields.items()])


def generated_events(s, d):
    return t.generated_events(s, 1000, 7)


def block_by_hash_indexed(s, d):
    """block_by_hash over blocks laid out by ranges of the index, through an index of hashes."""
    blocks, index = shared_path(s, "blocks"), shared_path(s, "hashes")
    t.write_blocks(t.ledger(s, d), blocks)
    stored = t.read_blocks(s, blocks)
    hash_index.write(stored, index)
    wanted = stored.where("block_index = 42").select("hash").first()
    return _own(hash_index.by_hash(stored, index, wanted.hash if wanted else ""))


def contract_events_source(s, d):
    """contract_events, exported as a node's logs and read back through the data source of logs."""
    path = shared_path(s, "node")
    e = t.anchor_events(s, d)
    args = F.when(F.col("technical_address").isNotNull(), F.array("technical_address", "merkle_root", "organization_id", "organization_name", "domain", F.col("ts").cast("string")))
    logs.export_logs(e.select(F.col("event_no").alias("block_number"), F.lit(0).cast("long").alias("log_index"), args.alias("args")), path)
    s.dataSource.register(logs.ContractLogs)
    return _text(anchors.from_args(s.read.format("contract_logs").option("path", path).load()).withColumnRenamed("block_number", "event_no").drop("log_index"), "ts")


def events_by_hour(s, d):
    """Agents' events through a stream that puts those of the future aside, counted by hour and action."""
    path = shared_path(s, "events")
    rows = t.agent_events(s, d).select("event_id", "action_type", "ts")
    rows.write.parquet(f"{path}/in")
    event_time.divided(s.readStream.schema(rows.schema).parquet(f"{path}/in"), path, f"{path}/checkpoint", 2_000_000_000).awaitTermination()
    return event_time.windowed_counts(s.read.parquet(f"{path}/accepted"), ["action_type"])


def keyed_heads_streamed(s, d):
    """per_model_heads by a stream that keeps each model's tip as state."""
    path = shared_path(s, "keyed")
    rows = t.requests(s, d).select("model_id", "block_index", "ts", "data")
    rows.write.parquet(f"{path}/in")
    before = {k: s.conf.get(k, None) for k in keyed.STATE_STORE}
    try:
        for k, v in keyed.STATE_STORE.items():
            s.conf.set(k, v)
        made = keyed.keyed_chains(s.readStream.schema(rows.schema).parquet(f"{path}/in"), "model_id")
        made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            s.conf.set(k, v) if v else s.conf.unset(k)
    return s.read.parquet(f"{path}/out").groupBy("model_id").agg(F.count("*").alias("blocks"), F.max_by("hash", "block_index").alias("head"))


def anchors_confirm_within(s, d):
    """Anchors with receipts that are mined up to a day after them; every fourth receipt is later."""
    a = t.anchors(s, d)
    n = (F.col("last_block_index") / t.ANCHOR_STEP).cast("long")
    mined = t.receipts(s, d).join(a.select("tx_hash", (F.col("anchored_at") + n % 4 * 43200).alias("mined_at")), "tx_hash")
    return _text(event_time.confirmations(a, mined), "block_number")


def verify_continued(s, d):
    """verify_tampered in three runs, each of which reads the blocks after those of the run before it."""
    blocks, path = t.tampered(t.stored(s, d)), shared_path(s, "checkpoints")
    last = blocks.agg(F.max("block_index")).first()[0]
    for part in (1, 2):
        verification.verify_on(blocks.where(F.col("block_index") <= last * part // 3), path)
    return verification.verify_on(blocks, path).drop("rewritten")


def _kept(s: SparkSession, d: str) -> str:
    """The statistics of the ledger, kept over four batches."""
    blocks, path = t.stored(s, d), shared_path(s, "statistics")
    last = blocks.agg(F.max("block_index")).first()[0]
    edges = [0, *(last * k // 4 for k in (1, 2, 3)), last + 1]
    for number, (lo, hi) in enumerate(zip(edges, edges[1:])):
        maintained.fold_batch(blocks.where((F.col("block_index") >= lo) & (F.col("block_index") < hi)), path, number)
    return path


def stats_maintained(s, d):
    """chain_stats from sums that each batch of blocks adds to."""
    return maintained.stats(s, _kept(s, d), t.anchors(s, d))


def blocks_per_model_maintained(s, d):
    """blocks_per_model from sums that each batch of blocks adds to."""
    return maintained.per_model(s, _kept(s, d))


def models_update_stored(s, d):
    """models_update of a stored table: the folders of the named models are rewritten."""
    m, path = t.models(s, d), shared_path(s, "models")
    buckets.write(m, path, "model_id")
    buckets.update_models(s, path, m.where("version = '1.0.1'").select("model_id", "version", F.concat("name", F.lit("-first")).alias("new_name")))
    return buckets.read(s, path, buckets.MODELS)


def models_delete_stored(s, d):
    """models_delete of a stored table."""
    m, path = t.models(s, d), shared_path(s, "models")
    buckets.write(m, path, "model_id")
    buckets.delete_models(s, path, m.where("version = '1.0.9'"))
    return buckets.read(s, path, buckets.MODELS)


def anchors_confirm_stored(s, d):
    """anchors_confirm of a stored table, by two parts of the receipts."""
    path, receipts = shared_path(s, "anchors"), t.receipts(s, d)
    buckets.write(t.anchors(s, d), path, "tx_hash")
    for part in (0, 1):
        buckets.confirm_anchors(s, path, receipts.where(F.pmod(F.xxhash64("tx_hash"), F.lit(2)) == part))
    return _text(buckets.read(s, path, ANCHORS), "block_number")


def _payloads(s, d):
    """(event_id, payload): nested payloads, some with a null."""
    n, kind = F.col("event_id"), F.col("event_type")
    note = F.when(n % 3 == 0, ',"note":null').otherwise("")
    text = F.concat(F.lit('{"event":{"id":'), n.cast("string"), F.lit(',"type":"'), kind, F.lit('"},"params":'), "props", F.lit(',"tags":["'), kind, F.lit('",{"user":'), F.col("user_id").cast("string"), F.lit("}]"), note, F.lit("}"))
    return variants.with_payload(t.table(s, d, "events").select("event_id", text.alias("data"))).drop("data")


def payloads_filtered(s, d):
    """Stored payloads by a nested field."""
    path = shared_path(s, "payloads")
    variants.write(_payloads(s, d), path)
    stored = variants.read(s, path, "event_id long, payload variant")
    found = stored.select("event_id", variants.field("$.params.k", "long").alias("k"), variants.field("$.event.type").alias("type"), variants.field("$.tags[1].user", "long").alias("user_id"))
    return found.where("k >= 10 and k < 20")


def payload_paths(s, d):
    return variants.paths(_payloads(s, d))


def queries() -> dict:
    own = [
        ledger_build, ledger_head, verify_chain, verify_tampered, verify_tampered_reader, verify_errors, chain_gaps, block_by_index, block_by_hash, blocks_page, blocks_page_unlimited,
        provenance_history, provenance_summary, chain_stats, chain_height, model_count, models_recent, models_page, model_by_id, model_by_name, model_ids, events_per_model, blocks_per_model, latest_block, type_labels,
        merkle_root_sha256, merkle_root_sorted_pairs, merkle_root_keccak, prefix_roots, anchor_prefix_roots, anchor_proofs, inclusion_proofs, anchor_decision, anchors_page, anchors_pending, anchors_confirm, contract_events, events_by_address, events_by_org,
        inference_accept, inference_reject, registration_unique, models_update, models_delete, model_provenance_join, drift_detect, suspicious_agents, weird_cases, unknown_models, action_links, action_links_all, data_structure_keys,
        conversation_hashes, per_model_heads, canonical_events, canonical_paths, keccak_documents, generated_events, models_recent_all, register_models, log_inferences, verify_recleaned, genesis_exists, anchors_append, anchored_events,
        provenance_report, stats_badges, events_from_args, requests_ingested, anchors_checked, frontier_root, anchor_due,
        block_by_hash_indexed, contract_events_source, events_by_hour, keyed_heads_streamed, anchors_confirm_within, verify_continued,
        stats_maintained, blocks_per_model_maintained, models_update_stored, models_delete_stored, anchors_confirm_stored,
        inferences_acknowledged, verify_excluded, models_registered, payloads_filtered, payload_paths,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
