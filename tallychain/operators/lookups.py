"""Point lookups, pages, histories and statistics over blocks, models and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallychain.functions.canonical import debug_json, text_to_long
from tallychain.functions.text import iso
from tallychain.operators import chain
from tallychain.session import staged


def by_index(blocks: DataFrame, index: int) -> DataFrame:
    return blocks.where(F.col("block_index") == index).orderBy("hash").limit(1)


def by_hash(blocks: DataFrame, hash_: str) -> DataFrame:
    return blocks.where(F.col("hash") == hash_).orderBy("block_index").limit(1)


def page(rows: DataFrame, order: list, limit: int = 10, skip: int = 0) -> DataFrame:
    """Rows from skip on, at most limit of them; a limit of 0 is no limit."""
    if limit:
        return rows.orderBy(*order).offset(skip).limit(limit)
    return _after(rows, order, skip) if skip else rows.orderBy(*order)


def _after(rows: DataFrame, order: list, skip: int) -> DataFrame:
    """All rows but the first `skip`, in order. An offset without a limit takes all rows through one task; here they are sorted once into the shared folder
    under numbers (a partition's in its upper bits, then the row's in it), so that counts of the partitions tell the number of the first row to stay."""
    number = "__number"
    placed = staged(rows.orderBy(*order).withColumn(number, F.monotonically_increasing_id()), "page")
    first = None
    for part, n in sorted(tuple(r) for r in placed.groupBy(F.shiftright(number, 33)).count().collect()):
        if skip < n:
            first = (part << 33) + skip
            break
        skip -= n
    return placed.where(F.col(number) >= F.lit(first)).orderBy(number).drop(number)


def model_by_id(models: DataFrame, model_id: str) -> DataFrame:
    return models.where(F.col("model_id") == model_id).orderBy("version", "created_at").limit(1)


def model_by_name(models: DataFrame, name: str, version: str) -> DataFrame:
    return models.where((F.col("name") == name) & (F.col("version") == version)).orderBy("model_id").limit(1)


def recent_models(models: DataFrame) -> DataFrame:
    return models.orderBy(F.desc("created_at"), "model_id", "version")


def history(promoted: DataFrame, model_id: str | None = None) -> DataFrame:
    """Provenance rows of one model, or of all."""
    rows = promoted if model_id is None else promoted.where(F.col("model_id") == model_id)
    return rows.select("model_id", "block_index", iso(F.col("ts")).alias("timestamp"), F.col("ts").alias("timestamp_unix"), "type", "version", "input_hash", "output_hash", "params", "metadata", F.col("hash").alias("block_hash"), "previous_hash")


def summary(promoted: DataFrame, model_id: str) -> DataFrame:
    """One row: model_id, total_blocks, chain_valid, error_count. An unknown model has no blocks, which is no error."""
    own = promoted.where(F.col("model_id") == model_id).agg(F.count("*").alias("total_blocks"))
    v = chain.verify(promoted).select(F.col("is_valid").alias("chain_valid"), (F.col("bad_hash") + F.col("broken_links")).alias("error_count"))
    return own.join(F.broadcast(v)).select(F.lit(model_id).alias("model_id"), "*")  # one row with one row


def report(promoted: DataFrame, model_ids: DataFrame) -> DataFrame:
    """One row for each distinct id of model_ids(model_id): total_blocks, chain_valid, verification_errors (messages in order) and history (structs in
    order of the index). The chain's errors are the same in every row; a sound chain has none. A model's blocks make one row, so ask for as many
    models as are to be read, not for a model with more blocks than a row holds."""
    fields = ["block_index", "timestamp", "timestamp_unix", "type", "version", "input_hash", "output_hash", "params", "metadata", "block_hash", "previous_hash"]
    asked = model_ids.select("model_id").distinct()
    own = history(promoted).join(asked, "model_id", "left_semi").groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("history"))
    found = chain.errors(promoted).agg(F.transform(F.sort_array(F.collect_list(F.struct("block_index", "kind", "message"))), lambda e: e["message"]).alias("verification_errors"))
    rows = asked.join(own, "model_id", "left").join(found)  # one row of errors
    return rows.select(
        "model_id", F.when(F.col("history").isNull(), 0).otherwise(F.size("history")).cast("long").alias("total_blocks"), (F.size("verification_errors") == 0).alias("chain_valid"), "verification_errors", F.coalesce("history", F.array().cast(own.schema["history"].dataType)).alias("history")
    )


def typed_blocks(documents: DataFrame) -> DataFrame:
    """documents(index, timestamp, data, previousHash, hash: texts) -> blocks; an index or a time that is no whole number is 0, a missing text is ''."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return documents.select(text_to_long(F.col("index")).alias("block_index"), text_to_long(F.col("timestamp")).alias("ts"), text("data").alias("data"), text("previousHash").alias("previous_hash"), text("hash").alias("hash"))


def badge(valid: Column) -> Column:
    return F.when(valid, "Passing").otherwise("Failing")


def last_anchor(anchors: DataFrame, explorer: str = "https://explorer.invalid/tx/") -> DataFrame:
    top = anchors.orderBy(F.desc_nulls_last("last_block_index"), "tx_hash").limit(1)
    return top.withColumn("explorer_url", F.when(F.col("tx_hash") != "", F.concat(F.lit(explorer), "tx_hash")))


def stats(promoted: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row of the ledger's figures; models without the genesis one, zeros and blanks for an empty ledger."""
    a = promoted.agg(F.count("*").alias("total_blocks"), F.greatest(F.countDistinct("model_id") - 1, F.lit(0).cast("long")).alias("total_models"), F.max(F.struct("block_index", "hash", "ts")).alias("t"))
    own = a.select("total_blocks", "total_models", F.coalesce("t.block_index", F.lit(0)).alias("last_block_index"), F.coalesce("t.hash", F.lit("")).alias("last_block_hash"), iso(F.col("t.ts")).alias("last_block_timestamp"), F.coalesce("t.ts", F.lit(0)).alias("last_block_timestamp_unix"))
    v = chain.verify(promoted).select(F.col("is_valid").alias("chain_valid"), (F.col("bad_hash") + F.col("broken_links")).alias("error_count"))
    return own.join(F.broadcast(v)).join(F.broadcast(anchor_columns(anchors)), F.lit(True), "left")  # one row each


def anchor_columns(anchors: DataFrame) -> DataFrame:
    """The last anchor's columns of stats."""
    return last_anchor(anchors).select(F.col("last_block_index").alias("anchor_block_index"), F.col("tx_hash").alias("anchor_tx_hash"), F.col("status").alias("anchor_status"), F.col("explorer_url").alias("anchor_url"))


def per_model(promoted: DataFrame) -> DataFrame:
    return promoted.groupBy("model_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("type") == "inference").alias("inferences"), F.max("block_index").alias("last_block_index"))


def structure(blocks: DataFrame) -> DataFrame:
    """(block_index, keys, has_null, text): top-level keys in order, whether a value is null, and the text that only these keys leave."""
    keys = F.array_sort(F.json_object_keys("data"))
    null = F.exists(F.map_values(F.from_json("data", "map<string, string>")), lambda v: v.isNull())
    return blocks.select("block_index", F.array_join(keys, ",").alias("keys"), null.alias("has_null"), debug_json(F.col("data")).alias("text"))
