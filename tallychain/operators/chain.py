"""The hash chain: genesis, appending, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallychain.functions.canonical import with_text
from tallychain.functions.hashing import block_hash
from tallychain.functions.text import short
from tallychain.operators.numbering import SPAN, with_previous
from tallychain.session import shared_path

BLOCKS = "block_index long, ts long, data string, previous_hash string, hash string"
ROOT = "0"
#: Blocks that one task hashes, blocks of one file of a chain, and the range of blocks without an index.
SEGMENT, PER_FILE, FIRST = 1 << 20, 1 << 18, -(1 << 62)
#: Modes in which every block is checked and both kinds of error are reported.
WRITERS = ("writer", "excluding")
GENESIS_DATA = '{"metadata":{"description":"Genesis block"},"modelId":"genesis","type":"model_registration"}'


def genesis(spark: SparkSession, ts: int, data: str = GENESIS_DATA) -> DataFrame:
    """The first block's input row: (block_index, ts, data)."""
    return spark.createDataFrame([(0, ts, data)], "block_index long, ts long, data string")


def fold(rows: DataFrame, previous: str = ROOT, keys: tuple[str, ...] = (), segment: int | None = None) -> DataFrame:
    """rows(*keys, block_index, ts, data) -> the same with previous_hash and hash, each block's hash covering its predecessor's.

    The recurrence is sequential; only what is hashed goes through it, as Arrow batches. Without keys the rows are first laid out by ranges of the index in
    the shared folder, and one task after the other hashes a segment of at most about `segment` rows from the last hash of the one before, so that no task
    reads the whole chain; more than one segment is hashed when this is called. With keys there is one chain for each, and chains run in parallel, many to a
    task, none held in memory; a null key is a key of its own. Rows may have a text `covered`, which is hashed in place of data and not kept; where it is
    null, data is hashed. Rows without an index come first; those of one index lie in one segment.
    """
    kept = [*keys, "block_index", "ts", "data"]
    wide = rows.select(*kept, *[c for c in rows.columns if c == "covered"])
    if keys:
        return _hashed(wide.repartition(*keys).sortWithinPartitions(*keys, "block_index"), previous, keys).drop("at")
    spark, laid, out = rows.sparkSession, shared_path(rows.sparkSession, "rows"), shared_path(rows.sparkSession, "folded")
    size = segment or SEGMENT
    part = F.coalesce(F.floor(F.col("block_index") / F.lit(size)).cast("long"), F.lit(FIRST).cast("long"))
    wide = wide.withColumn("part", part)
    wide.repartition("part", F.floor(F.col("block_index") / F.lit(SPAN))).write.partitionBy("part").parquet(laid)
    stored = spark.read.schema(wide.schema).parquet(laid)
    steps: list[list[int]] = []  # first range, last range, rows
    for lo, n in sorted(tuple(r) for r in stored.groupBy("part").count().collect()):
        if steps and steps[-1][2] + n <= size:
            steps[-1][1:] = lo, steps[-1][2] + n
        else:
            steps.append([lo, lo, n])

    def hashed(lo: int, hi: int, last: str) -> DataFrame:
        return _hashed(stored.where(F.col("part").between(lo, hi)).drop("part").coalesce(1).sortWithinPartitions("block_index"), last)

    if len(steps) < 2:
        return hashed(*(steps[0][:2] if steps else (FIRST, FIRST)), previous).drop("at")
    for number, (lo, hi, _) in enumerate(steps):
        tip = Observation()
        made = hashed(lo, hi, previous).observe(tip, F.max(F.struct("at", "hash")).alias("last"))
        made.drop("at").write.option("maxRecordsPerFile", PER_FILE).parquet(f"{out}/step={number}")
        previous = tip.get["last"]["hash"]
    return spark.read.schema(made.drop("at").schema).parquet(*[f"{out}/step={n}" for n in range(len(steps))])


def _hashed(dealt: DataFrame, previous: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each partition's rows in their order, with previous_hash, hash and their place in the partition."""
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    kept = [*keys, "block_index", "ts", "data"]
    blank = lambda x: "" if x is None else x

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, last, at = None, previous, 0
        for batch in batches:
            before, after = [], []
            columns = [batch.column(n).to_pylist() for n in range(batch.num_columns)]
            owners = zip(*columns[: len(keys)]) if keys else [()] * batch.num_rows
            for own, i, ts, data, *covered in zip(owners, *columns[len(keys) :]):
                if own != owner:
                    owner, last = own, previous
                before.append(last)
                last = hashlib.sha256(f"{blank(i)}|{blank(ts)}|{blank(next((c for c in covered if c is not None), data))}|{last}".encode()).hexdigest()
                after.append(last)
            places = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            made = [*batch.columns[: len(kept)], *(pa.array(x, pa.string()) for x in (before, after)), places]
            yield pa.RecordBatch.from_arrays(made, [*kept, "previous_hash", "hash", "at"])

    return dealt.mapInArrow(carry, "".join(f"{k} {kinds[k]}, " for k in keys) + BLOCKS + ", at long")


def append(blocks: DataFrame, rows: DataFrame, genesis_ts: int | None = None) -> DataFrame:
    """New blocks for rows(ord, ts, data) after the tip of blocks; not written. Indices go on from the tip's, in order of ord. data is stored as it
    is; see writes.prepared for what makes a request's JSON a payload, and fold for rows with a text `covered`.

    An empty chain first gets its genesis block if genesis_ts is given, which is then among the new blocks; else its first row gets index 0.
    """
    from tallychain.operators.numbering import numbered

    tip = blocks.agg(F.max(F.struct("block_index", "hash")).alias("t")).select("t.*").first()
    index, last = (tip[0] + 1, tip[1]) if tip and tip[0] is not None else (0, ROOT)
    first = index == 0 and genesis_ts is not None
    new = numbered(rows, "ord", "block_index", index + first).select("block_index", "ts", "data", *[c for c in rows.columns if c == "covered"])
    return fold(new.unionByName(genesis(rows.sparkSession, genesis_ts), allowMissingColumns=True) if first else new, last)


def has_genesis(blocks: DataFrame) -> DataFrame:
    """One row: whether there is a block 0."""
    return blocks.agg(F.coalesce(F.bool_or(F.col("block_index") == 0), F.lit(False)).alias("has_genesis"))


def checked(blocks: DataFrame, mode: str = "writer") -> DataFrame:
    """blocks with expected_hash (recomputed), before (the hash of the block before by position) and whether either is off. In mode `recleaned`
    the payload is cleaned and encoded anew before it is hashed, as the second verifier does; in mode `excluding` it is made canonical without
    canonical.EXCLUDED, for chains whose payloads keep these keys, and a text that is no JSON is hashed as it is; else its stored text is. A block without an
    index has no place in the chain, so its link is broken; it comes before no other block."""
    placed = F.col("block_index").isNotNull()
    out = with_previous(blocks, "block_index", "hash", "before", "hash").withColumn("before", F.when(placed, F.col("before")).otherwise(""))
    if mode in ("recleaned", "excluding"):
        out = with_text(out, "hashed", F.col("data"), "reader" if mode == "recleaned" else "jcs")
    data = F.col("hashed") if mode == "recleaned" else F.coalesce("hashed", "data") if mode == "excluding" else F.col("data")
    out = out.withColumn("expected_hash", block_hash(F.col("block_index"), F.col("ts"), data, F.col("previous_hash"))).drop("hashed")
    bad = F.coalesce(F.col("hash") != F.col("expected_hash"), F.lit(True))
    broken = F.col("before").isNotNull() & ~F.col("previous_hash").eqNullSafe(F.col("before"))
    return out.withColumns({"bad_hash": bad, "broken_link": broken})


def errors(blocks: DataFrame, mode: str = "writer") -> DataFrame:
    """(block_index, kind, message), kind 1 for a wrong hash and 2 for a broken link.

    The writer's rules check every block and report both kinds; the reader's rules take the first block as right, and a broken link hides a wrong hash.
    Mode `recleaned` has the reader's rules on payloads cleaned anew.
    """
    c = checked(blocks, mode)
    if mode not in WRITERS:
        c = c.where(F.col("before").isNotNull()).withColumn("bad_hash", F.col("bad_hash") & ~F.col("broken_link"))
    label = F.concat(F.lit("Block "), F.coalesce(F.col("block_index").cast("string"), F.lit("without index")))
    wrong = F.struct(F.lit(1).alias("kind"), F.concat(label, F.lit(": Hash mismatch")).alias("message"))
    text = F.concat(label, F.lit(": Hashchain broken ! (previousHash: "), short(F.coalesce("previous_hash", F.lit(""))), F.lit("..., expected: "), short(F.coalesce("before", F.lit(""))), F.lit("...)"))
    link = F.struct(F.lit(2).alias("kind"), text.alias("message"))
    found = F.filter(F.array(F.when(F.col("bad_hash"), wrong), F.when(F.col("broken_link"), link)), lambda x: x.isNotNull())
    return c.where("bad_hash or broken_link").select("block_index", F.inline(found))


def verify(blocks: DataFrame, mode: str = "writer") -> DataFrame:
    """One row: total, bad_hash, broken_links, invalid_blocks, is_valid. An empty chain is valid."""
    c = checked(blocks, mode)
    if mode not in WRITERS:
        first = F.col("before").isNull()
        c = c.withColumn("bad_hash", F.col("bad_hash") & ~F.col("broken_link") & ~first)
    sums = c.agg(F.count("*").alias("total"), F.count_if("bad_hash").alias("bad_hash"), F.count_if("broken_link").alias("broken_links"), F.count_if(F.col("bad_hash") | F.col("broken_link")).alias("invalid_blocks"))
    return sums.withColumn("is_valid", F.col("invalid_blocks") == 0)


def gaps(blocks: DataFrame) -> DataFrame:
    """(block_index, before_index) where an index is not the one before plus one: gaps, and forks as repeated indices."""
    out = with_previous(blocks.select("block_index", "hash", F.col("block_index").alias("own_index")), "block_index", "own_index", "before_index", "hash")
    return out.where(F.col("before_index").isNotNull() & (F.col("block_index") != F.col("before_index") + 1)).select("block_index", "before_index")
