"""Token counts of documents in flat token files that have no index but an end-of-document identifier."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallychain.llm.common import bounded_batches, shared_dir, staged

#: Where the public vocabulary lies and how it splits text before merging (see its README); identifier 50256 is free in it.
RANKS, SEPARATOR = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DTYPE, BLOCK_TOKENS = "<u2", 1 << 18
#: Blocks of a file whose running sums one task makes.
SPAN = 4096


@cache
def encoder(path: str = RANKS) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it; Spark writes file:/x for file:///x."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def write_flat(docs: DataFrame, folder: str, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as flat token files below folder, one per partition: 16-bit identifiers and nothing else, each document's followed by the
    separator. Gives the order of the ids, which the files don't hold: rows (file, path, first: place of the first id in its file, ids), and
    for each file one row with its bytes.

    A file's name is new in each attempt, and the table, which is written once, names the files of the attempts that counted; what a lost
    task left behind is not read. A null text has no tokens but its separator. Any folder that pyarrow.fs opens will do.
    """
    bounded_batches(docs.sparkSession, 500)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, encode = TaskContext.get().partitionId(), encoder(ranks).encode_ordinary
        path = f"{folder}/{file:06d}-{uuid.uuid4().hex}.tokens"
        system, place = _opened(path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        seen, written = 0, 0
        with system.open_output_stream(place) as out:
            for pdf in batches:
                for text in pdf["text"]:
                    flat = np.array([*encode(text or ""), SEPARATOR], DTYPE)
                    out.write(flat.tobytes())
                    written += flat.nbytes
                yield pd.DataFrame([(file, path, seen, [None if pd.isna(x) else int(x) for x in pdf["doc_id"]], None)], columns=["file", "path", "first", "ids", "bytes"])
                seen += len(pdf)
        yield pd.DataFrame([(file, path, None, None, written)], columns=["file", "path", "first", "ids", "bytes"])

    return staged(own.mapInPandas(run, "file int, path string, first long, ids array<long>, bytes long"), "flat")


def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """(file: its path, path, bytes) of the flat token files under path; their contents are not read for that."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "path", F.col("length").alias("bytes"))


def _ranges(files: DataFrame, block: int, dtype: str) -> tuple[DataFrame, Callable]:
    """The byte ranges of files, dealt over the tasks, and what reads a batch of them: it gives each range's file, number and bytes."""
    step = block * np.dtype(dtype).itemsize
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("bytes") / step) - 1))).alias("block")
    tasks = files.sparkSession.sparkContext.defaultParallelism

    def read(pdf: pd.DataFrame) -> Iterator[tuple]:
        for path, rows in pdf.groupby("path"):
            system, place = _opened(path)
            with system.open_input_file(place) as f:
                for file, n in zip(rows["file"], rows["block"]):
                    f.seek(int(n) * step)
                    yield file, n, f.read(step)

    return files.where("bytes > 0").select("file", "path", cut).repartition(4 * tasks, "path", "block"), read


def read_blocks(files: DataFrame, block: int = BLOCK_TOKENS, dtype: str = DTYPE) -> DataFrame:
    """files(file, path, bytes) -> (file, block, tokens): each task reads its byte ranges of files of any size, cut anywhere between tokens."""
    ranges, read = _ranges(files, block, dtype)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in read(pdf):
                yield pd.DataFrame([row], columns=["file", "block", "tokens"])

    return ranges.mapInPandas(run, f"file {files.schema['file'].dataType.simpleString()}, block long, tokens binary")


FOUND = "block long, ends long, head long, tail long, inner array<long>"


def _found(file, block: int, data: bytes, separator: int, dtype: str) -> tuple:
    """A block's separators: how many, the tokens before the first and after the last, and the lengths between them."""
    x = np.frombuffer(data, dtype)
    at = np.flatnonzero(x == separator)
    head, tail = (int(at[0]), len(x) - 1 - int(at[-1])) if len(at) else (len(x), len(x))
    return file, block, len(at), head, tail, (np.diff(at) - 1).tolist()


def scan(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """blocks(file, block, tokens) -> (file, nth, n_tokens): the tokens of each document before its separator; nth counts from 0 in a file.

    Each block is searched by itself, for the number of separators, the tokens before the first and after the last, and the lengths between
    them. Running sums over these few numbers per block then say which document a block begins in and how many of its tokens came before, so
    that documents over a cut, or over many blocks, are whole. Tokens after a file's last separator are a document of their own.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_found(*row, separator, dtype) for row in zip(pdf["file"], pdf["block"], pdf["tokens"])]
            yield pd.DataFrame(rows, columns=["file", "block", "ends", "head", "tail", "inner"])

    kind = blocks.schema["file"].dataType.simpleString()
    return _stitched(blocks.select("file", "block", "tokens").mapInPandas(find, f"file {kind}, {FOUND}"))


def scan_files(files: DataFrame, block: int = BLOCK_TOKENS, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """scan() of files(file, path, bytes), each block searched by the task that reads it."""
    ranges, read = _ranges(files, block, dtype)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_found(*row, separator, dtype) for row in read(pdf)]
            yield pd.DataFrame(rows, columns=["file", "block", "ends", "head", "tail", "inner"])

    return _stitched(ranges.mapInPandas(find, f"file {files.schema['file'].dataType.simpleString()}, {FOUND}"))


def _stitched(found: DataFrame) -> DataFrame:
    """What was found in each block -> (file, nth, n_tokens) over the blocks' cuts."""
    sums = staged(found, "separators").withColumn("span", F.floor(F.col("block") / SPAN).cast("long"))
    # within spans of blocks first, then over the spans of a file, so that no task holds all blocks of a large file
    inside = _carried(sums, ["file", "span"], "block")
    spans = _carried(sums.drop("inner"), ["file", "span"], "block").groupBy("file", "span")
    after = F.max_by(F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail")), "block")
    spans = _carried(spans.agg(F.sum("ends").alias("ends"), after.alias("tail")).withColumn("head", F.col("tail")), ["file"], "span")
    here, there = inside.alias("i"), spans.alias("s")
    carried = F.col("i.carried") + F.when(F.col("i.seen"), 0).otherwise(F.col("s.carried"))
    few = here.join(there, (F.col("i.file") == F.col("s.file")) & (F.col("i.span") == F.col("s.span"))).where("i.ends > 0")
    closed = few.select("i.file", (F.col("i.nth") + F.col("s.nth")).alias("nth"), F.posexplode(F.concat(F.array(carried + F.col("i.head")), "i.inner")).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("nth") + F.col("i")).alias("nth"), "n_tokens")
    last = spans.groupBy("file").agg(F.sum("ends").alias("nth"), F.max_by(F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail")), "span").alias("n_tokens"))
    return closed.union(last.where("n_tokens > 0"))


def _carried(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows(*by, order, ends, head, tail) with what comes before each in its group: nth, the separators; carried, the tokens since the last of
    them; seen, whether there is one. A row without a separator has all its tokens as its head and tail."""
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # tokens since the last separator = all tokens of rows without one since then, and the tail of the row that has it
    plain = F.when(F.col("ends") == 0, F.col("head")).otherwise(0)
    out = rows.withColumns({"nth": F.coalesce(F.sum("ends").over(earlier), F.lit(0)), "plain": F.sum(plain).over(so_far)})
    mark = F.last(F.when(F.col("ends") > 0, F.col("tail") - F.col("plain")), ignorenulls=True).over(earlier)
    out = out.withColumns({"carried": F.coalesce(mark, F.lit(0)) + F.col("plain") - plain, "seen": mark.isNotNull()})
    return out.drop("plain")


def token_counts(docs: DataFrame, ranks: str = RANKS, block: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for each row of docs, counted in flat token files in the shared folder. Repeated rows are counted each; a null or
    empty text has 0 tokens, a text of any length is counted whole, and an empty table gives an empty table. Further columns are not read."""
    flat = write_flat(docs, f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}", ranks, id_col, text_col)
    counts = scan_files(flat.where("bytes is not null").select("file", "path", "bytes"), block)
    order = flat.where("ids is not null").select("file", "first", F.posexplode("ids").alias("i", "doc_id"))
    order = order.select("file", (F.col("first") + F.col("i")).alias("nth"), "doc_id")
    return order.join(counts, ["file", "nth"]).select("doc_id", "n_tokens")
