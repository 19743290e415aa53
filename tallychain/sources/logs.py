"""Exported contract logs as a data source: block ranges are its partitions, block numbers its offsets.

    spark.dataSource.register(ContractLogs)
    spark.read.format("contract_logs").option("path", …).load()
    spark.readStream.format("contract_logs").option("path", …).load()

Options: path (a folder that export_logs wrote, on any file system that pyarrow opens), fromBlock (0), toBlock (the last one there), step
(blocks of a partition, 10000), pushdown (true where the session has spark.sql.python.filterPushdown.enabled). A stream reads from fromBlock on; each offset is the last block that is read, so a restarted stream
goes on after it. Blocks are exported whole and in order: what a folder holds up to its last block does not change.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "block_number long, log_index long, args array<string>"
FOLDER = "block_range="


def export_logs(logs: DataFrame, path: str, per_folder: int = 10_000, mode: str = "overwrite") -> None:
    """Write logs(block_number, log_index, args) as JSON lines, a folder for each range of as many blocks, named by its first block. Rows without a block
    number belong to no block and are an error."""
    number = F.when(F.col("block_number") >= 0, F.col("block_number")).otherwise(F.raise_error(F.lit("a log without a block number")).cast("long"))
    rows = logs.select(number.alias("block_number"), "log_index", "args")
    first = (F.floor(F.col("block_number") / F.lit(per_folder)) * per_folder).cast("long")
    rows.withColumn("block_range", first).repartition("block_range").write.mode(mode).partitionBy("block_range").json(path)


class Node:
    """What a chain's node answers, from exported files: its last block, and the logs of a range of blocks."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)

    def _firsts(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(i.base_name.removeprefix(FOLDER)) for i in found if i.base_name.startswith(FOLDER))

    def _lines(self, first: int) -> Iterator[dict]:
        for info in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{FOLDER}{first}")):
            if info.is_file and info.base_name.endswith(".json"):
                with self.fs.open_input_stream(info.path) as f:
                    left = b""
                    while chunk := f.read(1 << 20):
                        *lines, left = (left + chunk).split(b"\n")
                        yield from (json.loads(x) for x in lines if x)
                    if left:
                        yield json.loads(left)

    def latest(self) -> int:
        """The last block that has a log; -1 without any."""
        firsts = self._firsts()
        return max((x["block_number"] for x in self._lines(firsts[-1])), default=-1) if firsts else -1

    def logs(self, lo: int, hi: int) -> Iterator[tuple]:
        """(block_number, log_index, args) of blocks lo to hi, hi included."""
        firsts = self._firsts()
        for n, first in enumerate(firsts):
            if first <= hi and (n + 1 == len(firsts) or firsts[n + 1] > lo):
                for x in self._lines(first):
                    if lo <= x["block_number"] <= hi:
                        yield x["block_number"], x.get("log_index"), x.get("args")


@dataclass
class Blocks(InputPartition):
    lo: int
    hi: int


def ranges(lo: int, hi: int, step: int) -> list[Blocks]:
    """Blocks lo to hi in partitions that begin at multiples of step."""
    out = []
    while lo <= hi:
        end = min(hi, (lo // step + 1) * step - 1)
        out.append(Blocks(lo, end))
        lo = end + 1
    return out


class _Options:
    def __init__(self, options: dict) -> None:
        self.path, self.step = options["path"], int(options.get("step", 10_000))
        self.lo, self.hi = int(options.get("fromBlock", 0)), int(options["toBlock"]) if "toBlock" in options else None
        if self.step < 1:
            raise ValueError("step is at least 1")

    def last(self) -> int:
        latest = Node(self.path).latest()
        return latest if self.hi is None else min(self.hi, latest)


class Reader(_Options, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return ranges(self.lo, self.last(), self.step) or [Blocks(0, -1)]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        return Node(self.path).logs(partition.lo, partition.hi)


class PushedReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the block number shorten the range that is read; other filters are Spark's."""
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("block_number",):
                self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("block_number",):
                top = f.value - isinstance(f, LessThan)
                self.hi = top if self.hi is None else min(self.hi, top)
            else:
                yield f


class StreamReader(_Options, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"block": self.lo - 1}

    def latestOffset(self) -> dict:
        return {"block": max(self.last(), self.lo - 1)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return ranges(start["block"] + 1, end["block"], self.step)

    def read(self, partition: Blocks) -> Iterator[tuple]:
        return Node(self.path).logs(partition.lo, partition.hi)


class ContractLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contract_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (PushedReader if str(self.options.get("pushdown", "false")).lower() == "true" else Reader)(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)
