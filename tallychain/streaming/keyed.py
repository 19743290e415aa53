"""A chain for each key, kept as state of a stream: the tip of each chain, and nothing else."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallychain.operators.chain import ROOT

#: The state store that keyed chains need, for the session's conf.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "block_index long, ts long, data string, previous_hash string, hash string, late boolean"


class Chains(StatefulProcessor):
    """Appends the rows of a key to its chain, in order of their index within each micro-batch."""

    def __init__(self, key: str, ttl_ms: int | None) -> None:
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tip = handle.getValueState("tip", "block_index long, hash string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        index, last = self.tip.get() if self.tip.exists() else (-1, ROOT)
        before = index
        for pdf in [pd.concat(list(rows)).sort_values(["block_index", "ts", "data"])]:
            out = []
            for i, ts, data in zip(pdf["block_index"].tolist(), pdf["ts"].tolist(), pdf["data"].tolist()):
                if i <= index:
                    out.append((key[0], i, ts, data, None, None, True))
                    continue
                hash_ = hashlib.sha256(f"{i}|{ts}|{data}|{last}".encode()).hexdigest()
                out.append((key[0], i, ts, data, last, hash_, False))
                index, last = i, hash_
            if index > before:
                self.tip.update((index, last))
            yield pd.DataFrame(out, columns=[self.key, "block_index", "ts", "data", "previous_hash", "hash", "late"])

    def close(self) -> None:
        pass


def keyed_chains(rows: DataFrame, key: str, ttl_ms: int | None = None) -> DataFrame:
    """rows(key, block_index, ts, data), a stream or a table -> the same with previous_hash and hash, one chain for each key as chain.fold makes them.

    What is kept of a key is the index and the hash of its last block; a micro-batch holds its own rows of a key, so bound it by the source's
    options. A row whose index is not above its chain's last one is late: it is given back without hashes and changes nothing. With ttl_ms a key that
    gets no block for so long is forgotten and begins anew. Rows without an index, a time, data or a key are left out. Needs STATE_STORE.
    """
    kind = rows.schema[key].dataType.simpleString()
    whole = rows.select(key, "block_index", "ts", "data").where(" and ".join(f"{c} is not null" for c in (f"`{key}`", "block_index", "ts", "data")))
    mode = "none" if ttl_ms is None else "processingTime"
    return whole.groupBy(key).transformWithStateInPandas(Chains(key, ttl_ms), f"`{key}` {kind}, {OUT}", "Append", mode)
