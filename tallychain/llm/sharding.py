"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallychain.llm.common import staged

#: Groups that one differencing task takes, partial partitions that one combining task takes, and rows in a run of slots.
BUCKET_GROUPS, FAN_IN, RUN_ROWS = 4000, 1024, 50_000


def difference(partials: Iterable[tuple[list[int], list]], shards: int) -> tuple[list[int], list]:
    """Partial partitions, each (sums, sets) with one entry per shard -> one of them.

    The two of the largest spread are combined until one is left: the largest sum of one meets the smallest of the other. Only what a sum
    is above its partition's least sum matters, so that is what is kept. A set is a tree: None, an item, or a pair of sets.
    """
    heap = []
    for n, (sums, sets) in enumerate(partials):
        order = sorted(range(shards), key=lambda i: (-sums[i], i))
        low = sums[order[-1]]
        heap.append((low - sums[order[0]], n, [sums[i] - low for i in order], [sets[i] for i in order]))
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, sa = heapq.heappop(heap)
        _, _, b, sb = heap[0]
        met = sorted(((x + y, (p, q) if p is not None and q is not None else q if p is None else p) for x, y, p, q in zip(a, reversed(b), sa, reversed(sb))), key=lambda m: -m[0])
        low = met[-1][0]
        heapq.heapreplace(heap, (low - met[0][0], made, [m[0] - low for m in met], [m[1] for m in met]))
        made += 1
    return (heap[0][2], heap[0][3]) if heap else ([0] * shards, [None] * shards)


def flat(tree) -> list:
    """The items of a set, without recursion: a tree can be as deep as it has items."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(x)
        elif x is not None:
            out.append(x)
    return out


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """groups(gkey: binary, bytes: long), one row each -> (gkey, shard).

    Each bucket of groups is differenced to one partial partition; those are combined by differencing in turn, so many at a
    time, until one is left. A task sees a bounded number of groups, or of partial partitions, however many there are.
    """
    groups = staged(groups, "groups")
    buckets = max(1, math.ceil(groups.count() / BUCKET_GROUPS))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("gkey"), F.lit(buckets)).cast("int"))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gkey"], ascending=[False, True])
        sizes, keys = pdf["bytes"].tolist(), pdf["gkey"].tolist()
        rest = [None] * (shards - 1)
        sums, sets = difference((([n, *[0] * (shards - 1)], [i, *rest]) for i, n in enumerate(sizes)), shards)
        rows = [(pdf["bucket"].iloc[0], keys[i], j, sums[j]) for j, tree in enumerate(sets) for i in flat(tree)]
        return pd.DataFrame(rows, columns=["bucket", "gkey", "part", "excess"])

    placed = staged(dealt.groupBy("bucket").applyInPandas(first, "bucket int, gkey binary, part int, excess long"), "placed")
    sums = placed.groupBy("bucket", "part").agg(F.max("excess").alias("excess")).groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("part", "excess"))).alias("m"))
    each = [F.coalesce(F.try_element_at("m", F.lit(j)), F.lit(0).cast("long")) for j in range(shards)]  # a part without groups has no excess
    node = sums.select(F.col("bucket").alias("node"), F.array(*each).alias("sums"))

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        nodes, sums = pdf["node"].tolist(), [list(map(int, s)) for s in pdf["sums"]]
        # an item is its node's place times the number of shards plus its part
        total, sets = difference(((s, [n * shards + j for j in range(shards)]) for n, s in enumerate(sums)), shards)
        moved = {k: [0] * shards for k in nodes}
        for to, tree in enumerate(sets):
            for k, j in (divmod(x, shards) for x in flat(tree)):
                moved[nodes[k]][j] = to
        return pd.DataFrame([(k, k // FAN_IN, moved[k], total) for k in nodes], columns=["node", "parent", "moved", "sums"])

    count = buckets
    placed = placed.select("gkey", F.col("bucket").alias("node"), "part")
    while True:
        up = staged(node.groupBy((F.col("node") / F.lit(FAN_IN)).cast("int").alias("parent")).applyInPandas(combine, "node int, parent int, moved array<int>, sums array<long>"), "combined")
        placed = placed.join(up.select("node", "parent", "moved"), "node").select("gkey", F.col("parent").alias("node"), F.element_at("moved", F.col("part") + 1).alias("part"))
        count = math.ceil(count / FAN_IN)
        if count <= 1:
            return placed.select("gkey", F.col("part").alias("shard"))
        node = up.groupBy(F.col("parent").alias("node")).agg(F.first("sums").alias("sums"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size: UTF-8 bytes + 1, text_crc32, law, shard, slot, grown_shard) for each row of docs.

    The law is `bytes`: sums of sizes are near equal. Equal texts form a group that is never divided, so one group above a shard's
    share sets the largest shard. A null text counts as the empty one. Slots count from 0 in each shard without gaps, by runs of hashed ids
    in order of the id; rows that repeat an id get slots of their own. grown_shard is null under this law. Only the id and text are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("gkey")), "rows")
    where = assign_groups(rows.groupBy("gkey").agg(F.sum("size").alias("bytes")), shards)
    runs = max(1, math.ceil(rows.count() / shards / RUN_ROWS))
    run = F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int")
    done = staged(rows.join(where, "gkey").select("doc_id", "size", "text_crc32", "shard", run.alias("run")), "sharded")
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = done.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    slot = (F.col("start") + F.row_number().over(within) - 1).cast("long")
    return done.join(starts, ["shard", "run"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
