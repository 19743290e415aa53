"""A Merkle tree that grows: its frontier (the roots of its complete subtrees from the left, one for each bit of the number of leaves) is all
that is kept, and a batch of new leaves extends it without the old ones."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.operators import merkle
from tallychain.operators.merkle import POSITIONAL, Tree
from tallychain.session import staged

NODES = "level int, pos long, node binary"
#: A frontier: the node of each level that has one. There are at most 63, so it is kept on the driver.
Frontier = dict[int, bytes]


def length(peaks: Frontier) -> int:
    """The number of leaves below a frontier."""
    return sum(1 << level for level in peaks)


def root(peaks: Frontier, tree: Tree = POSITIONAL) -> bytes | None:
    """The root of the whole tree; None without leaves. The lowest subtree is an odd last node on its level; on its way up the last node is paired with
    the subtree on its left where there is one, else it is odd again."""
    if not peaks:
        return None
    low, top = min(peaks), max(peaks)
    node = peaks[low]
    for level in range(low, top):
        node = tree.up([node] if level == low or level not in peaks else [peaks[level], node])[0]
    return node if low == top else tree.up([peaks[top], node])[0]


def climb(first: int, nodes: list[bytes], peaks: Frontier, base: int, levels: int, tree: Tree) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, bytes]]]:
    """nodes in a row on level base, from place `first` on, with the frontier before them -> (nodes that stay without a right neighbour as (level, pos,
    node), and the nodes that reach level base + levels)."""
    left = []
    for level in range(base, base + levels):
        if first % 2 and (nodes or level in peaks):
            nodes, first = [peaks[level], *nodes], first - 1
        if len(nodes) % 2:
            left.append((level, first + len(nodes) - 1, nodes[-1]))
        nodes, first = tree.up(nodes[: len(nodes) // 2 * 2]), first // 2
    return left, [(first + i, x) for i, x in enumerate(nodes)]


def extended(peaks: Frontier, leaves: DataFrame, tree: Tree = POSITIONAL, levels: int | None = None) -> Frontier:
    """The frontier after leaves(pos, leaf), whose positions go on from the frontier's length without gaps; else it is an error.

    Tasks take aligned runs of 2 ** levels nodes and pair them up; what is left of a run without a neighbour is at most one node a level. Only the
    run that holds the first new leaf needs the old frontier. So a batch costs its own leaves, and no more rounds than its height has runs.
    """
    levels = levels or merkle.LEVELS
    start = length(peaks)
    told = leaves.agg(F.count("*"), F.min("pos"), F.max("pos")).first()
    if not told[0]:
        return dict(peaks)
    if (told[1], told[2]) != (start, start + told[0] - 1):
        raise ValueError(f"{told[0]} leaves from {told[1]} to {told[2]} do not follow {start} leaves")
    total, base, found = start + told[0], 0, {}
    now = leaves.select("pos", F.col("leaf").alias("node"))
    while True:
        top = base + levels

        def pair(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos")
            first = int(pdf["pos"].iloc[0])
            old = peaks if first >> levels == start >> top else {}
            left, up = climb(first, [bytes(x) for x in pdf["node"]], old, base, levels, tree)
            return pd.DataFrame([*left, *((top, p, x) for p, x in up)], columns=["level", "pos", "node"])

        run = F.floor(F.col("pos") / F.lit(1 << levels)).cast("long")
        made = staged(now.groupBy(run.alias("run")).applyInPandas(pair, NODES), "frontier")
        found |= {r.level: bytes(r.node) for r in made.where(F.col("level") < top).collect()}  # the last node of a level, where it has none to its right
        if start >> top == total >> top:  # no new node up there
            return found | {k: v for k, v in peaks.items() if k >= top}
        now, base = made.where(F.col("level") == top).select("pos", "node"), top


def frame(spark, peaks: Frontier) -> DataFrame:
    """A frontier as rows (level, pos, node)."""
    return spark.createDataFrame([(k, (length(peaks) >> k) - 1, bytearray(v)) for k, v in sorted(peaks.items())], NODES)


def taken(rows: Iterable) -> Frontier:
    """A frontier from its rows."""
    return {int(r["level"]): bytes(r["node"]) for r in rows}
