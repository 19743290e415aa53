"""Merkle roots by aligned subtrees, prefix roots and inclusion proofs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallychain.functions.hashing import keccak256_many, sha256_many
from tallychain.session import staged

#: Levels that one task reduces: subtrees of 2 ** 12 leaves.
LEVELS = 12
#: Proofs of one run that one task makes at once.
SLICE = 1 << 16
#: Nodes on a level of the tree of a prefix.
WIDTH = "cast(ceil(length / cast(shiftleft(1L, level) as decimal(20))) as long)"


@dataclass(frozen=True)
class Tree:
    """hash: sha256 or keccak; sort_pairs: whether a pair's smaller digest comes first; duplicate: whether an odd last node is paired with
    itself, else it moves up as it is."""

    hash: str = "sha256"
    sort_pairs: bool = False
    duplicate: bool = True

    def up(self, nodes: list[bytes]) -> list[bytes]:
        """The next level."""
        pairs = list(zip(nodes[::2], nodes[1::2]))
        odd = nodes[-1:] if len(nodes) % 2 else []
        if odd and self.duplicate:
            pairs.append((odd[0], odd[0]))
            odd = []
        joined = [min(a, b) + max(a, b) if self.sort_pairs else a + b for a, b in pairs]
        return (sha256_many if self.hash == "sha256" else keccak256_many)(joined) + odd


POSITIONAL = Tree()
SORTED = Tree("keccak", True, False)


def roots(leaves: DataFrame, tree: Tree = POSITIONAL, key: str = "tree") -> DataFrame:
    """leaves(key, pos from 0 without gaps, leaf: binary) -> (key, n_leaves, root: binary), one tree for each key.

    A level's nodes are cut into aligned runs of 2 ** LEVELS, each reduced to one node by a task, until one node is left. A run that is not
    the whole level climbs all its levels, since there an odd last node has others beside it.
    """
    kind = leaves.schema[key].dataType.simpleString()
    sizes = leaves.groupBy(key).agg(F.count("*").alias("n_leaves"))
    most = sizes.agg(F.max("n_leaves")).first()[0] or 0

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        nodes, alone = [bytes(x) for x in pdf["leaf"]], bool(pdf["alone"].iloc[0])
        for _ in range(LEVELS):
            if alone and len(nodes) == 1:
                break
            nodes = tree.up(nodes)
        return pd.DataFrame([(pdf["key"].iloc[0], int(pdf["run"].iloc[0]), nodes[0])], columns=[key, "pos", "leaf"])

    now, left = leaves.select(key, "pos", "leaf"), F.col("n_leaves")
    while True:
        run = (F.col("pos") / F.lit(1 << LEVELS)).cast("long")
        rows = now.join(sizes, key).select(F.col(key).alias("key"), run.alias("run"), "pos", "leaf", (left <= 1 << LEVELS).alias("alone"))
        now = rows.groupBy("key", "run").applyInPandas(reduce, f"{key} {kind}, pos long, leaf binary")
        if most <= 1 << LEVELS:
            return now.join(sizes, key).select(key, "n_leaves", F.col("leaf").alias("root"))
        most, left = -(-most >> LEVELS), F.ceil(left / F.lit(1 << LEVELS))


def root(leaves: DataFrame, tree: Tree = POSITIONAL) -> DataFrame:
    """leaves(pos, leaf) -> one row (n_leaves, root: lower-case hex); no row without leaves."""
    one = roots(leaves.select(F.lit(0).alias("tree"), "pos", "leaf"), tree)
    return one.select("n_leaves", F.lower(F.hex("root")).alias("root"))


def complete_nodes(leaves: DataFrame, tree: Tree = POSITIONAL) -> DataFrame:
    """leaves(pos from 0 without gaps, leaf) -> (level, pos, node): every node whose subtree is full, the leaves at level 0.

    A prefix's tree shares all its nodes with these but the last one of each level.
    """
    most = leaves.count()

    def climb(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        nodes, first, out = [bytes(x) for x in pdf["node"]], int(pdf["pos"].iloc[0]), []
        for up in range(1, LEVELS + 1):
            nodes = tree.up(nodes[: len(nodes) // 2 * 2])
            first //= 2
            out += [(int(pdf["level"].iloc[0]) + up, first + i, x) for i, x in enumerate(nodes)]
        return pd.DataFrame(out, columns=["level", "pos", "node"])

    now, level = leaves.select(F.lit(0).alias("level"), "pos", F.col("leaf").alias("node")), 0
    found = now
    while most > 1:
        run = (F.col("pos") / F.lit(1 << LEVELS)).cast("long")
        made = staged(now.groupBy(run.alias("run")).applyInPandas(climb, "level int, pos long, node binary"), "nodes")
        found, level, most = found.union(made), level + LEVELS, most >> LEVELS
        now = made.where(F.col("level") == level)
    return found


def _spines(nodes: DataFrame, lengths: DataFrame, tree: Tree) -> DataFrame:
    """lengths(length) -> (length, spine: the last node of each level, leaf first and root last), for each distinct length that nodes has."""
    asked = lengths.select(F.col("length").cast("long").alias("length")).where("length > 0").distinct()
    level = F.explode(F.sequence(F.lit(0), F.lit(62))).alias("level")
    spans = asked.select("length", level).withColumn("width", F.expr(WIDTH)).where("width > 1 or level = 0")
    beside = spans.where("width > 1 and width % 2 = 0").select("length", "level", (F.col("width") - 2).alias("pos"), F.lit(False).alias("own"))
    own = asked.select("length", F.lit(0).alias("level"), (F.col("length") - 1).alias("pos"), F.lit(True).alias("own"))
    met = own.union(beside).join(nodes, ["level", "pos"])
    parts = met.groupBy("length").agg(F.max(F.when(F.col("own"), F.col("node"))).alias("leaf"), F.sort_array(F.collect_list(F.when(~F.col("own"), F.struct("level", "node")))).alias("beside"))

    @F.pandas_udf("array<binary>")
    def rise(length: pd.Series, leaf: pd.Series, beside: pd.Series) -> pd.Series:
        def one(width: int, node: bytes, others: dict[int, bytes]) -> list[bytes]:
            out = [node]
            while width > 1:
                node = tree.up([others[len(out) - 1], node] if width % 2 == 0 else [node])[0]
                width = (width + 1) // 2
                out.append(node)
            return out

        return pd.Series([one(n, bytes(x), {o["level"]: bytes(o["node"]) for o in b}) for n, x, b in zip(length, leaf, beside)])

    return parts.where("leaf is not null").select("length", rise("length", "leaf", "beside").alias("spine"))


def prefix_roots(leaves: DataFrame, lengths: DataFrame, tree: Tree = POSITIONAL) -> DataFrame:
    """lengths(length) -> (length, root): the root of the first `length` leaves, for each distinct length that there are leaves for.

    All prefixes share one pass over the leaves: each then looks up its last leaf and, on every level with an even number of nodes, the
    node before its last one, so a prefix costs as many rows as its tree has levels.
    """
    made = _spines(complete_nodes(staged(leaves.select("pos", "leaf"), "leaves"), tree), lengths, tree)
    return made.select("length", F.lower(F.hex(F.element_at("spine", -1))).alias("root"))


def inclusion_proofs(leaves: DataFrame, asked: DataFrame, tree: Tree = POSITIONAL) -> DataFrame:
    """asked(length, pos) -> (length, pos, leaf, siblings: array of (level, on_left, node), root: hex): the proof that leaf pos is in the tree of the
    first `length` leaves, for each distinct pair that there are leaves for.

    A sibling before its level's last node is a complete node; the last node is the prefix's own. The complete nodes beside a leaf up to LEVELS are in its
    aligned run of leaves, so one task makes them for all that is asked of a run; those above are the same for the whole run.
    """
    leaves = staged(leaves.select("pos", "leaf"), "leaves")
    nodes = complete_nodes(leaves, tree)
    run = F.shiftright("pos", LEVELS).alias("run")
    wanted = staged(asked.select(F.col("length").cast("long").alias("length"), F.col("pos").cast("long").alias("pos")).where("pos >= 0 and pos < length").distinct(), "asked")
    spines = staged(_spines(nodes, wanted.select("length"), tree), "spines")
    levels = LEVELS  # as of now, for the tasks

    def beside(own: pa.Table, some: pa.Table) -> pa.Table:
        own, pos = own.sort_by("pos"), some["pos"].to_numpy()
        now, parts = own["leaf"].to_pylist() if len(pos) else [], []
        first = own["pos"][0].as_py() if now else 0
        taken = lambda at: pa.array(now, pa.binary()).take(pa.array(at, pa.int64(), mask=at >= len(now)))
        leaf = taken(pos - first)
        for level in range(levels):
            parts.append(taken((pos >> level ^ 1) - (first >> level)))
            now = tree.up(now[: len(now) // 2 * 2]) if len(now) > 1 else []
        order = np.arange(levels * len(pos)).reshape(levels, -1).T.ravel()
        near = pa.ListArray.from_arrays(np.arange(0, len(order) + 1, levels, dtype=np.int32), pa.concat_arrays(parts).take(pa.array(order, pa.int64())))
        return pa.table({"length": some["length"], "pos": some["pos"], "leaf": leaf, "near": near})

    # what is asked of one run, by many lengths, is dealt in slices of about SLICE rows
    slices = staged(wanted.groupBy(run).agg(F.ceil(F.count("*") / SLICE).alias("slices")), "slices")
    held = leaves.select("pos", "leaf", run).join(slices, "run").select("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "pos", "leaf")
    some = wanted.select("length", "pos", run).join(slices, "run").select("run", F.pmod(F.xxhash64("length", "pos"), "slices").alias("slice"), "length", "pos")
    low = held.groupBy("run", "slice").cogroup(some.groupBy("run", "slice")).applyInArrow(beside, "length long, pos long, leaf binary, near array<binary>")

    above = slices.select("run", F.explode(F.sequence(F.lit(levels), F.lit(62))).alias("level")).withColumn("pos", F.expr(f"shiftright(run, level - {levels})").bitwiseXOR(F.lit(1).cast("long")))
    high = above.join(nodes.where(F.col("level") >= levels), ["level", "pos"]).groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("level", "node"))).alias("far"))
    odd = "true" if tree.duplicate else "(shiftright(pos, level) ^ 1) = shiftright(length - 1, level)"
    inner = f"named_struct('level', level, 'on_left', shiftright(pos, level) % 2 = 1, 'node', if(level < {levels}, near[level], far[level]))"
    steps = f"transform(slice(spine, 1, size(spine) - 1), (last, level) -> case when (shiftright(pos, level) ^ 1) < shiftright(length - 1, level) then {inner} when {odd} then named_struct('level', level, 'on_left', false, 'node', last) end)"
    met = low.join(spines, "length").withColumn("run", run).join(high, "run", "left")
    return met.select("length", "pos", "leaf", F.filter(F.expr(steps), lambda s: s.isNotNull()).alias("siblings"), F.lower(F.hex(F.element_at("spine", -1))).alias("root"))


def proven(leaf: Column, siblings: Column, root_: Column, tree: Tree = POSITIONAL) -> Column:
    """Whether the siblings lead from a leaf to the root in hex."""
    if tree.hash == "sha256":

        def up(node: Column, s: Column) -> Column:
            pair = F.concat(F.least(node, s["node"]), F.greatest(node, s["node"])) if tree.sort_pairs else F.when(s["on_left"], F.concat(s["node"], node)).otherwise(F.concat(node, s["node"]))
            return F.unhex(F.sha2(pair, 256))

        return F.aggregate(siblings, leaf, up) == F.unhex(root_)

    @F.pandas_udf("boolean")
    def run(leaf: pd.Series, siblings: pd.Series, root_: pd.Series) -> pd.Series:
        return pd.Series([proves(bytes(x), [(s["on_left"], bytes(s["node"])) for s in b], bytes.fromhex(r), tree) for x, b, r in zip(leaf, siblings, root_)])

    return run(leaf, siblings, root_)


def proof(nodes: list[bytes], pos: int, tree: Tree = POSITIONAL) -> list[tuple[bool, bytes]]:
    """Siblings of a leaf on the way up, each with whether it stands on the left."""
    out = []
    while len(nodes) > 1:
        other = pos ^ 1
        if other < len(nodes):
            out.append((other < pos, nodes[other]))
        elif tree.duplicate:
            out.append((False, nodes[pos]))
        nodes, pos = tree.up(nodes), pos // 2
    return out


def proves(leaf: bytes, siblings: list[tuple[bool, bytes]], root_: bytes, tree: Tree = POSITIONAL) -> bool:
    for left, other in siblings:
        leaf = tree.up([other, leaf] if left else [leaf, other])[0]
    return leaf == root_
