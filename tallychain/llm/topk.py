"""Exact top-k inner products by sequential reads of sorted lists with score bounds (no random access)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallychain.llm.common import bounded_batches, staged

#: Rows and components of a block of candidates at most, blocks that a cell of the grid takes, and the least and most queries of a batch.
BLOCK_ROWS, BLOCK_CELLS, CELL_BLOCKS, BATCH_LEAST, BATCH_MOST = 4096, 4096 * 64, 4, 256, 8192
#: Queries whose bounds are held at once, and the shares of the lists after which bounds are taken.
AT_ONCE, SHARES = 256, (0.25, 0.5, 0.65, 0.8)
#: Below this, sums of whole numbers in doubles are exact; bounds of components from MOST on are taken of all of them divided by a power of two.
EXACT, MOST = 2.0**53, 2.0**56
#: Digits of the scores that a decimal holds.
DIGITS = 38
#: Components whose signs make a vector's direction.
SIGNS = 16


def quantized(rows: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v: array<double> of whole numbers), v = floor(scale * x), whatever their size. Null and empty vectors and those with null or
    non-finite components are left out, and those with a component whose product with scale is beyond all doubles (from about 7e305 on)."""
    x = F.col(vector_col).cast("array<double>")
    y = lambda c: c * F.lit(float(scale))
    good = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(F.abs(y(c)) < float("inf"), F.lit(False)))
    # a double from 2 ** 53 on is whole
    whole = F.transform(x, lambda c: F.when(F.abs(y(c)) < EXACT, F.floor(y(c)).cast("double")).otherwise(y(c)))
    return rows.where(good).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def ordered_text(x: int) -> str:
    """Digits whose order as texts is that of the numbers."""
    digits = str(abs(x))
    if x >= 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999_999 - len(digits):06d}" + digits.translate(NINES)


NINES = str.maketrans("0123456789", "9876543210")


def packed(vectors: list[np.ndarray]) -> tuple[int, str, bytes, np.ndarray]:
    """(dims, type, bytes, matrix) of whole-number vectors in the smallest integer type that holds them, shorter ones filled up with zeros."""
    dims = max(map(len, vectors))
    x = np.zeros((len(vectors), dims))
    for n, v in enumerate(vectors):
        x[n, : len(v)] = v
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8" if most < 1 << 53 else "<f8"
    return dims, kind, x.astype(kind).tobytes(), x


def blocks(vectors: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, ids, dims, kind, data, lists): vectors packed by as many rows in the order of each partition, each block with its sorted lists: for
    each dimension its rows in rising order of their component, made once and read by every batch of queries."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, wide = TaskContext.get().partitionId(), 0, 1
        ids: list[int] = []
        held: list[np.ndarray] = []

        def out() -> pd.DataFrame:
            nonlocal made
            dims, kind, data, x = packed(held)
            lists = np.argsort(x, axis=0, kind="stable").T.astype("<u2").tobytes()
            row = pd.DataFrame([((part << 32) + made, np.array(ids, "<i8").tobytes(), dims, kind, data, lists)], columns=["block", "ids", "dims", "kind", "data", "lists"])
            made += 1
            ids.clear()
            held.clear()
            return row

        for pdf in batches:
            for i, v in zip(pdf["vec_id"], pdf["v"]):
                ids.append(i)
                held.append(v)
                wide = max(wide, len(v))
                if len(ids) >= min(rows, max(1, BLOCK_CELLS // wide)):
                    yield out()
                    wide = 1
        if ids:
            yield out()

    return vectors.mapInPandas(pack, "block long, ids binary, dims int, kind string, data binary, lists binary")


class SortedLists:
    """A block's components as one sorted list per dimension, read for many queries at once.

    Reading goes down the lists from both ends: queries with a positive component take the upper end, those with a negative one the
    lower. What is read so far is kept as two matrices, with the bound of what is not read in the open places, so that a product with
    the queries' positive and negative parts gives the bounds of all scores.

    down: the power of two that data and queries are divided by in the lists and in all bounds, so that these stay finite; exact scores are of
    the whole numbers.
    """

    def __init__(self, data: np.ndarray, lists: np.ndarray | None = None, down: int = 0) -> None:
        self.whole, self.down = np.asarray(data, np.float64), down
        self.data = np.ldexp(self.whole, -down) if down else self.whole
        self.rows = np.argsort(self.data, axis=0, kind="stable").T if lists is None else lists.astype(np.intp)
        self.values = np.take_along_axis(self.data, self.rows.T, axis=0).T
        self.low, self.high = self.values[:, 0], self.values[:, -1]
        self.longest = float(np.sqrt((self.data**2).sum(1).max()))
        self.stages: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}

    def ceiling(self, q: np.ndarray) -> np.ndarray:
        """What no score of queries q (one a row) is above: by each list's ends, and by the longest row."""
        d = q.shape[1]
        by_ends = np.maximum(q, 0) @ self.high[:d] + np.minimum(q, 0) @ self.low[:d]
        return np.minimum(by_ends, np.sqrt((q**2).sum(1)) * self.longest) + self.slack(q)

    def size(self, q: np.ndarray) -> np.ndarray:
        """What the sum of a score's terms without their signs is at most."""
        return np.abs(q) @ np.maximum(np.abs(self.low), np.abs(self.high))[: q.shape[1]]

    def slack(self, q: np.ndarray) -> np.ndarray:
        """More than rounding can change a bound by."""
        return 1e-12 * q.shape[1] * self.size(q) + (1e-300 if self.down else 1e-6)

    def exact(self, q: np.ndarray) -> np.ndarray:
        """Whether all sums of a query's score stay exact in doubles."""
        return self.size(q) < math.ldexp(EXACT, -2 * self.down)

    def read(self, depth: int, best: bool) -> tuple[np.ndarray, np.ndarray]:
        """The lists read to a depth from the upper and from the lower end; open places hold the best or the worst that they can."""
        if (depth, best) not in self.stages:
            d, n = self.rows.shape
            dims = np.arange(d)[:, None]
            up = np.repeat((self.values[:, n - depth] if best else self.low)[:, None], n, axis=1)
            up[dims, self.rows[:, n - depth :]] = self.values[:, n - depth :]
            down = np.repeat((self.values[:, depth - 1] if best else self.high)[:, None], n, axis=1)
            down[dims, self.rows[:, :depth]] = self.values[:, :depth]
            self.stages[depth, best] = up, down
        return self.stages[depth, best]

    def qualify(self, q: np.ndarray, k: int, floors: np.ndarray, skip: np.ndarray) -> list[np.ndarray]:
        """For each query (a row of q) the rows, without those of its row of the mask `skip`, that may be among the k best of all that score at
        least its floor.

        After each share of the lists it bounds the scores. Rows whose upper bound is under both the floor and the k-th largest lower bound are
        outsiders for good. A query stops when few others are left, as resolving them is cheaper than reading on.
        """
        n, m = len(self.data), len(q)
        d = q.shape[1]
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        slack = self.slack(q)
        alive: list[np.ndarray] = [np.flatnonzero(~s) for s in skip]
        few = max(4 * k, n // 20)
        going = np.array([i for i in range(m) if len(alive[i]) > few], int)
        done = 0
        for share in SHARES:
            depth = max(done + 1, int(n * share))
            if depth >= n or not len(going):
                break
            done = depth
            up, down = self.read(depth, True)
            upper = plus[going] @ up[:d] + minus[going] @ down[:d]
            bar = floors[going]
            open_ = np.flatnonzero(np.isneginf(bar))
            if len(open_):  # nothing known from blocks before
                low_up, low_down = self.read(depth, False)
                lower = plus[going[open_]] @ low_up[:d] + minus[going[open_]] @ low_down[:d]
                lower[skip[going[open_]]] = -np.inf
                bar = bar.copy()
                bar[open_] = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else -np.inf
            keep = (upper >= (bar - slack[going])[:, None]) & ~skip[going]
            left = keep.sum(1)
            for at, i in enumerate(going):
                if left[at] <= few or share == SHARES[-1]:
                    alive[i] = np.flatnonzero(keep[at])
            going = going[left > few]
        return alive

    def scores(self, q: np.ndarray, rows: np.ndarray, exact: bool) -> list[int] | np.ndarray:
        """Exact scores of a query of whole numbers: in doubles where all sums stay exact, else as Python integers."""
        x = self.whole[rows, : len(q)]
        if exact:
            return x @ q
        whole = [int(c) for c in q]
        return [sum(a * int(b) for a, b in zip(whole, row)) for row in x.tolist()]

    def best(self, q: np.ndarray, k: int, floor: float, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that qualify for one query, with their exact scores."""
        q = np.asarray(q, np.float64)
        rows = self.qualify(q[None], k, np.array([floor]), skip[None])[0]
        return rows, np.array(self.scores(q, rows, bool(self.exact(q[None])[0])), object).astype(np.int64)


class Batch:
    """A batch of queries with the k best rows found so far for each."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, down: int = 0) -> None:
        self.ids, self.whole, self.k, self.unit = ids, q, k, 1 << 2 * down
        self.q = np.ldexp(q, -down) if down else q
        self.found: list[list[tuple]] = [[] for _ in ids]  # (-score, id), best first
        self.floors = np.full(len(ids), -np.inf)

    def search(self, ids: np.ndarray, lists: SortedLists) -> None:
        d = min(self.q.shape[1], lists.data.shape[1])  # a shorter vector has zeros in the other places
        q = self.q[:, :d]
        ceiling, exact = lists.ceiling(q), lists.exact(q)
        ahead = np.flatnonzero(ceiling >= self.floors)
        ahead = ahead[np.argsort(-ceiling[ahead], kind="stable")]
        for at in range(0, len(ahead), AT_ONCE):
            some = ahead[at : at + AT_ONCE]
            skip = ids[None, :] == self.ids[some, None]
            for i, rows in zip(some, lists.qualify(q[some], self.k, self.floors[some], skip)):
                scores = lists.scores(self.whole[i, :d], rows, exact[i])
                if len(rows) > 8 * self.k:  # all that can be among the k best, ties with the last included
                    order = np.array([int(s) / self.unit for s in scores]) if self.unit > 1 else np.array(scores, np.float64)
                    near = order >= np.partition(order, len(order) - self.k)[len(order) - self.k] - 1e-9 * np.abs(order).max()
                    rows, scores = rows[near], [s for s, x in zip(scores, near) if x]
                self.found[i] = sorted([*self.found[i], *((-int(s), int(c)) for s, c in zip(scores, ids[rows]))])[: self.k]
                if len(self.found[i]) >= self.k:
                    self.floors[i] = -self.found[i][-1][0] / self.unit

    def rows(self) -> pd.DataFrame:
        out = [(int(q), c, ordered_text(-s), str(-s)) for q, best in zip(self.ids, self.found) for s, c in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "by", "digits"])


def top_k(rows: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score: decimal(38, 0), digits): each query's k best rows by integer inner product, ties to the smaller vec_id. digits is
    the score as text, of any length; score is null where it has more than 38.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those of the query's own id. A shorter vector counts as zero in
    the places it lacks. All scores are exact, of any size. Rows that repeat an id as a candidate are each ranked; a query id that repeats
    is answered once, for its first row in order of its components. Null and empty vectors, and vectors with null or non-finite components,
    take no part; an empty table gives an empty table.

    Batches of queries and slices of candidate blocks make a grid; a cell takes one batch and few blocks, whatever the sizes of both, one block in
    memory at a time. Candidates of like direction share a block. The worst of the k rows that a query has is the floor for the blocks
    that follow, and a block whose ends are under it is not read. The cells' rows meet in one window per query.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    vectors = quantized(rows, scale, id_col, vector_col)
    sign = F.aggregate(F.slice("v", 1, SIGNS), F.lit(0), lambda a, c: a * 2 + (c >= 0).cast("int"))
    most = vectors.select(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    down = math.frexp(most)[1] if most >= MOST else 0
    candidates = staged(blocks(vectors.withColumn("sign", sign).repartitionByRange("sign", "vec_id").sortWithinPartitions("sign", "vec_id").select("vec_id", "v")), "candidates")
    first = Window.partitionBy("vec_id").orderBy("v")
    asked = vectors.where(F.col("vec_id") % every == 0).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    asked = staged(asked.select("vec_id", "v"), "queries")

    n_queries, n_blocks = asked.count(), candidates.count()
    size = min(BATCH_MOST, max(BATCH_LEAST, math.ceil(n_queries / 8)))
    batches, slices = max(1, math.ceil(n_queries / size)), max(1, math.ceil(n_blocks / CELL_BLOCKS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = asked.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(batches)).cast("int")).groupBy("batch").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    absent = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "binary"), ("dims", "int"), ("kind", "string"), ("data", "binary"), ("lists", "binary"))]
    ask = own.select("batch", each(slices).alias("slice"), F.lit(-1).cast("long").alias("block"), "queries", *absent)
    dealt = F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice")
    none = F.lit(None).cast(own.schema["queries"].dataType).alias("queries")
    offer = candidates.select(each(batches).alias("batch"), dealt, "block", none, "ids", "dims", "kind", "data", "lists")
    cells = ask.union(offer).repartition(batches * slices, "batch", "slice").sortWithinPartitions("batch", "slice", "block")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cell = None, None
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if (r.batch, r.slice) != cell:
                    if now is not None:
                        yield now.rows()
                    now, cell = None, (r.batch, r.slice)
                if r.block < 0:
                    ids = np.array([x["vec_id"] for x in r.queries], np.int64)
                    now = Batch(ids, packed([np.asarray(x["v"], np.float64) for x in r.queries])[3], k, down)
                elif now is not None:
                    ids = np.frombuffer(r.ids, "<i8")
                    data = np.frombuffer(r.data, r.kind).reshape(len(ids), int(r.dims))
                    now.search(ids, SortedLists(data, np.frombuffer(r.lists, "<u2").reshape(int(r.dims), len(ids)), down))
        if now is not None:
            yield now.rows()

    found = cells.mapInPandas(search, "query_id long, vec_id long, by string, digits string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("by"), "vec_id"))
    score = F.when(F.length("digits") <= DIGITS, F.col("digits").try_cast(f"decimal({DIGITS},0)"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"), "digits")


def as_long(score: Column, digits: Column) -> Column:
    """A score as a long; one beyond all longs is the nearest of them."""
    far = F.when(digits.startswith("-"), F.lit(-(1 << 63)).cast("long")).otherwise(F.lit((1 << 63) - 1).cast("long"))
    return F.coalesce(score.try_cast("long"), far)


TOP_K_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
long as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as d from v),
scores as (
  select q.vec_id as query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
  from long q join long c on q.d = c.d and q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0 group by 1, 2),
ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scores)
select * from ranked where rank <= 5
"""
