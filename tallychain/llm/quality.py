"""Document quality by a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.llm.common import bounded_batches
from tallychain.llm.langid import crc_class

#: Bytes of a chunk and from one chunk's start to the next; a filter's bytes and stride; sizes of the layers.
CHUNK, HOP, WIDTH, STRIDE = 256, 192, 8, 2
EMBED, FILTERS, HIDDEN = 8, 32, 24
#: Learn from so many documents of either label at most, and from so many chunks of each, spread evenly over it, in so many steps.
PER_LABEL, SAMPLE_CHUNKS, STEPS = 2000, 8, 1600
#: Chunks that are convolved at once.
AT_ONCE = 512
ACCEPT = 0.7
#: What losing a good document costs against keeping a bad one.
GOOD_WEIGHT = 2


def chunks(text: str | None) -> np.ndarray:
    """(n, CHUNK) bytes: overlapping chunks that cover the whole text, the last one filled up with zeros; at least one."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, -(-max(0, len(data) - CHUNK) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


class Network:
    """Embedding of bytes, convolution, rectifier, maximum over a chunk; a hidden layer per chunk, maximum over the document, logistic."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        init = lambda *shape, n: (r.standard_normal(shape) * np.sqrt(2 / n)).astype(np.float32)
        self.p = {
            "embed": init(256, EMBED, n=4), "conv": init(WIDTH * EMBED, FILTERS, n=WIDTH * EMBED), "conv_b": np.zeros(FILTERS, np.float32),
            "hidden": init(FILTERS, HIDDEN, n=FILTERS), "hidden_b": np.zeros(HIDDEN, np.float32), "out": init(HIDDEN, n=HIDDEN), "out_b": np.zeros(1, np.float32),
        }

    def _windows(self, x: np.ndarray) -> np.ndarray:
        """(chunks, positions, WIDTH * EMBED) of byte chunks."""
        e = self.p["embed"][x].reshape(len(x), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filters' maxima over each chunk's positions, where they are, and the windows."""
        w = np.ascontiguousarray(self._windows(x))
        z = w.reshape(-1, WIDTH * EMBED) @ self.p["conv"]
        z = z.reshape(len(x), -1, FILTERS)
        at = z.argmax(axis=1)
        return np.maximum(0, np.take_along_axis(z, at[:, None], axis=1)[:, 0] + self.p["conv_b"]), at, w

    def hidden(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(0, pooled @ self.p["hidden"] + self.p["hidden_b"])

    def features(self, x: np.ndarray) -> np.ndarray:
        """Hidden values of each chunk."""
        out = []
        for at in range(0, len(x), AT_ONCE):
            w = np.ascontiguousarray(self._windows(x[at : at + AT_ONCE])).reshape(-1, WIDTH * EMBED)
            z = (w @ self.p["conv"]).reshape(-1, (CHUNK - WIDTH) // STRIDE + 1, FILTERS).max(axis=1)
            out.append(self.hidden(np.maximum(0, z + self.p["conv_b"])))
        return np.concatenate(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each text, from all its chunks. A text's chunks are convolved by themselves, AT_ONCE at most together, and no
        sum goes over two texts, so a text has the same score in whatever company."""
        best = np.array([self.features(chunks(text)).max(axis=0) for text in texts], np.float32).reshape(len(texts), HIDDEN)
        z = (best.astype(np.float64) * self.p["out"]).sum(axis=1) + self.p["out_b"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def train(self, docs: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, batch: int = 32, rate: float = 3e-3, seed: int = 11) -> None:
        """Adam on the logistic loss, with a rate that falls to a fiftieth; docs holds each document's sampled chunks."""
        r, order = np.random.default_rng(seed), np.zeros(0, int)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            while len(order) < batch:
                order = np.concatenate((order, r.permutation(len(docs))))
            some, order = order[:batch], order[batch:]
            lr = rate * 0.02 ** (step / steps)
            for k, g in self._gradients([docs[i] for i in some], labels[some]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        x = np.concatenate(docs)
        starts = np.cumsum([0, *map(len, docs)])
        pooled, at, w = self.pooled(x)
        h = self.hidden(pooled)
        pick = np.stack([a + h[a:b].argmax(axis=0) for a, b in zip(starts, starts[1:])])
        units = np.arange(HIDDEN)
        top = h[pick, units]
        z = top @ self.p["out"] + self.p["out_b"]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, GOOD_WEIGHT, 1) / len(y)).astype(np.float32)
        dh = np.zeros_like(h)
        np.add.at(dh, (pick, units), dz[:, None] * self.p["out"])
        dh *= h > 0
        dp = (dh @ self.p["hidden"].T) * (pooled > 0)
        rows = np.flatnonzero(dp.any(axis=1))
        # only the window of each filter's maximum takes part
        flat = w[rows[:, None], at[rows]]  # (rows, FILTERS, WIDTH * EMBED)
        d = dp[rows]
        dconv = np.einsum("rfe,rf->ef", flat, d)
        dembed = np.zeros_like(self.p["embed"])
        if len(rows):
            place = at[rows][:, :, None] * STRIDE + np.arange(WIDTH)
            back = (d[:, :, None] * self.p["conv"].T[None]).reshape(len(rows), FILTERS, WIDTH, EMBED)
            np.add.at(dembed, x[rows[:, None, None], place], back)
        return {"embed": dembed, "conv": dconv, "conv_b": dp.sum(0), "hidden": pooled.T @ dh, "hidden_b": dh.sum(0), "out": top.T @ dz, "out_b": dz.sum(keepdims=True)}


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network learned from at most per_label documents of either label, those of the least hashed ids, so that the driver gets a
    bounded sample. Documents whose id's class is 2 are not learned from, nor those with both labels; rows that repeat an id count as one, by
    their least chunks. Without labels the network stays as it began."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (crc_class() != 2))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    mixed = F.md5(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")).cast("binary"))
    lots = [known.where(F.col("y") == y).orderBy(mixed, "doc_id").limit(per_label) for y in (0, 1)]
    sample = lots[0].union(lots[1])

    @F.pandas_udf("binary")
    def spread(texts: pd.Series) -> pd.Series:
        def some(t: str | None) -> bytes:
            c = chunks(t)
            return c[np.unique(np.linspace(0, len(c) - 1, SAMPLE_CHUNKS).round().astype(int))].tobytes()

        return pd.Series([some(t) for t in texts])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = own.join(F.broadcast(sample), "doc_id").select("doc_id", "y", spread("text").alias("chunks"))
    found = found.groupBy("doc_id", "y").agg(F.min("chunks").alias("chunks"))
    rows = sorted(found.collect(), key=lambda r: (r.doc_id, r.chunks))
    net = Network()
    if rows:
        net.train([np.frombuffer(r.chunks, np.uint8).reshape(-1, CHUNK) for r in rows], np.array([r.y for r in rows], np.float32), steps)
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, from all chunks of its text.

    A null or empty text is one chunk of zeros and has that chunk's score. A null id is not held out. Repeated rows get repeated results;
    further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(list(texts)), dtype="float64")

    made = docs.select(F.col(id_col).alias("doc_id"), probability(F.col(text_col)).alias("score"))
    return made.select("doc_id", F.coalesce(crc_class() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def kept(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs without the rows predicted to be of label 0; columns as before."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(list(texts)) >= ACCEPT)

    return docs.where(good(F.col(text_col)))
