"""Language identification by the nearest of several centroids per language, with rejection by distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallychain.llm.common import bounded_batches

#: Hashed n-grams of 1 to 3 characters share so many dimensions.
DIMS, ORDERS = 4096, (1, 2, 3)
#: Characters whose n-grams are counted at once.
CHUNK = 1 << 18


def crc_class(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of the lower-cased text occurs. Runs of what is neither a to z nor from U+00AA on (but for the signs × and ÷)
    are one space, and one goes before and after a text; what comes later counts as letters, marks and signs alike."""
    total = np.zeros(DIMS, np.float64)
    text = text.lower()
    held = np.zeros(0, np.uint64)  # the end of what is counted, for n-grams over a cut
    for at in range(0, len(text), CHUNK):
        x = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        letter = (x >= 97) & (x <= 122) | (x >= 0xAA) & (x != 0xD7) & (x != 0xF7)
        x = np.where(letter, x, 32)
        before = np.concatenate((held[-1:] if at else [0], x[:-1]))
        x = x[(x != 32) | (before != 32)]
        new = np.concatenate(([32] if not at else [], x, [32] if at + CHUNK >= len(text) else [])).astype(np.uint64)
        x = np.concatenate((held, new))
        h = np.zeros(len(x), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            n = len(x) - order + 1
            if n <= 0:
                break
            h = (h[:n] * np.uint64(0x9E3779B1) + x[order - 1 :]) & np.uint64(0xFFFFFFFF)
            if order in ORDERS:
                mixed = (h * np.uint64(0x85EBCA6B) + np.uint64(order)) & np.uint64(0xFFFFFFFF)
                seen = max(0, len(held) - order + 1)  # those that end in what is held were counted with it
                total += np.bincount((mixed[seen:] >> np.uint64(20)).astype(np.int64), minlength=DIMS)[:DIMS]
        held = x[-(max(ORDERS) - 1) :]
    return total


@dataclass
class Model:
    """languages: one per centroid; reject: the least cosine of each centroid's language that is not rejected."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    reject: np.ndarray

    def vector(self, tf: np.ndarray) -> np.ndarray:
        v = np.log1p(tf) * self.idf
        return v / (np.linalg.norm(v) or 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine with its nearest centroid, whether it is near enough); `und` for a text without a letter."""
        if not len(self.centroids) or not has_letter(text):
            return "und", 0.0, False
        cosines = self.centroids @ self.vector(counts(text))
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, bool(score >= self.reject[best])


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centroids of unit vectors: spherical k-means, started from vectors far from those chosen before."""
    chosen = [int(np.argmax(vectors @ vectors.mean(0)))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centers = vectors[chosen]
    for _ in range(rounds):
        own = np.argmax(vectors @ centers.T, axis=1)
        sums = np.stack([vectors[own == c].sum(0) if (own == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def fit(docs: DataFrame, per_language: int = 400, clusters: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a sample of about per_language documents of each language, chosen by a hash of the id; that bounds what the
    driver gets. Whole texts are counted, on the executors. Only documents with a language whose id's class is not 2 are learned from."""
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (crc_class("doc_id") != 2))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, DIMS)), np.ones(DIMS), np.zeros(0))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sizes.items()], F.lit(0.0))
    # 53 bits, as many as a double tells apart, so that the sample stays as small however many documents a language has
    chosen = known.where(F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "doc_id"), 11) < share * float(1 << 53))

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([counts(t).astype(np.float32).tobytes() if has_letter(t) else None for t in texts])

    # rows that repeat an id and a language count as one
    found = chosen.select("doc_id", "lang", packed("text").alias("tf"))
    # nulls go after the grouping: before it, the test would pack each text once more
    rows = found.groupBy("doc_id", "lang").agg(F.min("tf").alias("tf")).where("tf is not null").collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.tf))
    if not rows:
        return Model([], np.zeros((0, DIMS)), np.ones(DIMS), np.zeros(0))
    tf = np.stack([np.frombuffer(r.tf, np.float32) for r in rows])
    model = Model([], np.zeros((0, DIMS)), (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32), np.zeros(0))
    vectors = np.log1p(tf) * model.idf
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    lang = np.array([r.lang for r in rows])
    centers, reject = [], []
    for k in sorted(sizes):
        own = vectors[lang == k]
        if len(own):
            made = cluster(own, clusters)
            centers.append(made)
            # half of what the furthest documents of the sample have is still near enough
            reject += [0.5 * float(np.quantile((own @ made.T).max(1), 0.005))] * len(made)
            model.languages += [k] * len(made)
    model.centroids, model.reject = np.concatenate(centers).astype(np.float32), np.array(reject)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for each row of docs, from its whole text alone.

    A null text and one without a letter are `und` with score 0 and not accepted; so are all texts if nothing was learned. A null id is
    not held out. Repeated rows get repeated results; further columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    made = docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col)).alias("p"))
    return made.select("doc_id", F.coalesce(crc_class() == 2, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score", "p.accepted")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is rejected; columns as before."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def near(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.predict(t)[2] for t in texts], dtype=bool)

    return docs.where(near(F.col(text_col)))


