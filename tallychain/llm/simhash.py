"""Near-duplicate groups by SimHash fingerprints, linked by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallychain.llm.common import bounded_batches, salt, salted, staged
from tallychain.llm.components import components

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def shingle_hashes(text: str | None, width: int = 4, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each of a text's shingles in order, repeats included; all words in one where there are fewer than width, none without a word."""
    words = (text or "").encode().lower().split()  # bytes: lower() is A-Z only, split() is 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    first = np.concatenate(([0], ends[:-1] + 1))[: len(last)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(first.tolist(), last.tolist())], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes; none: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        some = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in range(64) if 2 * int(ones[b]) > len(hashes))


def fingerprint(text: str | None, width: int = 4, seed: int = SEED) -> int:
    """The fingerprint of a text's shingles; no word: 0."""
    return fingerprint_of(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp: the fingerprint's 64 bits as a long) for each row of docs; a null text has no word and gets 0."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def least_errors(blocks: int, take: int, distance: int) -> int:
    """The most errors that the `take` best of `blocks` blocks can have if all blocks have `distance` in sum."""
    each, rest = divmod(distance, blocks)
    return take * each + max(0, take - (blocks - rest))


def segments(rows: int, distance: int) -> tuple[list[int], int]:
    """Bit masks of the index's segments, and the radius of the balls to enumerate in each.

    Two fingerprints within `distance` agree, up to the radius, in at least one segment, whatever the choice; more rows only get wider
    segments, so that a table entry holds few fingerprints by chance.
    """
    for blocks, take in ((3, 1), (5, 2), (7, 4), (9, 6)):
        radius = least_errors(blocks, take, distance)
        if radius <= 1 and 64 * take / blocks + 3 >= np.log2(max(rows, 1)):
            break
    else:
        blocks, take, radius = distance + 2, 2, 0
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(parts[i] for i in pick) for pick in combinations(range(blocks), take)], radius


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _entries(fps: DataFrame, masks: list[int], *keep: str) -> DataFrame:
    """The index's tables: one row (t, key, fp) for each segment."""
    made = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    return fps.select("fp", *keep, F.inline(made))


def _probes(fps: DataFrame, masks: list[int], radius: int, *keep: str) -> DataFrame:
    """Each fingerprint's ball in each segment. Of two keys at distance 1, only the one with the 0 turns it into a 1 and finds the other."""

    def ball(t: int, m: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(_signed(m)))
        if not radius:
            return F.array(F.struct(F.lit(t).alias("t"), own.alias("key")))
        bits = F.array(*[F.lit(_signed(1 << b)).cast("long") for b in range(64) if m >> b & 1])
        grown = F.transform(F.filter(bits, lambda b: F.col("fp").bitwiseAND(b) == 0), lambda b: own.bitwiseOR(b))
        return F.transform(F.concat(F.array(own), grown), lambda k: F.struct(F.lit(t).alias("t"), k.alias("key")))

    return fps.select("fp", *keep, F.inline(F.concat(*[ball(t, m) for t, m in enumerate(masks)])))


def link_fingerprints(fps: DataFrame, distance: int = 4) -> DataFrame:
    """fps(fp, distinct longs) -> (fp, root): the least fingerprint that each reaches over steps of `distance` or fewer bits.

    First every table entry's members are tied to its least member where they are near enough, which is a star, not all pairs; then the
    full balls are looked up, and complete distances verified, for pairs that these ties have not joined yet. All members of a dense group
    so meet by few links, and no link between groups is lost.
    """
    fps = staged(fps.select("fp"), "fps")
    masks, radius = segments(fps.count(), distance)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance

    ties = _entries(fps, masks)
    hubs = ties.groupBy("t", "key").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = ties.join(hubs, ["t", "key"]).where((F.col("fp") != F.col("hub")) & near("fp", "hub"))
    first = components(stars.select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct(), "stars")
    known = staged(fps.join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "known")

    a = _probes(known, masks, radius, "root").select("t", "key", F.col("fp").alias("a"), F.col("root").alias("ra"))
    b = _entries(known, masks, "root").select(F.col("t").alias("t2"), F.col("key").alias("key2"), F.col("fp").alias("b"), F.col("root").alias("rb"))
    found = a.join(b, (F.col("t") == F.col("t2")) & (F.col("key") == F.col("key2")) & (F.col("ra") != F.col("rb")) & near("a", "b"))
    then = components(found.select(F.col("ra").alias("u"), F.col("rb").alias("v")).distinct(), "links").withColumnRenamed("root", "top")
    return known.join(then, F.col("root") == F.col("node"), "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: least doc_id reachable) for each row of docs.

    Only the id and the text are read, so further columns may have any names. Repeated rows give repeated rows. A null or wordless text
    has fingerprint zero and links like any other. Null ids link too, but name no group: a group of nulls only has a null component_id.
    """
    own = staged(fingerprints(docs, width, id_col, text_col), "fingerprints")
    return own.join(named(own.groupBy("fp").agg(F.min("doc_id").alias("least")), distance), "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), F.col("least").alias("component_id"))


def named(fps: DataFrame, distance: int) -> DataFrame:
    """fps(fp: distinct, least) -> (fp, least): the least of each fingerprint's whole group. Fingerprints that link to no other have theirs; the
    members of a group, which can be many, look up its least in salted parts."""
    fps = staged(fps, "least")
    linked = staged(link_fingerprints(fps, distance).join(fps, "fp"), "linked")
    groups = linked.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n").withColumnRenamed("root", "r")
    dealt = linked.withColumn("part", salt("fp"))
    return dealt.join(salted(groups), (F.col("root") == F.col("r")) & (F.col("part") == F.col("__salt")), "left").select("fp", F.when(F.col("r").isNull(), F.col("least")).otherwise(F.col("first")).alias("least"))


def keep_one(docs: DataFrame, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the least id, then the least hash of its text; null ids come last, but a
    group of nulls only keeps one too. Rows that repeat an id with different texts are different documents; of rows that repeat both, one stays."""
    rows = docs.withColumn("__tid", F.xxhash64(F.col(text_col)))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tid")
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64))

    own = staged(rows.select(F.col(id_col).alias("doc_id"), F.col("__tid").alias("tid"), fp(F.col(text_col)).alias("fp")), "fingerprints")
    kept = named(own.groupBy("fp").agg(F.min(order).alias("least")), distance).select("least.*").distinct()
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("tid").alias("__keep"))
    out = rows.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__tid") == F.col("__keep")), "left_semi")
    return out.dropDuplicates([id_col, "__tid"]).select(*docs.columns)
