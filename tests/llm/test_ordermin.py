"""Order MinHash against a plain version, over pieces, and its query row by row."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tallychain.llm import ordermin

SCHEMA = "doc_id long, text string, print string, span long, last int"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*longs):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def plain_numbers(text):
    raw = (text or "").encode()
    if not raw:
        return []
    seen, kmers = defaultdict(int), []
    for i in range(max(1, len(raw) - ordermin.K + 1)):
        h = signed((xxhash.xxh64_intdigest(raw[i : i + ordermin.K], 42) << 16) & (1 << 64) - 1) >> 16
        seen[h] += 1
        kmers.append((h, seen[h], i))
    buckets = defaultdict(list)
    for h, nth, i in sorted(kmers):
        if len(buckets[h >> 42]) < 2:
            buckets[h >> 42].append((i, h))
    return [signed(xx(*[h for _, h in sorted(buckets[b])]) & ~63 & (1 << 64) - 1 | b & 63) for b in sorted(buckets)]


def plain_likeness(a, b):
    either = {x & 63 for x in a} | {x & 63 for x in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(plain_numbers, (t, edited, after))
        text = lambda f: "".join(f"{x & (1 << 64) - 1:016x}" for x in f)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=str)


def made_texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    texts = ["", None, "a", "elevenchars", "twelve chars", "thirteen char", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "😀é" * 30, "ab " * 900]
    return texts + [" ".join(word() for _ in range(n)) for n in (3, 20, 90, 400, 1500, 6000, 20000)]


@pytest.mark.parametrize("piece", [None, 700])
def test_numbers(spark, monkeypatch, piece):
    if piece:
        monkeypatch.setattr(ordermin, "PIECE", piece)
    texts = made_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    found = {r.i: r.f for r in df.select("i", ordermin.fingerprint(F.col("text")).alias("f")).collect()}
    assert found == {i: plain_numbers(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("span", [1, 512])
def test_query(spark, monkeypatch, span):
    monkeypatch.setattr(ordermin, "SPAN", span)
    texts = made_texts()
    rows = [(i * i - 7, t) for i, t in enumerate(texts)] + [(1 << 61, "far away " * 9), (2, "an id again"), (2, "an id again"), (2, "and again"), (None, "no id"), (None, "no id, either")]
    df = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in rows], SCHEMA).repartition(3)
    found = ordermin.fingerprints(df)
    assert [f"{n} {t}" for n, t in found.dtypes] == ["doc_id bigint", "n_chars bigint", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)


def test_shuffled_parts_are_less_alike_than_their_words(spark):
    r = random.Random(1)
    parts = [" ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(12)) for _ in range(40)]
    other = parts[:]
    r.shuffle(other)
    a, b, c = (plain_numbers(x) for x in (" ".join(parts), " ".join(other), " ".join(parts).replace("a", "b", 3)))
    assert plain_likeness(a, b) < 0.6 < 0.7 < plain_likeness(a, c)


def test_empty_and_single(spark):
    assert ordermin.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    one = ordermin.fingerprints(spark.createDataFrame([(3, "a lonely text, followed by itself", "x", 1, 0)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_no_python(spark):
    plan = ordermin.fingerprints(spark.createDataFrame([(3, "text", "x", 1, 0)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
