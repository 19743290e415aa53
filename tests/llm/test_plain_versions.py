"""Language, quality and sharding against plain versions, and odd inputs of all ten operators."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallychain.llm import html, langid, media, mixing, near, pieces, quality, sharding, simhash, tokens, topk

WORDS = {"aa": "the and with from this that have".split(), "bb": "der und mit von nicht auch haben".split(), "cc": "où été même être àâ".split()}


def plain_counts(text):
    """n-grams of the spaced text, hashed one by one."""
    out, codes = np.zeros(langid.DIMS), [32]
    inner = []
    for c in map(ord, text.lower()):
        c = c if 97 <= c <= 122 or c >= 0xAA and c not in (0xD7, 0xF7) else 32
        if c != 32 or not inner or inner[-1] != 32:
            inner.append(c)
    codes += inner + [32]
    for order in langid.ORDERS:
        for i in range(len(codes) - order + 1):
            h = 0
            for c in codes[i : i + order]:
                h = (h * 0x9E3779B1 + c) & 0xFFFFFFFF
            out[((h * 0x85EBCA6B + order) & 0xFFFFFFFF) >> 20] += 1
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 18])
def test_ngrams_over_cuts(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    for text in ["a", "ab", "Two words", "  ", " x ", "été — 12 × où", "".join(random.Random(1).choice("ab é1-") for _ in range(200))]:
        assert np.array_equal(langid.counts(text), plain_counts(text)), text


@pytest.fixture(scope="module")
def spoken(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(WORDS[k]) for _ in range(30)), k, i % 2) for i in range(240) for k in [list(WORDS)[i % 3]]]
    rows += [rows[0]] * 3 + [(900, None, "aa", 0), (901, "12 !", "bb", 1), (902, "", None, 0), (None, "der und mit", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_language_equals_a_plain_version(spoken):
    model = langid.fit(spoken)
    for r in langid.identify(spoken, model).join(spoken.select("doc_id", "text").distinct(), "doc_id").collect():
        if not (r.text and any(c.isalpha() for c in r.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = np.log1p(plain_counts(r.text)) * model.idf
        cosines = [float(np.dot(v, c) / np.linalg.norm(v)) for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert r.lang_pred == model.languages[best] and abs(r.score - cosines[best]) < 1e-5


def test_repeated_ids_are_learned_from_once(spark, spoken):
    again = spoken.union(spark.range(2000).select(F.lit(0).cast("long"), F.lit("der und"), F.lit("aa"), F.lit(0)))
    a = langid.fit(spoken)
    assert np.allclose(langid.fit(spoken.union(spoken)).centroids, a.centroids)
    assert len(langid.fit(again).centroids) >= len(WORDS)


def test_quality_equals_a_plain_network(spark):
    net = quality.Network(3)
    r = random.Random(1)
    texts = ["", None, "short", "".join(r.choice("ab é$.") for _ in range(700))]
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for text, score in zip(texts, net.scores(texts)):
        data = (text or "").encode()
        best = np.full(quality.HIDDEN, -np.inf)
        for start in range(0, max(1, len(data) - quality.CHUNK + quality.HOP), quality.HOP) if len(data) > quality.CHUNK else [0]:
            chunk = data[start : start + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            pooled = np.full(quality.FILTERS, -np.inf)
            for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                window = np.concatenate([p["embed"][b] for b in chunk[at : at + quality.WIDTH]])
                pooled = np.maximum(pooled, window @ p["conv"])
            hidden = np.maximum(0, np.maximum(0, pooled + p["conv_b"]) @ p["hidden"] + p["hidden_b"])
            best = np.maximum(best, hidden)
        assert abs(score - 1 / (1 + np.exp(-(best @ p["out"] + p["out_b"])[0]))) < 1e-4


def test_quality_odd_labels_and_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 9, "x") for i in range(40)] + [(1, "text", "y")] * 50 + [(None, None, None)], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (4, None), (None, 1), (5, 7)], "doc_id long, quality int")
    net = quality.fit(docs, labels, steps=3)
    found = quality.score(docs, net).collect()
    assert len(found) == docs.count() and all(0 <= x.score <= 1 for x in found)
    assert quality.kept(docs, net).columns == docs.columns
    assert quality.fit(docs, labels.where("doc_id = 3"), steps=3).p["embed"].shape == net.p["embed"].shape
    assert np.array_equal(quality.fit(docs, labels, steps=3).p["conv"], net.p["conv"])
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0


def plain_differencing(sizes, shards):
    """Largest spread first, largest sum against smallest."""
    parts = [sorted([n] + [0] * (shards - 1), reverse=True) for n in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return sorted(parts[0])


def test_shard_sums_equal_plain_differencing(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(300))) for _ in range(200)]
    texts += texts[:40] + [None, "", "é"] + [texts[3]] * 30
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    sums = Counter()
    for x in sharding.shard(docs, 5).collect():
        assert x.text_crc32 == zlib.crc32((texts[x.doc_id] or "").encode())
        sums[x.shard] += x.size
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    assert sorted(sums[i] for i in range(5)) == plain_differencing(groups.values(), 5)


def test_keep_one_loses_no_document(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"term{i}" for i in range(60))
    rows = [(None, text, 1), (None, text, 2), (1, other, 3), (1, text + " more", 4), (1, other, 5), (2, " ".join(f"last{i}" for i in range(50)), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, least int")
    kept = simhash.keep_one(docs)
    texts = [x.text for x in kept.collect()]
    assert kept.columns == docs.columns and len(texts) == len(set(texts)) and {other, rows[5][1]} < set(texts) and len(texts) in (3, 4)


def test_media_features_and_stored_bytes(spark):
    docs = spark.createDataFrame([(0, "abc"), (1, None), (2, "é" * 100)], "doc_id long, text string")
    texts = ["abc", "", "é" * 100]
    for x in media.text_media(docs).collect():
        data = texts[x.doc_id].encode()
        data += bytes(-len(data) % 64 if data else 64)
        stored = media.store(texts[x.doc_id])
        assert x.media_sha256 == hashlib.sha256(stored).hexdigest() and stored.endswith(data)
        mean, n = sum(data) / len(data), len(data)
        cross = sum((a * n >= sum(data)) != (b * n >= sum(data)) for a, b in zip(data, data[1:]))
        assert x.feature == f"n={n};mean={int(1000 * mean)};ms={1000 * sum(b * b for b in data) // n};cross={cross};max={max(data)}"


def pngs():
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_formats_and_cut_media():
    png = pngs()
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data\xff\x00x\xff\xd9"
    wav = media.store("text")
    for whole, kind in ((png, "image/png"), (jpeg, "image/jpeg"), (wav, "audio/x-wav")):
        assert media.sniff(b"..." + whole + b"...") == [(3, len(whole), kind)]
        assert all(not media.sniff(whole[:n]) for n in range(len(whole) - 1))
    assert media.sniff(png[:-5] + b"x" + png[-4:]) == []


@pytest.mark.parametrize("run, n", [
    (lambda d: langid.identify(d, langid.fit(d)), 5), (lambda d: mixing.mix(d), 5), (lambda d: sharding.shard(d), 5), (lambda d: near.keep_one(d), 3), (lambda d: simhash.keep_one(d), 3), (lambda d: tokens.token_counts(d), 5), (lambda d: pieces.encode_documents(d), 5),
], ids=["language", "mixing", "sharding", "near", "simhash", "tokens", "pieces"])
def test_nulls_in_every_column(spark, run, n):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert run(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, "some words here", "en", "s", 3), (1, "some words here", "en", "s", 3), (None, "x", None, None, None)], schema)
    assert run(docs).count() == n


def test_top_k_and_pages_of_empty_tables(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
