"""The pipeline's dedup stage against brute force over all pairs."""

import random
from itertools import combinations

import corpus_pipeline
from tallychain.llm import near, simhash

SCHEMA = "doc_id long, text string, source string"


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def made_texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    line = [word() for _ in range(9)]
    texts = [None, "", " \t", "one two", "One  two", "one two three"]
    for n in (6, 9, 30, 60, 120, 400, 90, 150, 250, 70):
        base = [word() for _ in range(n)] + line
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5, 8):  # both sides of 0.8
            near = list(base)
            for i in r.sample(range(len(near)), min(edits, len(near))):
                near[i] = word()
            texts.append(" ".join(near))
        now = base
        for _ in range(4):  # each like the one before, the last unlike the first
            now = now[max(1, len(now) // 16) :] + [word() for _ in range(max(1, len(now) // 16))]
            texts.append(" ".join(now))
    return texts


def test_dedup_stage_equals_brute_force(spark):
    texts = made_texts()
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    similar = 0
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
            similar += sets[i] != sets[j]
            a, b = sorted((top(i), top(j)))
            root[b] = a
    assert similar > 20
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s")], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if root[i] == i]


def test_simhash_proposes_ties_of_the_dedup_stage(spark, monkeypatch):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    fps, proposed, real = [simhash.fingerprint(t, 5) for t in texts], [], near.hashed_ties
    of_set = {near.xxhash.xxh64_intdigest(near.shingles(t).tobytes(), near.SEED): t for t in texts}

    def seen(sets):
        assert sorted(r.fp % (1 << 64) for r in sets.select("fp").distinct().collect()) == sorted(set(fps))
        ties = real(sets)
        proposed.extend((of_set[r.u % (1 << 64)], of_set[r.v % (1 << 64)]) for r in ties.collect())
        return ties

    monkeypatch.setattr(near, "hashed_ties", seen)
    near.keep_one(docs).collect()
    reach = {f: {f} for f in fps}
    for f, g in combinations(set(fps), 2):
        if bin(f ^ g).count("1") <= near.BITS:
            reach[f] |= reach[g]
            for h in reach[f]:
                reach[h] = reach[f]
    assert len(proposed) > 5
    assert all(simhash.fingerprint(a, 5) in reach[simhash.fingerprint(b, 5)] for a, b in proposed)
