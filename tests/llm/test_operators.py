"""Each corpus operator on small tables against a brute-force version, with nulls, empty texts, ties, repeated rows, extra columns and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallychain.llm import html, langid, media, mixing, pieces, quality, sharding, simhash, tokens, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, component_id string"
WORDS = [f"{a}{b}{c}" for a in "bdklm" for b in "aeiou" for c in "nrst"]


def made_texts():
    r = random.Random(5)
    base = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (60, 200, 1, 3, 4, 5, 80, 90, 2000)]
    near = [base[1].replace(base[1].split()[i], "xyz", 1) for i in (3, 50, 120)]
    odd = [None, "", " \t\n", "ÄÖ é x", "\x00\x01", "a▁b  c", "RIFF\x00WAVE", "😀" * 50, "A B C D", "a b c d"]
    return base + base[:3] + near + odd


@pytest.fixture(scope="module")
def docs(spark):
    texts = made_texts()
    rows = [(i, t, "en" if i % 2 else None, ["x", "y", None][i % 3], 0, "f", "s", "c") for i, t in enumerate(texts)]
    rows += [rows[0], rows[9]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_simhash_equals_brute_force(docs):
    found = simhash.near_duplicates(docs).collect()
    fps = {i: plain_fingerprint(t) for i, t in enumerate(made_texts())}
    groups = plain_groups(fps)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted((i, f"{fps[i]:016x}", groups[i]) for i in [*fps, 0, 9])


def test_links_of_random_fingerprints(spark):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(120)]
    for f in fps[:100]:  # chains of up to 4 bits a step, and pairs just too far
        for bits in (1, 4, 5):
            fps.append(f ^ sum(1 << b for b in r.sample(range(64), bits)))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {r.fp: r.root for r in simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    groups = plain_groups(dict(zip(signed, fps)))
    assert found == groups


@pytest.mark.parametrize("rows", [10, 10**6, 10**10, 10**13, 10**17])
def test_segments_meet_every_pair_within_the_distance(rows):
    masks, radius = simhash.segments(rows, 4)
    r = random.Random(rows)
    for _ in range(300):
        off = sum(1 << b for b in r.sample(range(64), 4))
        assert any((off & m).bit_count() <= radius for m in masks)


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = plain_groups({i: plain_fingerprint(t) for i, t in enumerate(made_texts())})
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))


def test_media_round_trip(docs):
    texts = made_texts()
    for r in media.text_media(docs).collect():
        data = (texts[r.doc_id] or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_type == "audio/x-wav" and r.media_bytes == len(media.store(texts[r.doc_id]))


def test_sniffing_carves_and_corrects(spark):
    wav = media.store("some text")
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes([0, 0, 0, 0, 1, 0, 1, 0, 0]) + b"\x02\x02\x44\x01\x00\x3b"
    rows = [(1, wav, "image/png"), (2, b"junk" + gif + b"BM" + wav, "text/plain"), (3, b"RIFF only, GIF89a", "text/plain"), (4, None, None), (5, b"", "x/y")]
    found = {r.id: r for r in media.sniff_column(spark.createDataFrame(rows, "n long, b binary, t string"), "n", "b", "t").collect()}
    assert (found[1].media_type, found[1].corrected) == ("audio/x-wav", True)
    assert [bytes(c.data) for c in found[2].carved] == [gif, wav] and found[2].media_type == "text/plain"
    assert not found[3].carved and not found[4].carved and found[5].media_type == "x/y"


@pytest.mark.parametrize("block", [3, 64, 1 << 18])
def test_token_counts(docs, block):
    encode = tokens.encoder().encode_ordinary
    texts = made_texts()
    found = sorted((r.doc_id, r.n_tokens) for r in tokens.token_counts(docs, block=block).collect())
    assert found == sorted((i, len(encode(texts[i] or ""))) for i in [*range(len(texts)), 0, 9])


def test_token_scan_over_cuts(spark):
    r = random.Random(1)
    for n in (0, 1, 7, 100):
        flat = np.array([r.choice([1, 2, 50256]) for _ in range(n)], "<u2")
        blocks = [("f", i, flat[i * 4 : i * 4 + 4].tobytes()) for i in range((n + 3) // 4)]
        found = tokens.scan(spark.createDataFrame(blocks, "file string, block long, tokens binary")).orderBy("nth").collect()
        parts = "".join("|" if x == 50256 else "." for x in flat).split("|")
        parts = parts if parts[-1] else parts[:-1]
        assert [x.n_tokens for x in found] == [len(p) for p in parts]


def test_pieces_equal_the_library(docs):
    # the library folds white space and other characters; its model without that is what spaces alone are marked for
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = made_texts()
    for r in pieces.encode_documents(docs).collect():
        t = texts[r.doc_id]
        if t is None:
            assert r.ids is None and r.n_tokens == 0 and r.lossless
            continue
        assert r.n_tokens == len(r.ids) and (r.lossless or "▁" in t)
        if t and t.isascii() and t.isprintable():
            assert list(r.ids) == lib.encode(t)


@given(st.text(max_size=60).filter(lambda t: "▁" not in t))
@settings(max_examples=150, deadline=None)
def test_pieces_round_trip(text):
    p = pieces.pieces()
    assert p.decode(p.encode([text])[0].tolist()) == text


def test_language(spark, empty):
    r = random.Random(2)
    words = {"aa": "the and with from this that have".split(), "bb": "der und mit von nicht auch haben".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k) for i in range(160) for k in ["aa" if i % 2 else "bb"]]
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "123 !?", "bb"), (502, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    found = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert all(found[i].lang_pred == k and 0 <= found[i].score <= 1 and found[i].accepted for i, _, k in rows)
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert all((found[i].lang_pred, found[i].score, found[i].accepted) == ("und", 0.0, False) for i in (500, 501, 502))
    assert sorted(x.doc_id for x in langid.accepted(docs, model).collect()) == list(range(160))
    assert langid.identify(docs, langid.fit(empty)).where("accepted").count() == 0


def test_quality(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(40)) + "."
    bad = lambda: " ".join(r.choice(["$$$", "###", "%%"]) + r.choice(WORDS) for _ in range(40))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    net = quality.fit(docs, labels, steps=200)
    found = {x.doc_id: x for x in quality.score(docs, net).collect()}
    held = [i for i in range(200) if found[i].held_out]
    assert held and np.mean([found[i].predicted == i % 2 for i in held]) > 0.9
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in found.values())
    assert found[900].score == found[901].score
    tail = "ok " * 200 + "$$$" * 40  # the whole text counts
    assert net.scores([tail])[0] != net.scores(["ok " * 200])[0]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("<nav><a href=x>Home</a></nav>", ""),
    ("<nav><ul><li><a href=/a>Menu</a></ul></nav><article><h1>Head  &amp; line</h1><p>One sentence of some words, all here.<p>Two <b>bold</b>\n words, and then a few more.</article><footer>&copy; all</footer>", "Head & line One sentence of some words, all here. Two bold words, and then a few more."),
    ("<body><script>var p='<p>no</p>'</script><style>p{}</style><main><p>The text that stays is here, in full length.</p><div class='comments'><p>A reader says that this is all wrong, and more.</p></div></main><aside>Side words that are of no use to any reader.</aside>", "The text that stays is here, in full length."),
])
def test_html(page, text):
    assert html.main_text(page) == text


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article><p>Some words 😀 in a sentence, long enough.</article>", "y")], "page_id long, url string, html string, text string")
    found = {r.page_id: (r.url, r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert found == {1: ("u", "", 0), 2: (None, "Some words 😀 in a sentence, long enough.", 40)}


@given(st.lists(st.integers(-9, 9), min_size=1, max_size=7), st.data())
@settings(max_examples=80, deadline=None)
def test_minimum_cut_costs_least(costs, data):
    n = len(costs)
    node = st.integers(0, n - 1)
    edges = [e for e in data.draw(st.lists(st.tuples(node, node, st.integers(0, 6)), max_size=10)) if e[0] != e[1]]
    price = lambda keep: sum(max(0, -c) if k else max(0, c) for c, k in zip(costs, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])
    assert price(html.minimum_cut(costs, edges)) == min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(empty).count() == 0
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-6 for r in rows)
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).collect())) == sorted(map(tuple, rows))
    mixed = mixing.mixed(docs.where("n_chars = 0").dropDuplicates(["doc_id"]))
    assert mixed.columns == docs.columns


def test_mixing_comes_near_its_targets(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 40 as int)) as text", "case when id % 3 > 0 then 'hot' when id % 2 = 0 then 'b' end as source")
    by = mixing.mix(rows).groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 40 for r in by) and len(by) == 3
    total = sum(r["max(source_size)"] for r in by)
    assert abs(sum(r["max(target)"] for r in by) - 1.5 * total) < 1


def test_sharding(docs, empty):
    found = sharding.shard(docs).collect()
    texts = made_texts()
    home = {}
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert home.setdefault(data, r.shard) == r.shard  # equal texts stay together
    for s in range(16):
        own = sorted(r.slot for r in found if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.shard(empty).count() == 0


def test_differencing_is_tight():
    r = random.Random(8)
    sizes = [r.randint(1, 10**6) for _ in range(2000)]
    sums, sets = sharding.difference((([n, *[0] * 15], [i, *[None] * 15]) for i, n in enumerate(sizes)), 16)
    items = [sharding.flat(t) for t in sets]
    assert sorted(i for x in items for i in x) == list(range(2000))
    totals = [sum(sizes[i] for i in x) for x in items]
    assert max(totals) - min(totals) < 1000 and [t - min(totals) for t in totals] == sums


def test_shards_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 50)
    monkeypatch.setattr(sharding, "FAN_IN", 4)
    groups = spark.range(1000).selectExpr("cast(cast(id as string) as binary) as gkey", "(id * 7919) % 5000 + 1 as bytes")
    sums = [r[1] for r in sharding.assign_groups(groups, 16).join(groups, "gkey").groupBy("shard").sum("bytes").collect()]
    assert len(sums) == 16 and max(sums) - min(sums) < 0.02 * sum(sums) / 16


def test_top_k(spark):
    r = random.Random(9)
    vec = lambda: [r.uniform(-1, 1) for _ in range(8)]
    rows = [(i, vec()) for i in range(300)]
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (350, [float("inf")] * 8), (303, rows[7][1]), (304, rows[7][1]), (7, rows[7][1])]
    found = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in ((i, v) for i, v in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != q)[:5]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert found == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_lists_stop_early_and_stay_exact():
    r = np.random.default_rng(4)
    data = r.integers(-256, 256, (3000, 16)).astype("<i4")
    lists = topk.SortedLists(data)
    for q in (r.integers(-256, 256, (8, 16)) * np.array([20] * 2 + [1] * 14)).astype("<i4"):
        rows, scores = lists.best(q, 5, -np.inf, np.zeros(3000, bool))
        assert len(rows) < 3000
        assert sorted(scores)[-5:] == sorted(data.astype(np.int64) @ q)[-5:]


@pytest.mark.parametrize("run", [simhash.near_duplicates, media.text_media, tokens.token_counts, pieces.encode_documents])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def plain_mix(docs, share=1.5, most=2.0):
    """copies of each (id, source, text) of docs, in plain Python."""
    size = lambda t: len([w for w in (t or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w])
    rows = [(i, s, size(t), int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:12], 16)) for i, t, s in docs]
    sources = sorted({s for _, s, _, _ in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, x, n, _ in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    target, left = {}, set(sources)
    while True:
        rest = share * sum(total.values()) - sum(most * total[s] for s in sources if s not in left)
        level = rest / (sum(weight[s] for s in left) or 1)
        over = {s for s in left if weight[s] * level > most * total[s]}
        if not over:
            break
        left -= over
    target = {s: weight[s] * level if s in left else most * total[s] for s in sources}
    out = {}
    for s in sources:
        own = [(i, n, u, max(1, n.bit_length())) for i, x, n, u in rows if x == s]
        low, high = 0.0, 1e18
        for _ in range(200):  # the level of expected copies by halving
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(most, mid * m) for _, n, _, m in own) < target[s] else (low, mid)
        expect = [min(most, high * m) if target[s] < most * total[s] else most for *_, m in own]
        expect = [round(e) if abs(e - round(e)) < 1e-9 else e for e in expect]
        owed = target[s] - sum(int(e) * n for e, (_, n, _, _) in zip(expect, own))
        luck = lambda u: (u + 0.5) / 2**48
        ranked = sorted(((luck(u) / (1 - luck(u)) / ((e - int(e)) / (1 - e + int(e))), u, i, n) for e, (i, n, u, _) in zip(expect, own) if e > int(e)), key=lambda x: x[:2])
        upto, more = 0, set()
        for at, (_, _, i, n) in enumerate(ranked):
            upto += n
            more |= {(i, n)} if 2 * upto - n <= 2 * owed + 1e-6 else set()
        for e, (i, n, _, _) in zip(expect, own):
            out[i, s, n] = int(e) + ((i, n) in more)
    return out, target


@pytest.fixture(scope="module")
def mixing_rows():
    r = random.Random(12)
    n = lambda: int(r.choice([3, 20, 60, 150, 700]) * r.uniform(0.5, 1.5))
    return [(i, " ".join(["w"] * n()), ["hot", "hot", "b", "c", None, "d"][i % 6]) for i in range(900)] + [(900, None, "b"), (901, " \t", "hot")]


@pytest.mark.parametrize("step_rows", [2000, 10])
def test_mixing_equals_plain_python(spark, mixing_rows, step_rows, monkeypatch):
    monkeypatch.setattr(mixing, "STEP_ROWS", step_rows)
    rows = mixing.mix(spark.createDataFrame(mixing_rows, "doc_id long, text string, source string")).collect()
    want, target = plain_mix(mixing_rows)
    assert len(rows) == len(mixing_rows) and {(r.doc_id, r.source, r.size): r.copies for r in rows} == want
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in rows)


def test_pareto_order_differs_from_the_order_of_the_random_numbers(spark, mixing_rows):
    df = spark.createDataFrame(mixing_rows, "doc_id long, text string, source string")
    u = {r.doc_id: r.u for r in mixing.sized(df).collect()}
    drawn = [r for r in mixing.mix(df).collect() if r.chance > 0]
    differ = 0
    for source in {r.source for r in drawn}:
        own = [r for r in drawn if r.source == source]
        more = [r for r in own if r.copies > int(r.expected)]
        by_u = sorted(own, key=lambda r: u[r.doc_id])[: len(more)]
        differ += 0 < len(more) < len(own) and {r.doc_id for r in more} != {r.doc_id for r in by_u}
    assert differ


def test_inclusion_comes_near_the_chances(spark, mixing_rows):
    """Over many seeds each class of size is drawn about as often as its chance says."""
    from collections import defaultdict

    own = [x for x in mixing_rows if x[2] in ("b", "c")]
    df = spark.createDataFrame([(seed * 10_000 + i, t, f"{seed:02d}{s}") for seed in range(30) for i, t, s in own], "doc_id long, text string, source string")
    hits, chances = defaultdict(list), {}
    for r in mixing.mix(df).collect():
        if r.chance > 0:
            key = (r.target / r.source_size, r.size.bit_length())
            hits[key].append(r.copies - int(r.expected))
            chances[key] = r.chance
    big = [k for k in hits if len(hits[k]) >= 200]
    assert len({round(chances[k], 2) for k in big}) >= 5
    assert all(abs(np.mean(hits[k]) - chances[k]) < 0.08 for k in big)


def test_mixed_takes_each_row_as_often_as_planned(spark, mixing_rows):
    from collections import Counter

    df = spark.createDataFrame([(*x, "c", "s") for x in mixing_rows], "doc_id long, text string, source string, copies string, size string")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    found = Counter(r.doc_id for r in out.collect())
    want, _ = plain_mix(mixing_rows)
    assert found == Counter({i: c for (i, _, _), c in want.items() if c})


@pytest.mark.parametrize("span", [2, 4096])
@pytest.mark.parametrize("block", [1, 3, 1000])
def test_flat_token_files(spark, tmp_path, monkeypatch, span, block):
    """Files without an index, cut anywhere, some documents over many blocks, some files without a last separator, one empty."""
    monkeypatch.setattr(tokens, "SPAN", span)
    r = random.Random(block)
    want = {}
    for n in range(5):
        flat = [r.choice([1, 2, 3, 0xC450, 0x50C4, 0x5050]) for _ in range(90)] if n < 4 else []
        flat = [1, *[7] * 40, 50256, *flat] if n == 2 else flat
        (tmp_path / f"{n}.bin").write_bytes(np.array(flat, "<u2").tobytes())
        parts = "".join("|" if x == 50256 else "." for x in flat).split("|")
        want[f"{n}.bin"] = [len(p) for p in (parts if parts[-1] else parts[:-1])]
    files = tokens.flat_files(spark, f"file://{tmp_path}")
    for how in (tokens.scan(tokens.read_blocks(files, block)), tokens.scan_files(files, block)):
        found = {}
        for x in how.orderBy("nth").collect():
            found.setdefault(x.file.rsplit("/", 1)[1], []).append(x.n_tokens)
        assert found == {k: v for k, v in want.items() if v}


def test_token_files_are_flat(spark, docs, tmp_path):
    flat = tokens.write_flat(docs, f"file://{tmp_path}/f").collect()
    encode = tokens.encoder().encode_ordinary
    texts = made_texts()
    for path in {x.path for x in flat}:
        ids = [i for x in sorted((x for x in flat if x.path == path and x.ids), key=lambda x: x.first) for i in x.ids]
        with open(path.removeprefix("file://"), "rb") as f:
            data = f.read()
        assert data == b"".join(np.array([*encode(texts[i] or ""), 50256], "<u2").tobytes() for i in ids)
        assert [x.bytes for x in flat if x.path == path and x.bytes is not None] == [len(data)]
