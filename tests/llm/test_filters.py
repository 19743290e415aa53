"""The filter interaction audit against counting document by document, and its SQL."""

import random
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from tallychain.llm import filters

SCHEMA = "doc_id long, text string, lang string, source string, part string, mask int, tid string"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, t, lang in docs:
        t = t or ""
        words = [w for w in t.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in t for c in "#$%&*|"), "E": i is not None and t in least and least[t] < i,
        }
        has = lambda n: any(r[0] == i and r[n] == 1 for r in labels) if i is not None else False
        rows.append((lang or "", {f for f, x in fails.items() if x}, has(1), has(2)))
    out = []
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed, found = Counter(), []
        for order in orders:
            for n, f in enumerate(order):
                before = set(order[:n])
                here = [r for r in own if f in r[1] and not r[1] & before]
                removed[f] += len(here)
                kept = sum(not r[1] & (before | {f}) for r in own)
                found.append((part, order, n + 1, kept, len(here), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)))
        out += [(*x, removed[x[1][x[2] - 1]]) for x in found]
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \t\n", "ÄÖÜ é", "A" * 9, "x # y", "  a b"]
    for n in (5, 199, 200, 400, 1500):
        for few in (False, True):
            words = [word() if not few else r.choice(["la", "li"]) for _ in range(n)]
            texts += [" ".join(words), "\n".join(words) + " $", " ".join(w.upper() if r.random() < 0.3 else w for w in words)]
    docs = [(i, r.choice(texts), r.choice(["en", "de", "", None])) for i in range(300)] + [(None, texts[5], "en"), (None, texts[5], "en"), (-4, texts[3], "fr")]
    docs += docs[:5]
    labels = [(r.randrange(-5, 320), r.choice([0, 1, None]), r.choice([0, 1])) for _ in range(250)] + [(None, 1, 1)]
    return docs, labels


def rows_of(df):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(df.columns) == sorted(names)
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_equals_counting(spark, tables):
    docs, labels = tables
    df = spark.createDataFrame([(i, t, p, "s", "x", 0, "y") for i, t, p in docs], SCHEMA)
    made = filters.audit(df, spark.createDataFrame(labels, LABELS))
    assert rows_of(made) == plain(docs, labels)
    assert dict(made.dtypes)["step"] == "int" and dict(made.dtypes)["shapley"] == "bigint"


def test_sql_equals_counting(tables):
    docs, labels = tables
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar, lang varchar)")
    con.sql("create table labels(doc_id bigint, quality int, toxic int)")
    con.executemany("insert into documents values (?, ?, ?)", docs)
    con.executemany("insert into labels values (?, ?, ?)", labels)
    assert sorted(con.sql(filters.AUDIT_SQL).fetchall()) == plain(docs, labels)


def test_empty_tables(spark, tables):
    no_labels = spark.createDataFrame([], LABELS)
    assert rows_of(filters.audit(spark.createDataFrame([], SCHEMA), no_labels)) == []
    assert rows_of(filters.audit(spark.createDataFrame([(1, "a", None, "s", "x", 0, "y")], SCHEMA), no_labels)) == plain([(1, "a", None)], [])


def test_sums_are_inverted_exactly(spark):
    r = random.Random(4)
    masks = [(r.choice("xy"), r.randrange(32)) for _ in range(500)]
    found = filters.cells(spark.createDataFrame(masks, "part string, mask int"), ["part"]).collect()
    count = Counter(masks)
    assert len(found) == 64 and all(x.n == count[x.part, x.mask] for x in found)
