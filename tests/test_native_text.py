"""Canonical texts made by Spark's variant against the exact ones, and which texts go to Python."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallychain.functions import canonical as c

KEYS = st.sampled_from(["a", "b", "B", "_id", "hash", "createdAt", "", "é", "ﬀ", "😀", "a b", "10", "9"])
LEAVES = st.none() | st.booleans() | st.integers(-(10**17), 10**17) | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False) | st.sampled_from(["", "x", "null", "{}", " ", "<&>", 'q"', "\\", " ", "😀", "a\tb", "\x7f"])
VALUES = st.recursive(LEAVES, lambda v: st.lists(v, max_size=4) | st.dictionaries(KEYS, v, max_size=4), max_leaves=12)
#: Texts at the edges of what the variant and Python's parser take alike.
EDGES = [
    None, "", " ", "{", "{}", "[]", '{"a":1} ', '{"a":1}x', '{"a":1}{"b":2}', '{"a":1}1', '{"a":1,"a":2}', '{"b":1,"a":{"d":1,"c":[1, 2]}}', '{ "b" : 1 , "a" : "x  y" }', "12 34", "[1 2]", "1true", "-0", "[-0]",
    "-", "[-]", "007", "[1.0]", "[1e2]", "123456789012345", "1234567890123456", "12345678901234567890", "[999999999999999,-999999999999999]", '{"a":NaN}', "NaN", '{"a":null}', '{"a":"null"}', '{"x":"{}"}', '{"_id":1,"b":2}',
    '{"b":{"_id":1},"a":2}', '{"😀":1,"ﬀ":2}', '{"a":"\\u0041"}', '{"a":"\x01"}', '﻿{"a":1}', "'a'", "{a:1}", "[1,]", "[1]/*x*/", "true", '"x"', '{"a":{"b":1},"b":{"a":1,"z":2}}', '{"a":1}\n', '{"a":1}\x0b', "[" * 1500 + "]" * 1500, "[" * 300 + "]" * 300,
]


def exact(f, text):
    try:
        out = None if text is None else f(json.loads(text))
        return out if out is None or out.encode() else out
    except (ValueError, RecursionError):
        return None


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(2)
    for form in c.FORMS:
        df = c.with_text(df, form, F.col("t"), form)
    found = {r.n: r for r in df.collect()}
    for n, text in enumerate(texts):
        for k, (plain, _) in c.FORMS.items():
            assert found[n][k] == exact(plain, text), (k, text)


def test_edges(spark):
    check(spark, EDGES)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.tuples(VALUES, st.sampled_from([None, 1]), st.booleans(), st.sampled_from([(",", ":"), (", ", ": ")])), min_size=120, max_size=160))
def test_any_json(spark, values):
    check(spark, [json.dumps(v, indent=i, ensure_ascii=a, separators=p) for v, i, a, p in values])


def test_long_texts(spark):
    check(spark, ["[" + ",".join(["1"] * 300_000) + "]", json.dumps({f"k{i % 40000}": i for i in range(40_000)}), '{"a":"' + "x" * 1_000_000 + '"}'])


@pytest.mark.parametrize("form, text, goes", [
    ("jcs", '{"b":[1,{"d":true,"c":"x"}],"a":"é 😀"}', True), ("jcs", '{ "b": 1, "a": "x y" }', True), ("jcs", '{"a":null,"b":""}', True), ("jcs", '{"a":1.5}', False), ("jcs", '{"a":"\\n"}', False),
    ("jcs", '{"a":1}x', False), ("jcs", '{"a":1,"a":2}', False), ("jcs", '{"hash":1}', False), ("jcs", None, False), ("clean", '{"hash":1}', True), ("clean", '{"a":""}', False), ("clean", '{"a":{ }}', False),
    ("payload", '{"a":"null"}', True), ("reader", '{"a":"<"}', False), ("reader", '{"a":"x"}', True), ("reader", "[1]", False),
])
def test_what_needs_no_python(spark, form, text, goes):
    df = spark.createDataFrame([(text,)], "t string")
    assert c.native(df, "made", F.col("t"), form).select(F.col("made").isNotNull()).first()[0] == goes
