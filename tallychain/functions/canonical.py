"""Canonical payloads: recursive cleaning, canonical JSON text, coercions and the whitelisted debug text."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a payload's top level that its hash leaves out.
EXCLUDED = ("__v", "_id", "createdAt", "updatedAt", "hash")


def number_text(x: int | float) -> str:
    """A number as ECMAScript prints it, which is what RFC 8785 asks for. Integers beyond a double's precision are rounded to a double first."""
    x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent  # the value is 0.text * 10 ** point
    if len(text) <= point <= 21:
        out = text.ljust(point, "0")
    elif 0 < point <= 21:
        out = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + out


def _string(s: str) -> str:
    return json.dumps(s, ensure_ascii=False)


def canonical(value, exclude: tuple[str, ...] = ()) -> str:
    """JSON text with keys in order of their UTF-16 units, no spaces, and numbers by number_text; exclude holds at the top level."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, int | float):
        return number_text(value)
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted((k for k in value if k not in exclude), key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{_string(k)}:{canonical(value[k])}" for k in keys) + "}"


def clean(value, mode: str = "writer"):
    """value without empty parts. Keys with null, '' or an empty container go in either mode. In an array, the writer's rules turn null
    into {} and keep '' and empty containers; the reader's rules drop null and ''. Zero and false always stay."""
    if value is None:
        return {} if mode == "writer" else None
    if isinstance(value, list):
        items = [clean(x, mode) for x in value]
        return items if mode == "writer" else [x for x in items if x is not None and x != ""]
    if isinstance(value, dict):
        pairs = ((k, clean(v, mode) if isinstance(v, dict | list) else v) for k, v in value.items() if v is not None and v != "")
        return {k: v for k, v in pairs if not (isinstance(v, dict | list) and not v)}
    return value


def debug_text(value: dict) -> str:
    """JSON text that keeps, at every level, only keys that the top level has, in order."""
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))

    def only(x) -> str:
        if isinstance(x, dict):
            return "{" + ",".join(f"{_string(k)}:{only(x[k])}" for k in keys if k in x) + "}"
        return "[" + ",".join(map(only, x)) + "]" if isinstance(x, list) else canonical(x)

    return only(value)


def reader_number(x: int | float) -> str:
    """A number as the second verifier prints it: whole numbers of 64 bits as they are, others as number_text has them, but minus zero."""
    if isinstance(x, int) and -(1 << 63) <= x < 1 << 63:
        return str(x)
    return "-0" if x == 0 and str(x).startswith("-") else number_text(x)


#: Characters that the second verifier's encoder escapes beside those that JSON must escape.
READER_ESCAPES = {ord("<"): "\\u003c", ord(">"): "\\u003e", ord("&"): "\\u0026", 0x2028: "\\u2028", 0x2029: "\\u2029"}


def reader_text(value) -> str:
    """JSON text as the second verifier encodes it: keys in order of their UTF-8 bytes, no keys left out, and READER_ESCAPES."""
    if isinstance(value, str):
        return _string(value).translate(READER_ESCAPES)
    if isinstance(value, list):
        return "[" + ",".join(map(reader_text, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{reader_text(k)}:{reader_text(value[k])}" for k in sorted(value, key=str.encode)) + "}"
    return canonical(value) if value is None or isinstance(value, bool) else reader_number(value)


def _each(texts: pd.Series, f) -> pd.Series:
    """f of each text's JSON value; null for a null text, for what is not JSON, for text that UTF-8 cannot hold (half of a surrogate pair) and
    for values nested deeper than Python's stack."""

    def one(t: str | None) -> str | None:
        try:
            out = None if t is None else f(json.loads(t))
            if out is not None:
                out.encode()
            return out
        except (ValueError, RecursionError):
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


def jcs(text: Column, exclude: tuple[str, ...] = EXCLUDED) -> Column:
    """Canonical text of a JSON column; null where it is null or no JSON."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _each(s, lambda v: canonical(v, exclude))

    return run(text)


def clean_json(text: Column, mode: str = "writer") -> Column:
    """Cleaned and canonical text of a JSON column."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _each(s, lambda v: canonical(clean(v, mode)))

    return run(text)


def reader_json(text: Column) -> Column:
    """What the second verifier hashes of a JSON column: cleaned by the reader's rules and encoded by reader_text; null for what is no object."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _each(s, lambda v: reader_text(clean(v, "reader")) if isinstance(v, dict) else None)

    return run(text)


def payload_json(text: Column) -> Column:
    """What a block stores of a request's JSON: cleaned by the writer's rules and canonical, without the keys that hashes leave out."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _each(s, lambda v: canonical(clean(v), EXCLUDED))

    return run(text)


def debug_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _each(s, lambda v: debug_text(v) if isinstance(v, dict) else canonical(v))

    return run(text)


def _tokens(begin: str = "", empty: bool = True, without: tuple[str, ...] = (), escaped: str = "") -> str:
    """A pattern of whole texts without spaces between their tokens: strings without escapes and whole numbers of at most 15 digits; begin is what they begin
    with, empty whether they may hold null and empty parts, without keys that they lack, escaped characters that their strings lack. Each part
    takes all it can and gives nothing back, so a text of any length is read once and without recursion."""
    key = '(?!(?:' + "|".join(map(re.escape, without)) + ')":)' if without else ""
    string = f'"{key}[^"\\\\\\x00-\\x1f{escaped}]{"*" if empty else "+"}+"'
    opening = r"[{\[]|null" if empty else r"\{(?!\})|\[(?!\])"
    return rf"\A{begin}(?:{string}|[}}\],:]|{opening}|-?[1-9][0-9]{{0,14}}+(?![0-9.eE])|0(?![0-9.eE])|true|false)++\z"


#: What each form of a text needs: the exact form of a JSON value, and a pattern of the texts that only need their keys put in order.
FORMS = {
    "jcs": (lambda v: canonical(v, EXCLUDED), _tokens(without=EXCLUDED)),
    "clean": (lambda v: canonical(clean(v)), _tokens(empty=False)),
    "payload": (lambda v: canonical(clean(v), EXCLUDED), _tokens(empty=False, without=EXCLUDED)),
    "reader": (lambda v: reader_text(clean(v, "reader")) if isinstance(v, dict) else None, _tokens(r"(?=\{)", False, escaped=r"<>&\x{2028}\x{2029}\x{10000}-\x{10ffff}")),
}
#: Spaces between tokens; strings are matched to be left as they are.
SPACES = r"""("[^"]*+")|[ \t\r\n]++"""


def native(rows: DataFrame, name: str, text: Column, form: str) -> DataFrame:
    """rows with column `name`: the form of a JSON text by Spark's own variant, in the JVM; null where the text needs more than its keys put in order.

    A variant keeps an object's keys in order of their UTF-16 units. A text of _tokens in canonical form is as long as it is without spaces, so
    a result of another length (a key twice, something after the value) is not taken. Each step is a column, so that it is computed once.
    """
    steps = rows.withColumns({"__text": text})
    steps = steps.withColumn("__flat", F.when(F.col("__text").rlike("[ \\t\\r\\n]"), F.regexp_replace("__text", SPACES, "$1")).otherwise(F.col("__text")))
    steps = steps.withColumn(name, F.when(F.col("__flat").rlike(FORMS[form][1]), F.to_json(F.try_parse_json("__text"))))
    return steps.withColumn(name, F.when(F.length(name) == F.length("__flat"), F.col(name))).drop("__flat", "__text")


def with_text(rows: DataFrame, name: str, text: Column, form: str) -> DataFrame:
    """rows with column `name`: the form of a JSON text, one of FORMS; null as jcs, clean_json, payload_json and reader_json have it. Only texts
    without a native result are sent to Python."""
    exact = FORMS[form][0]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _each(s, exact)

    made = native(rows.withColumn("__source", text), "__own", F.col("__source"), form)
    return made.withColumn(name, F.coalesce("__own", run(F.when(F.col("__own").isNull(), F.col("__source"))))).drop("__own", "__source")


def text_to_long(text: Column) -> Column:
    """A text as a long; 0 if it is null or no whole number."""
    return F.coalesce(F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def number_to_long(value: Column) -> Column:
    """A double as a long, cut off towards zero; null is 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))
