"""How filters interact: Walsh-Hadamard sums of the filters each document fails, inverted to exact counts of every set of failed filters."""

from __future__ import annotations

import hashlib
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallychain.llm.common import bounded_batches, salt, salted, staged

FILTERS = "ABCDE"
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Orders of the five filters.
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def failed(text: str) -> int:
    """The filters A to D that a text fails, one bit each: few words, repeated words, capitals, marks. Bytes split at 0x20 and 0x09-0x0D only."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    few, repeated = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 3 * len(text)
    marked = len(raw.translate(None, MARKS)) < len(raw)
    return few | repeated << 1 | loud << 2 | marked << 3


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) for each row of docs: bit n of the mask is 1 if filter n fails. Null texts are empty, null parts the empty text.

    Filter E fails where the whole table holds the same text with a smaller id. Texts meet as their SHA-256, first partly summed where they are
    read; the copies of one text, which can be many, look its least id up in salted parts. A null id is smaller than none and none is
    smaller than it.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("mask int, tid binary")
    def judged(texts: pd.Series) -> pd.DataFrame:
        whole = ["" if x is None else x for x in texts]
        return pd.DataFrame({"mask": [failed(x) for x in whole], "tid": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest() for x in whole]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), judged(F.col(text_col)).alias("j"))
    rows = staged(rows.select("doc_id", "part", "j.mask", "j.tid"), "judged")
    copied = rows.groupBy("tid").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("tid").alias("copy"), "least")
    met = rows.withColumn("part_of", salt("doc_id")).join(salted(copied), (F.col("tid") == F.col("copy")) & (F.col("part_of") == F.col("__salt")), "left")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return met.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(later, 16).otherwise(0)).alias("mask"))


def _sign(mask: Column, other: Column) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(other)) % 2)


def cells(masks: DataFrame, by: list[str], filters: int = len(FILTERS)) -> DataFrame:
    """masks(*by, mask) -> (*by, mask, n), zeros included: how many rows have exactly each mask.

    Each group is summed once as 2 ** filters signed sums, one for every set of filters: a row adds 1 or -1 by the parity of how many of
    the set it fails. The transform is its own inverse but for the factor 2 ** filters, so the division has no rest.
    """
    size = 1 << filters
    sums = F.array(*[F.sum(_sign(F.col("mask"), F.lit(s)).cast("long")) for s in range(size)]).alias("sums")
    every = lambda: F.sequence(F.lit(0), F.lit(size - 1))
    summed = masks.groupBy(*by).agg(sums)
    back = lambda m: F.aggregate(F.zip_with("sums", every(), lambda w, s: w * _sign(s, m)), F.lit(0).cast("long"), lambda a, x: a + x)
    found = F.transform(every(), lambda m: F.struct(m.alias("mask"), (back(m) / size).cast("long").alias("n")))
    return summed.select(*by, F.inline(found))


def _total(where, value) -> Column:
    """The sum of value over the cells that meet a condition."""
    return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, c: a + value(c))


def interactions(masks: DataFrame) -> DataFrame:
    """masks(part, mask, good, toxic) -> one row for each part, order of the five filters and step: see audit."""
    table = cells(masks, ["part", "good", "toxic"])
    table = table.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    table = table.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 for each part
    rows = table.select("part", "cells", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    bits = lambda test: sum((F.when(test(place[f]), 1 << n).otherwise(0) for n, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"before": bits(lambda p: p < F.col("step")), "own": bits(lambda p: p == F.col("step"))})
    now = lambda c: c["mask"].bitwiseAND(F.col("own")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0
    here = lambda c: now(c) & ~gone(c)
    n = lambda c: c["n"]
    return rows.select(
        "part", "filter_order", "step",
        _total(lambda c: ~now(c) & ~gone(c), n).alias("kept"),
        _total(here, n).alias("removed"),
        _total(lambda c: now(c) & gone(c), n).alias("redundant"),
        _total(lambda c: c["mask"] == F.col("own"), n).alias("unique_fails"),
        _total(here, lambda c: c["good"]).alias("good_lost"),
        _total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        # of the orders, in one of so many as a document fails filters does this one come first of those
        _total(now, lambda c: (c["n"] * len(ORDERS) / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part.

    A document is good or toxic if any of its labels(doc_id, quality, toxic) is 1; one without a label or with a null id is neither. Repeated rows
    count as often as they come. An empty table gives an empty table. Further columns are not read.
    """
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failures(docs, id_col, text_col, part_col).join(marks, F.col("doc_id") == F.col("labelled"), "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return interactions(rows.select("part", "mask", flag("good"), flag("toxic")))


#: The same rows in DuckDB's SQL.
AUDIT_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words from d),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by 1),
f as (
  select w.part, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic,
    len(words) < 200 as "A", 100 * len(list_distinct(words)) < 50 * len(words) as "B",
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) as "C",
    regexp_matches(t, '[#$%&*|]') as "D", coalesce(w.doc_id > min(w.doc_id) over (partition by t), false) as "E"
  from w left join l on w.doc_id = l.doc_id),
masks as (
  select part, good, toxic, cast("A" as integer) + 2 * cast("B" as integer) + 4 * cast("C" as integer) + 8 * cast("D" as integer) + 16 * cast("E" as integer) as mask from f),
cells as (
  select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from masks group by 1, 2),
letters as (select chr(cast(65 + i as integer)) as c, cast(1 << i as integer) as b from range(5) r(i)),
orders as (
  select a.c || b.c || c.c || d.c || e.c as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from letters a, letters b, letters c, letters d, letters e
  where a.b | b.b | c.b | d.b | e.b = 31),
steps as (
  select filter_order, cast(s.step as integer) as step, bits[s.step] as own, cast(coalesce(list_sum(bits[1:s.step - 1]), 0) as integer) as before
  from orders, range(1, 6) s(step)),
parts as (select distinct part from cells)
select p.part, s.filter_order, s.step,
  cast(coalesce(sum(c.n) filter (c.mask & (s.before | s.own) = 0), 0) as bigint) as kept,
  cast(coalesce(sum(c.n) filter (c.mask & s.own <> 0 and c.mask & s.before = 0), 0) as bigint) as removed,
  cast(coalesce(sum(c.n) filter (c.mask & s.own <> 0 and c.mask & s.before <> 0), 0) as bigint) as redundant,
  cast(coalesce(sum(c.n) filter (c.mask = s.own), 0) as bigint) as unique_fails,
  cast(coalesce(sum(c.g) filter (c.mask & s.own <> 0 and c.mask & s.before = 0), 0) as bigint) as good_lost,
  cast(coalesce(sum(c.x) filter (c.mask & s.own <> 0 and c.mask & s.before = 0), 0) as bigint) as toxic_lost,
  cast(coalesce(sum(c.n * 120 // greatest(bit_count(c.mask), 1)) filter (c.mask & s.own <> 0), 0) as bigint) as shapley
from parts p, steps s, cells c where c.part = p.part
group by 1, 2, 3
"""
