"""Positions and neighbours in the order of a whole-number key, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that one window partition spans.
SPAN = 1 << 16


#: The range of rows without a key: after all others.
LAST = 1 << 62


def _range(key: str, span: int) -> Column:
    return F.coalesce(F.floor(F.col(key) / F.lit(span)).cast("long"), F.lit(LAST).cast("long"))


def _earlier(counts: DataFrame, span: int) -> DataFrame:
    """counts(__range, n) with __before: the sum over smaller ranges. Ranges are summed by span in turn, so that sparse keys, with a range for
    almost every row, don't meet in one task either."""
    named = counts.withColumn("__super", _range("__range", span))
    before = Window.orderBy("__super").rowsBetween(Window.unboundedPreceding, -1)
    supers = named.groupBy("__super").agg(F.sum("n").alias("m")).select("__super", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("__far"))
    inside = Window.partitionBy("__super").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    near = named.withColumn("__near", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return near.join(supers, "__super").select("__range", (F.col("__near") + F.col("__far")).alias("__before"))


def numbered(df: DataFrame, key: str, name: str, start: int = 0, tie: str | None = None, span: int = SPAN) -> DataFrame:
    """df with each row's position by key (then tie). Ranges of keys are counted first; a row's position is the count of the ranges
    before its own and its place there. Only one row for each span * span keys meets in one task. Rows with a null key come last, in order of tie."""
    ranged = df.withColumn("__range", _range(key, span))
    counts = _earlier(ranged.groupBy("__range").agg(F.count("*").alias("n")), span)
    within = Window.partitionBy("__range").orderBy(key, *([tie] if tie else []))
    place = F.col("__before") + F.row_number().over(within) - 1 + start
    return ranged.join(counts, "__range").withColumn(name, place.cast("long")).drop("__range", "__before")


def _lagged(ends: DataFrame, by: list, key: str) -> DataFrame:
    return ends.withColumn("__edge", F.lag("__v").over(Window.partitionBy(*by).orderBy(key) if by else Window.orderBy(key)))


def with_previous(df: DataFrame, key: str, value: str, name: str, tie: str, span: int = SPAN) -> DataFrame:
    """df with the value of the row before by (key, tie); null for the first. Inside a range of keys it is a lag; the first row of a range
    takes the last value of the nearest range before it that has rows, and the first range of a span of ranges that of the span before.
    Rows with a null key come last, in order of tie."""
    ranged = df.withColumn("__range", _range(key, span))
    last = lambda *by: F.max(F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(by)], F.col("__v").alias("v"))).getField("v").alias("__v")
    ends = ranged.withColumn("__v", F.struct(value)).groupBy("__range").agg(last(key, tie)).withColumn("__super", _range("__range", span))
    edges = _lagged(ends, ["__super"], "__range")
    far = _lagged(ends.groupBy("__super").agg(last("__range")), [], "__super").select("__super", F.col("__edge").alias("__far"))
    edges = edges.join(far, "__super").select("__range", F.coalesce("__edge", "__far").getField(value).alias("__edge"))
    within = Window.partitionBy("__range").orderBy(key, tie)
    inside = ranged.withColumns({name: F.lag(value).over(within), "__nth": F.row_number().over(within)})
    joined = inside.join(edges, "__range").withColumn(name, F.when(F.col("__nth") == 1, F.col("__edge")).otherwise(F.col(name)))
    return joined.drop("__range", "__edge", "__nth")
