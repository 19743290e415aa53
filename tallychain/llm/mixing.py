"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallychain.llm.common import staged

#: A word, and the weights that sources take in turn.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Bits of a document's random number, and rows that one step of the running sums should hold.
BITS, STEP_ROWS = 48, 2000


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, source, size: words of the text, u: the document's 48-bit random number, from its id alone)."""
    own = F.col(id_col).alias("doc_id")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(
        own,
        F.col(source_col).alias("source"),
        _size(F.col(text_col)).alias("size"),
        F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("u"),
    )


def targets(by_source: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """by_source(source, source_size) -> (..., target).

    Sharing again what is above a cap ends with targets weight * level, or the cap where that is less. Sources in order of cap / weight
    meet their caps first, so the level follows from running sums.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    turn = (F.row_number().over(place) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int"))
    rows = by_source.withColumn("weight", weight.cast("long")).withColumn("full_at", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    rows = rows.withColumns({
        "left_size": F.lit(float(share)) * F.sum("source_size").over(everything) - F.lit(float(most)) * (F.sum("source_size").over(so_far) - F.col("source_size")),
        "left_weight": F.sum("weight").over(everything) - F.sum("weight").over(so_far) + F.col("weight"),
    })
    rows = rows.withColumn("level", F.col("left_size") / F.col("left_weight"))
    # the first source that does not fill up at its level sets the level; those of the sources after it are no higher
    level = F.max(F.when(F.col("full_at") >= F.col("level"), F.col("level"))).over(everything)
    return rows.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "target")


def _odds(p: Column) -> Column:
    return p / (1 - p)


def levels(classes: DataFrame, most: float = 2.0) -> DataFrame:
    """classes(source, measure, words, target) -> (source, measure, expected, certain, chance, owed): what a document of each class can expect.

    A document's expected copies are its measure times its source's level, or `most` where that is less; the level makes the expected words
    the source's target. Classes of a large measure meet the cap first, so the level follows from running sums over a source's few classes.
    Whole copies are certain, the rest is the chance of one more; owed are the source's words that certain copies leave open.
    """
    by = Window.partitionBy("source")
    down = by.orderBy(F.desc("measure"))
    earlier, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    cap = F.lit(float(most))
    rows = classes.withColumns({
        "full": F.coalesce(F.sum("words").over(earlier), F.lit(0)).cast("double"),
        "weighted": F.sum(F.col("words") * F.col("measure")).over(rest).cast("double"),
    })
    rows = rows.withColumn("level", F.try_divide(F.col("target") - cap * F.col("full"), F.col("weighted")))
    # the first class that does not meet the cap at its level sets the level
    fits = F.when(F.col("level") * F.col("measure") <= cap, F.struct((-F.col("measure")).alias("nth"), F.col("level").alias("level")))
    rows = rows.withColumn("level", F.coalesce(F.min(fits).over(by)["level"], F.lit(float("inf"))))
    rows = rows.withColumn("expected", F.least(cap, F.col("level") * F.col("measure")))
    rows = rows.withColumn("certain", F.floor("expected").cast("long"))
    owed = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(by)
    return rows.select("source", "measure", "expected", "certain", (F.col("expected") - F.col("certain")).alias("chance"), owed.alias("owed"))


def _before(steps: DataFrame, by: list[str], key: str, value: str, span: int = 1024) -> DataFrame:
    """steps with `before`: the sum of value over the smaller keys of the same `by`. Spans of keys are summed first, so that no task holds all
    steps of one group."""
    named = steps.withColumn("__span", F.floor(F.col(key) / span).cast("long"))
    so_far = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = named.groupBy(*by, "__span").agg(F.sum(value).alias("__n")).withColumn("__earlier", F.coalesce(F.sum("__n").over(so_far), F.lit(0)))
    inside = Window.partitionBy(*by, "__span").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = named.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("a")
    on = F.col("a.__span") == F.col("b.__span")
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return own.join(spans.alias("b"), on).select("a.*", (F.col("a.__inside") + F.col("b.__earlier")).alias("before")).drop("__span", "__inside")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", **columns) -> DataFrame:
    """(doc_id, source, size, source_size, target, expected, chance, copies, taken) for each row of docs.

    A document's expected copies grow with a measure of its size, the number of its size's binary digits (at least 1), up to `most`, so
    that a source's expected words are its target (see levels). The whole copies of that are certain; the words still owed come from a sample
    without replacement with unequal chances, by Pareto order sampling: it ranks the source's documents by their random odds over the odds of
    their chance and takes them in that order while a document's middle lies within the owed words, so that its size in words is fixed. Rows that
    repeat an id and a size are ranked and taken together. A null source is a source of its own; a null text or one without a word has size 0
    and takes no words. An empty table gives an empty table. Only the id, the text and the source are read.

    A source's running sum is made in steps of the ranking: words per step first, then a window inside each step, so that no
    task holds a whole source.
    """
    rows = staged(sized(docs, seed=seed, **columns).withColumn("measure", F.greatest(F.length(F.bin("size")), F.lit(1)).cast("long")), "sized")
    classes = rows.groupBy("source", "measure").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights)
    c, g = classes.alias("c"), goal.alias("g")
    placed = c.join(g, F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "c.measure", "c.words", "g.source_size", "g.target")
    plan = levels(placed.select("source", "measure", "words", "target"), most).alias("l")
    p = placed.alias("p")
    plan = p.join(plan, F.col("p.source").eqNullSafe(F.col("l.source")) & (F.col("p.measure") == F.col("l.measure")))
    plan = plan.select("p.source", "p.measure", "p.words", "p.source_size", "p.target", "l.expected", "l.certain", "l.chance", "l.owed")
    # the odds of a source as a whole, which only spread the steps evenly
    mean = F.try_divide(F.sum(F.col("chance") * F.col("words")).over(Window.partitionBy("source")), F.sum(F.when(F.col("chance") > 0, F.col("words"))).over(Window.partitionBy("source")))
    plan = staged(plan.withColumn("mean", F.coalesce(mean, F.lit(0.5))), "plan")

    d, l = rows.alias("d"), plan.alias("l")
    d = d.join(l, F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.measure") == F.col("l.measure")))
    d = d.select("d.doc_id", "d.source", "d.size", "d.u", "l.source_size", "l.target", "l.expected", "l.certain", "l.chance", "l.owed", "l.mean")
    luck = (F.col("u") + 0.5) / float(1 << BITS)
    d = d.withColumn("rank_by", F.when(F.col("chance") > 0, _odds(luck) / _odds(F.col("chance"))))
    steps_log = max(0, min(40, math.ceil(math.log2(max(rows.count(), 1) / STEP_ROWS))))
    evenly = 1 / (1 + F.try_divide(1 - F.col("mean"), F.col("mean") * F.col("rank_by")))  # each operation keeps the order, rounding included
    d = d.withColumn("step", F.when(F.col("chance") > 0, F.least(F.floor(evenly * float(1 << steps_log)), F.lit((1 << steps_log) - 1))).otherwise(-1).cast("long"))
    drawn = d.where("step >= 0")
    steps = _before(drawn.groupBy("source", "step").agg(F.sum("size").alias("n")), ["source"], "step", "n").alias("s")
    drawn = drawn.alias("d").join(steps, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.step") == F.col("s.step"))).select("d.*", "s.before")
    order = Window.partitionBy("source", "step").orderBy("rank_by", "u", "doc_id", "size")
    peers = Window.partitionBy("source", "step", "rank_by", "u", "doc_id", "size")
    drawn = drawn.withColumns({"upto": F.col("before") + F.sum("size").over(order), "own": F.sum("size").over(peers)})
    drawn = drawn.withColumn("copies", F.col("certain") + F.when(2 * F.col("upto") - F.col("own") <= 2 * F.col("owed"), 1).otherwise(0))
    names = ["doc_id", "source", "size", "source_size", "target", "expected", "chance", "copies"]
    whole = d.where("step < 0").withColumn("copies", F.col("certain"))
    return drawn.select(*names).union(whole.select(*names)).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it (not at all, once or more); columns as before. Rows that repeat an id and a source
    are told apart by their size."""
    names = {k: how.get(k, k.removesuffix("_col")) for k in ("text_col", "source_col")} | {"id_col": how.get("id_col", "doc_id")}
    plan = mix(docs, **how).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0").alias("m")
    d = docs.withColumn("__size", _size(F.col(names["text_col"]))).alias("d")
    on = F.col(f"d.`{names['id_col']}`").eqNullSafe(F.col("m.doc_id")) & F.col(f"d.`{names['source_col']}`").eqNullSafe(F.col("m.source")) & (F.col("d.__size") == F.col("m.size"))
    nth = F.explode(F.sequence(F.lit(1), F.col("m.copies").cast("int")))
    return d.join(plan, on).select("d.*", nth.alias("__copy")).drop("__copy", "__size")


#: The same rows in DuckDB's SQL.
MIX_SQL = r"""
with counted as (
  select doc_id, source,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) as u
  from documents),
sized as (select *, cast(length(bin(size)) as bigint) as measure from counted),
by_source as (
  select source, cast(sum(size) as bigint) as source_size,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from sized group by source),
levels as (
  select *, 2.0::double * source_size / weight as full_at from by_source),
running as (
  select *,
    (1.5::double * sum(source_size) over () - 2.0::double * (sum(source_size) over w - source_size))
      / (sum(weight) over () - sum(weight) over w + weight) as level
  from levels window w as (order by full_at, source nulls last rows between unbounded preceding and current row)),
goal as (
  select source, source_size,
    least(2.0::double * source_size, weight * coalesce(max(case when full_at >= level then level end) over (), 'inf'::double)) as target
  from running),
classes as (
  select d.source, d.measure, cast(sum(d.size) as bigint) as words, any_value(g.source_size) as source_size, any_value(g.target) as target
  from sized d join goal g on d.source is not distinct from g.source group by d.source, d.measure),
tried as (
  select *, (target - 2.0::double * cast(coalesce(sum(words) over (w rows between unbounded preceding and 1 preceding), 0) as double))
      / nullif(cast(sum(words * measure) over (w rows between current row and unbounded following) as double), 0) as own_level
  from classes window w as (partition by source order by measure desc)),
expected as (
  select *, least(2.0::double, measure * coalesce(arg_max(own_level, measure) filter (own_level * measure <= 2.0::double) over (partition by source), 'inf'::double)) as expected
  from tried),
parts as (
  select *, cast(floor(expected) as bigint) as certain, expected - floor(expected) as p,
    target - sum(cast(floor(expected) as bigint) * words) over (partition by source) as owed
  from expected),
drawn as (
  select d.doc_id, d.source, d.size, d.u, p.source_size, p.target, p.certain, p.p, p.owed,
    case when p.p > 0 then (((d.u + 0.5::double) / 281474976710656.0::double) / (1 - (d.u + 0.5::double) / 281474976710656.0::double)) / (p.p / (1 - p.p)) end as rank_by
  from sized d join parts p on d.source is not distinct from p.source and d.measure = p.measure),
placed as (
  select *,
    sum(size) over (partition by source, rank_by is null order by rank_by, u, doc_id, size) as upto,
    sum(size) over (partition by source, rank_by, u, doc_id, size) as own
  from drawn)
select doc_id, size, source_size, target,
  cast(size * (certain + case when p > 0 and 2 * upto - own <= 2 * owed then 1 else 0 end) as bigint) as taken
from placed
"""
