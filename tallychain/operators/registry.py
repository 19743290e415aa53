"""The model registry: guarded requests, and create, update and delete as rewrites."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallychain.operators.components import components
from tallychain.operators.numbering import numbered
from tallychain.session import staged


def accept_inferences(requests: DataFrame, models: DataFrame) -> DataFrame:
    return requests.join(models.select("model_id"), "model_id", "left_semi")


def reject_inferences(requests: DataFrame, models: DataFrame) -> DataFrame:
    return requests.join(models.select("model_id"), "model_id", "left_anti")


#: Rounds in which requests that come first for both their keys are accepted side by side, before what is left is decided by components.
ROUNDS = 2
TAKEN = ("name and version exist", "model and version exist")


def _one_by_one(pdf: pd.DataFrame) -> pd.DataFrame:
    """The requests of one component in order of their place."""
    names, ids, out = set(), set(), []
    pdf = pdf.sort_values("place")
    for place, name, model, version in zip(pdf["place"], pdf["name"], pdf["model_id"], pdf["version"]):
        reason = TAKEN[0] if (name, version) in names else TAKEN[1] if (model, version) in ids else None
        if reason is None:
            names.add((name, version))
            ids.add((model, version))
        out.append((place, reason))
    return pd.DataFrame(out, columns=["place", "decided"])


def registrations(requests: DataFrame, models: DataFrame, order: str) -> DataFrame:
    """requests(name, version, model_id, order) with a reason: null if accepted, else what is taken already. The outcome is that of taking the
    requests one by one in order, those without an order last and ties by their keys: a refused one takes nothing. A null name, id or version
    is a value like others.

    Both the name and the id with a version must be new, so that no block is appended for a row that the registry would refuse. Requests that
    clash with the registry go first; of the others, those that come first for their name and for their id are accepted, which refuses all
    others of these. What then is left are chains, each request waiting for another: the connected components of requests that share a key are
    found in rounds that grow with the logarithm of their number, and each is decided by one task, in order.
    """
    tie = F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in ("name", "model_id", "version")])
    rows = numbered(requests.withColumn("__tie", tie), order, "place", 0, "__tie").drop("__tie")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    named = models.select(F.col("name").alias("__n"), F.col("version").alias("__v"), F.lit(True).alias("named")).distinct()
    known = models.select(F.col("model_id").alias("__m"), F.col("version").alias("__w"), F.lit(True).alias("known")).distinct()
    rows = rows.join(named, same("name", "__n") & same("version", "__v"), "left").join(known, same("model_id", "__m") & same("version", "__w"), "left")
    taken = F.when(F.col("named"), TAKEN[0]).when(F.col("known"), TAKEN[1])
    rows = staged(rows.select(*requests.columns, "place", taken.alias("reason"), taken.isNull().alias("open")), "registrations")
    for _ in range(ROUNDS):
        if rows.where("open").isEmpty():
            return rows.drop("open", "place")
        own = lambda by: Window.partitionBy("open", by, "version")
        first = [F.col("place") == F.min("place").over(own(by)) for by in ("name", "model_id")]
        rows = rows.withColumn("wins", F.col("open") & first[0] & first[1])
        rows = rows.withColumns({"w1": F.max("wins").over(own("name")), "w2": F.max("wins").over(own("model_id"))})
        lost = F.when(F.col("open") & ~F.col("wins"), F.when(F.col("w1"), TAKEN[0]).when(F.col("w2"), TAKEN[1]))
        left = F.col("open") & ~F.col("wins") & ~F.col("w1") & ~F.col("w2")
        rows = staged(rows.select(*requests.columns, "place", F.coalesce("reason", lost).alias("reason"), left.alias("open")), "registrations")
    left = rows.where("open").select("place", "name", "model_id", "version")
    if left.isEmpty():
        return rows.drop("open", "place")
    first = [left.select(F.col("place").alias("u"), F.min("place").over(Window.partitionBy(by, "version")).alias("v")) for by in ("name", "model_id")]
    found = components(first[0].union(first[1]), "clashes")
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    grouped = left.join(found, F.col("place") == F.col("node"), "left").withColumn("root", F.coalesce("root", "place")).groupBy("root")
    decided = grouped.applyInPandas(_one_by_one, f"place {kinds['place']}, decided string").withColumnRenamed("place", "__p")
    return rows.join(decided, F.col("place") == F.col("__p"), "left").withColumn("reason", F.coalesce("reason", "decided")).select(*requests.columns, "reason")


def create(models: DataFrame, rows: DataFrame) -> DataFrame:
    """models with rows added whose (model_id, version) and (name, version) it does not have yet."""
    new = rows.join(models.select("model_id", "version"), ["model_id", "version"], "left_anti").join(models.select("name", "version"), ["name", "version"], "left_anti")
    return models.unionByName(new.select(*models.columns))


def update(models: DataFrame, changes: DataFrame) -> DataFrame:
    """models with name replaced from changes(model_id, version, new_name). Of changes that repeat a key the least name counts."""
    changes = changes.groupBy("model_id", "version").agg(F.min("new_name").alias("new_name"))
    return models.join(changes, ["model_id", "version"], "left").withColumn("name", F.coalesce("new_name", "name")).select(*models.columns)


def delete(models: DataFrame, ids: DataFrame) -> DataFrame:
    return models.join(ids.select("model_id"), "model_id", "left_anti")
