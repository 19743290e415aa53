"""Payloads as VARIANT: nested fields are filtered and read without parsing texts again, and every path of a payload is listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.session import staged

#: Settings with which Spark writes the fields of a variant as columns of their own and reads only those that a query asks for.
SHREDDING = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true", "spark.sql.variant.pushVariantIntoScan": "true"}


def with_payload(rows: DataFrame, text: str = "data", name: str = "payload") -> DataFrame:
    """rows with column `name`: the JSON text as a variant; null where it is null or no JSON, or has a key twice."""
    return rows.withColumn(name, F.try_parse_json(text))


def field(path: str, kind: str = "string", payload: str = "payload") -> Column:
    """The value at a path such as $.params.k or $.tags[0] of a payload; null where there is none or it is not of that kind."""
    return F.try_variant_get(payload, path, kind)


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows with their payload as Parquet; in a session with SHREDDING its fields are columns of the files."""
    rows.write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """What write wrote, with columns as a schema in DDL, such as 'block_index long, payload variant'."""
    return spark.read.schema(columns).parquet(path)


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def paths(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(path, kind, values): every path below the root in any payload, elements of arrays as [], with the number of values of each kind; a null in a
    payload is of kind VOID. A key that is no plain name is quoted. Null payloads and payloads without parts have no paths.

    One pass for each level of nesting; a level's containers are staged for the next, and values are counted by path before they move.
    """
    spark = rows.sparkSession
    level, found = rows.select(F.lit("$").alias("path"), F.col(payload).alias("value")).where(F.col("value").isNotNull()), []
    while True:
        parts = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "part"))
        named = F.when(F.col("key").rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit('["'), "key", F.lit('"]')))
        step = F.when(F.col("key").isNull(), "[]").otherwise(named)
        level = staged(parts.select(F.concat("path", step).alias("path"), F.col("part").alias("value"), _kind(F.col("part")).alias("kind")), "paths")
        found.append(level.groupBy("path", "kind").agg(F.count("*").alias("values")))
        level = level.where(F.col("kind").isin("OBJECT", "ARRAY")).select("path", "value")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)
