"""Audit checks: drifting outputs, suspicious agents, odd records, unknown models, links of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drift(inferences: DataFrame, key: str = "input_hash", out: str = "output_hash") -> DataFrame:
    """(model_id, key, outputs, inferences) where one model gave several outputs for one input."""
    found = inferences.groupBy("model_id", key).agg(F.countDistinct(out).alias("outputs"), F.count("*").alias("inferences"))
    return found.where("outputs > 1")


def suspicious_agents(events: DataFrame, actions: int = 3, cost: float = 0.0) -> DataFrame:
    """(agent_id, repeated_inputs, actions, total_cost): agents with inputs that got several outputs in at least `actions` cases, and
    whose actions cost more than `cost` in all."""
    pairs = events.groupBy("agent_id", "input").agg(F.countDistinct("output").alias("outputs"), F.count("*").alias("n"), F.sum(F.col("cost").cast("decimal(18,2)")).alias("c"))
    agents = pairs.groupBy("agent_id").agg(F.count_if(F.col("outputs") > 1).alias("repeated_inputs"), F.sum("n").alias("actions"), F.sum("c").cast("double").alias("total_cost"))
    return agents.where((F.col("repeated_inputs") >= actions) & (F.col("total_cost") > cost))


def weird(events: DataFrame, models: DataFrame, now: int) -> DataFrame:
    """(event_id, missing, future, unknown) of events with a fault: no model, a time after now, or a model that nobody registered."""
    known = models.select("model_id").distinct().withColumn("known", F.lit(True))
    rows = events.join(known, "model_id", "left").select("event_id", F.col("model_id").isNull().alias("missing"), (F.col("ts") > now).alias("future"), (F.col("model_id").isNotNull() & F.col("known").isNull()).alias("unknown"))
    return rows.where("missing or future or unknown")


def unknown_models(events: DataFrame, models: DataFrame) -> DataFrame:
    lost = events.where("model_id is not null").join(models.select("model_id"), "model_id", "left_anti")
    return lost.groupBy("model_id").agg(F.count("*").alias("events"))


def linked(actions: DataFrame, inferences: DataFrame) -> DataFrame:
    """actions(action_id, inference_ids: array) with the model of each inference they name; null for one that is not there."""
    ids = actions.select("action_id", F.explode("inference_ids").alias("inference_id"))
    return ids.join(inferences.select("inference_id", "model_id"), "inference_id", "left")
