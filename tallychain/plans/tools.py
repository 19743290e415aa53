"""Questions by name over stored tables, for callers that have a name and arguments, such as an agent."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.operators import audit, chain, lookups


class Stored(NamedTuple):
    """The tables that questions read: blocks with their payload's fields, models, and agents' events."""

    blocks: DataFrame
    models: DataFrame
    events: DataFrame


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "healthcheck": lambda s: s.blocks.agg(F.lit("ok").alias("status"), (F.count("*") - 1).alias("height")),
    "verify_chain": lambda s, mode="writer": chain.verify(s.blocks, mode),
    "list_models": lambda s: lookups.recent_models(s.models),
    "list_events": lambda s: s.events,
    "provenance_by_model": lambda s, model_id: lookups.report(s.blocks, s.models.where(F.col("model_id") == model_id)),
    "get_block": lambda s, index: lookups.by_index(s.blocks, index),
    "audit_inference": lambda s: audit.drift(s.blocks.where("type = 'inference'")),
}


def call(name: str, stored: Stored, **arguments) -> DataFrame:
    """The answer of a tool; a name that no tool has is an error that names them."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name!r}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](stored, **arguments)
