"""Small text and number expressions of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(seconds: Column) -> Column:
    """Epoch seconds as ISO-8601 with milliseconds, in UTC (the session's zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def per(a: Column, b: Column) -> Column:
    """a / b, rounded; a null or zero b counts as 1."""
    return round_half_up(a / F.coalesce(F.nullif(b, F.lit(0)), F.lit(1)))


def short(hash_: Column) -> Column:
    return F.substring(hash_, 1, 16)


def pad_root(text: Column) -> Column:
    """Hex digits filled up with zeros to 32 bytes, with 0x before them."""
    return F.concat(F.lit("0x"), F.rpad(F.regexp_replace(text, "^0x", ""), 64, "0"))


def type_label(type_: Column) -> Column:
    return F.when(type_ == "model_registration", "Registration").otherwise("Inference")


def has_id(text: Column) -> Column:
    """Whether a text holds more than white space, as a searched id must."""
    return F.coalesce(F.trim(text) != "", F.lit(False))
