"""Buckets of numbers, by their least member. Null (no number) has no bucket."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def power_of_two(x: Column) -> Column:
    """0, 1, 2, 4, 8, ...: 0 holds all below 1."""
    return F.when(x < 1, F.lit(0).cast("long")).when(x.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.floor(x))) - 1))


def linear(x: Column, step: int) -> Column:
    return (F.floor(x / F.lit(step)) * step).cast("long")


def bucket(x: Column, aggr: str, step: int | None) -> Column:
    return power_of_two(x) if aggr == "quantize" else linear(x, step)


def ordinal(least: Column, aggr: str, step: int | None) -> Column:
    """The place of a bucket in order, from 0."""
    return F.when(least <= 0, F.lit(0).cast("long")).otherwise(F.length(F.bin(least)).cast("long")) if aggr == "quantize" else F.floor(least / F.lit(step)).cast("long")


def least_of(ordinal_: Column, aggr: str, step: int | None) -> Column:
    return F.when(ordinal_ <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (ordinal_ - 1).cast("int"))) if aggr == "quantize" else (ordinal_ * step).cast("long")


def iso(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO 8601 text in UTC, whatever the session's zone."""
    day, rest = F.floor(seconds / 86_400).cast("int"), F.pmod(seconds, F.lit(86_400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), two(rest / 3600), F.lit(":"), two(F.pmod(rest, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit(".000Z"))
