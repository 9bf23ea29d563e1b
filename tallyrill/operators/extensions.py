"""What users have asked for on top of counts: the largest groups, ratios, names for ids, and classes of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top(result: DataFrame, n: int) -> DataFrame:
    """The n largest values; ties in the order of the other columns. No full sort: each task keeps n rows."""
    return result.orderBy(F.desc("value"), *(F.col(f"`{c}`") for c in result.columns if c != "value")).limit(n)


def ratio(part: DataFrame, whole: DataFrame, by: list[str]) -> DataFrame:
    """The share of two results of the same breakdowns: by, part, whole, ratio. Groups without a part have 0."""
    a = part.select(*by, F.col("value").alias("part"))
    both = whole.select(*by, F.col("value").alias("whole")).join(a, by, "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    return both.withColumn("ratio", F.when(F.col("whole") != 0, F.col("part") / F.col("whole")))


def name_ids(result: DataFrame, column: str, names: DataFrame, key: str, name: str) -> DataFrame:
    """Ids replaced by their names (unknown ones stay), and the values of equal names summed. Adaptive execution picks the join."""
    known = names.select(F.col(key).cast("string").alias("__id"), F.col(name).alias("__name"))
    out = result.join(known, F.col(f"`{column}`") == F.col("__id"), "left").withColumn(column, F.coalesce("__name", f"`{column}`"))
    return out.groupBy(*(c for c in result.columns if c != "value")).agg(F.sum("value").cast("long").alias("value"))


def classes(value: Column, cases: dict[str, tuple[float, float]], other: str = "other") -> Column:
    """The name of the first range [low, high) that holds a number."""
    out = F.lit(other)
    for name, (low, high) in reversed(cases.items()):
        out = F.when((value >= low) & (value < high), name).otherwise(out)
    return out
