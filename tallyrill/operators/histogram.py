"""Dense distributions: every bucket between a group's first and one past its last, empty ones too."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bucket import least_of, ordinal
from ..plans.model import Breakdown

BAR = 40
#: A distribution begins at bucket 0, unless its first bucket is beyond this one.
FAR = 100


def dense(result: DataFrame, last: Breakdown, by: list[str]) -> DataFrame:
    """From a result: the columns of ``by``, bucket (its least member), value, and bar (40 for all of a group)."""
    at = ordinal(F.col(f"`{last.name}`"), last.aggr, last.step)
    named = [F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(by)]
    groups = [f"g{i}" for i in range(len(by))]
    rows = result.select(*named, at.alias("o"), "value")
    span = rows.groupBy(*groups).agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("hi is not null")
    grid = span.select(*groups, F.explode(F.sequence(F.when(F.col("lo") > FAR, F.col("lo")).otherwise(F.lit(0).cast("long")), F.col("hi") + 1)).alias("o"))
    full = grid.join(rows, [*groups, "o"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    total = F.sum("value").over(Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0)))
    bar = F.coalesce(F.floor(F.lit(BAR) * F.col("value") / total + 0.5), F.lit(0)).cast("int")
    return full.select(*(F.col(g).alias(c) for g, c in zip(groups, by, strict=True)), least_of(F.col("o"), last.aggr, last.step).alias("bucket"), "value", bar.alias("bar"))
