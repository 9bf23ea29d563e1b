"""Scans: a query over records, as one filtered and grouped frame.

The order is fixed: datasource filter, user filter, date columns, time bounds, aggregate. What falls out on the way has a
reason; ``classify`` names it for each row, ``scan`` only drops it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.bucket import bucket
from ..functions.predicate import any_missing, both, compile_filter
from ..plans.model import Breakdown, Datasource, Query
from ..sources.readers import Source, read

#: Why a record does not count, in the order in which it is looked at.
REASONS = ("invalid json", "nfailedeval", "nfilteredout", "undef", "baddate", "time bounds", "nonnumeric")


@dataclass(frozen=True)
class Plan:
    """The columns of a compiled query: keys by name, and for each reason what a row must not be."""

    source: Source
    keys: dict[str, Column]
    reasons: dict[str, Column]

    @property
    def value(self) -> Column:
        return F.col("__dn_value" if "__dn_value" in self.source.df.columns else "value")


def _key(fields, b: Breakdown) -> tuple[Column, Column | None, Column | None]:
    """(key, no date at all, no usable value); the last two where they can be."""
    f = fields[b.field if b.date else b.name]
    if b.date:
        key = f.seconds if b.aggr is None else bucket(f.seconds, b.aggr, b.step)
        return (key if b.aggr else key.cast("string")), f.missing, f.seconds.isNull()
    if b.aggr:
        return bucket(f.number, b.aggr, b.step), None, f.number.isNull()
    return f.key, None, None


def plan(source: Source, query: Query, time_field: str | None = None, ds_filter: dict | None = None) -> Plan:
    fields, no = source.fields, F.lit(False)
    keys, undef, baddate, nonnumeric = {}, [], [], []
    for b in query.breakdowns:
        keys[b.name], missing, unusable = _key(fields, b)
        undef += [missing] if missing is not None else []
        (baddate if b.date else nonnumeric).extend([unusable] if unusable is not None else [])
    outside = no
    if query.seconds is not None:
        t = fields[time_field]
        undef.append(t.missing)
        baddate.append(t.seconds.isNull())
        outside = ~t.within(*query.seconds)
    p = both(ds_filter, query.filter)
    either = lambda cs: reduce(lambda a, b: a | b, cs, no)
    reasons = dict(zip(REASONS, (source.invalid, any_missing(p, fields), ~compile_filter(p, fields), either(undef), either(baddate), outside, either(nonnumeric)), strict=True))
    return Plan(source, keys, reasons)


def classify(p: Plan) -> DataFrame:
    """The rows with ``reason``: null for those that count."""
    reason = F.lit(None).cast("string")
    for name in reversed(REASONS):
        reason = F.when(F.coalesce(p.reasons[name], F.lit(True)), name).otherwise(reason)
    return p.source.df.withColumn("reason", reason)


def kept(p: Plan) -> DataFrame:
    """The rows that count."""
    df = p.source.df
    for c in p.reasons.values():
        df = df.filter(~c)
    return df


def aggregate(df: DataFrame, keys: dict[str, Column], value: Column) -> DataFrame:
    """Sums of value by the keys; without keys one row, 0 where there is nothing."""
    if not keys:
        return df.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("value"))
    return df.groupBy(*(c.alias(n) for n, c in keys.items())).agg(F.sum(value).cast("long").alias("value"))


def scan_source(source: Source, query: Query, time_field: str | None = None, ds_filter: dict | None = None) -> DataFrame:
    p = plan(source, query, time_field, ds_filter)
    return aggregate(kept(p), p.keys, p.value)


def scan(spark: SparkSession, ds: Datasource, query: Query, warn=None, watch: Callable[[Source], Source] = lambda x: x) -> DataFrame:
    """The query's result over the datasource's raw data: its breakdowns and value. ``watch`` may put counters on what is read."""
    return scan_source(watch(read(spark, ds, query, warn)), query, ds.time_field, ds.filter)


def _counts() -> list[Column]:
    named = [F.count_if(F.col("reason") == r).alias(r.replace(" ", "_")) for r in REASONS]
    return [F.count("*").alias("ninputs"), F.count_if(F.col("reason").isNull()).alias("noutputs"), *named]


def drop_counters(source: Source, query: Query, time_field: str | None = None, ds_filter: dict | None = None) -> DataFrame:
    """One row: ninputs, noutputs, and how many rows each reason took."""
    return classify(plan(source, query, time_field, ds_filter)).agg(*_counts())


def observed(source: Source, observation: Observation, query: Query, time_field: str | None = None, ds_filter: dict | None = None) -> Source:
    """The source, whose records are counted as ``drop_counters`` does by whatever job reads them."""
    rows = classify(plan(source, query, time_field, ds_filter)).observe(observation, *_counts())
    return replace(source, df=rows.drop("reason"))


def rejects(source: Source, query: Query, time_field: str | None = None, ds_filter: dict | None = None) -> DataFrame:
    """The rows that do not count, with ``reason``."""
    return classify(plan(source, query, time_field, ds_filter)).filter("reason is not null")


def to_points(result: DataFrame) -> DataFrame:
    """A result as weighted points, one JSON object a row: what reads as format json-skinner."""
    names = [c for c in result.columns if c != "value"]
    fields = F.struct(*(F.col(f"`{n}`") for n in names)) if names else F.struct()
    body = F.to_json(fields) if names else F.lit("{}")
    return result.select(F.concat(F.lit('{"fields":'), body, F.lit(',"value":'), F.col("value").cast("string"), F.lit("}")).alias("value"))


def with_breakdowns(query: Query, *more: Breakdown) -> Query:
    return replace(query, breakdowns=(*more, *query.breakdowns))
