"""Cubes: metrics of a datasource, aggregated ahead and stored by time.

One scan feeds all metrics. Each record becomes a row for each metric that counts it: the metric's number, the bucket of
time, and the metric's keys; one aggregate with a partial sum in each task makes the cube. It is stored as Parquet, in
folders by bucket, whose rows name their metric by a digest of its definition. So a query reads its time range and its metric's
columns alone, and a bucket says which metrics it holds. Building again replaces the buckets that have data, whatever metrics
they held, and leaves the others. Each bucket answers with the first metric in it that can; one without any adds nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bucket import bucket, iso
from ..functions.fields import Stored
from ..functions.predicate import compile_filter
from ..plans.model import Datasource, EngineError, Metric, Query
from ..plans.select import Choice, choices
from ..sources.paths import existing, read_text, write_text
from ..sources.readers import Source, read
from .scan import aggregate, kept, plan

#: How many seconds a stored bucket spans; all: one bucket for everything.
INTERVALS = {"all": None, "hour": 3600, "day": 86400}
MANIFEST_VERSION = "3.0.0"


def root(index_path: str, interval: str) -> str:
    if interval not in INTERVALS:
        raise EngineError(f'unsupported interval: "{interval}"')
    return f"{index_path.rstrip('/')}/{'all' if interval == 'all' else f'by_{interval}'}"


def manifest(ds: Datasource, metrics: list[Metric]) -> dict:
    return {"version": MANIFEST_VERSION, "datasource": ds.name, "metrics": [m.to_json() for m in metrics]}


def digest(m: Metric) -> str:
    """What a metric's rows are stored under: equal for equal definitions alone."""
    return hashlib.sha256(json.dumps(m.to_json(), sort_keys=True).encode()).hexdigest()[:16]


def load_manifest(spark: SparkSession, index_path: str, interval: str) -> list[Metric]:
    text = read_text(spark, f"{root(index_path, interval)}/manifest.json")
    if text is None:
        raise EngineError(f'no index at "{root(index_path, interval)}"')
    found = json.loads(text)
    if found.get("version", "").split(".")[0] != MANIFEST_VERSION.split(".")[0]:
        raise EngineError(f"unsupported index version: {found.get('version')}")
    return [Metric.from_json(m) for m in found["metrics"]]


def tagged_points(source: Source, metrics: list[Metric], interval: str, time_field: str | None = None, ds_filter: dict | None = None, bounds: Query | None = None) -> DataFrame:
    """The map side of a build: __dn_metric, __dn_ts (text of the bucket's start, or 'all'), k0, k1, ..., value."""
    root("", interval)  # or an error
    step = INTERVALS[interval]
    if step and not time_field:
        raise EngineError('datasource is missing "timefield" for an index by time')
    everything = plan(source, replace(bounds or Query(), filter=None, breakdowns=()), time_field, ds_filter)
    wanted = kept(everything)  # what no metric counts never leaves the scan
    if all(m.filter for m in metrics) and metrics:
        wanted = wanted.filter(reduce(lambda a, b: a | b, (compile_filter(m.filter, source.fields) for m in metrics)))
    width, rows, value = max([len(m.breakdowns) for m in metrics], default=0), [], F.lit(1)
    for number, m in enumerate(metrics):
        p = plan(source, replace(bounds or Query(), filter=m.filter, breakdowns=m.breakdowns), time_field, ds_filter)
        value, counts = p.value, F.lit(True)
        for c in p.reasons.values():
            counts = counts & ~c
        at = F.lit("all")
        if step:
            seconds = source.fields[time_field].seconds
            counts, at = counts & seconds.isNotNull(), iso(bucket(seconds, "lquantize", step))
        keys = [c.cast("string") for c in p.keys.values()] + [F.lit(None).cast("string")] * (width - len(p.keys))
        row = F.struct(F.lit(number).alias("__dn_metric"), at.alias("__dn_ts"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
        rows.append(F.when(F.coalesce(counts, F.lit(False)), row))
    tagged = wanted.select(value.alias("value"), F.explode(F.array_compact(F.array(*rows))).alias("p")).select("p.*", "value")
    return tagged.groupBy(*(c for c in tagged.columns if c != "value")).agg(F.sum("value").cast("long").alias("value"))


def by_bucket(tagged: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Tagged points as they are stored: dn_metric (digest), dn_bucket (no colons, which are no good in folder names), keys and value."""
    names = F.array(*(F.lit(digest(m)) for m in metrics))
    bucket_ = F.replace(F.substring("__dn_ts", 1, 13), F.lit(":"), F.lit("-"))
    return tagged.withColumn("dn_metric", names[F.col("__dn_metric")]).withColumn("dn_bucket", bucket_).drop("__dn_metric", "__dn_ts")


def store(rows: DataFrame, ds: Datasource, metrics: list[Metric], interval: str) -> None:
    """Replace the buckets of ``rows``, and say what metrics there are; large buckets are dealt out to several tasks."""
    spark, to = rows.sparkSession, root(ds.index_path, interval)
    rows.hint("rebalance", "dn_bucket").sortWithinPartitions("dn_bucket", "dn_metric").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dn_bucket").parquet(f"{to}/data")
    text, new = read_text(spark, f"{to}/manifest.json"), {digest(m) for m in metrics}
    older = [m for m in load_manifest(spark, ds.index_path, interval) if digest(m) not in new] if text else []
    write_text(spark, f"{to}/manifest.json", json.dumps(manifest(ds, [*metrics, *older]), indent=1))


def write_points(tagged: DataFrame, ds: Datasource, metrics: list[Metric], interval: str) -> None:
    """The reduce side of a build: store tagged points, and say what they are."""
    store(by_bucket(tagged, metrics), ds, metrics, interval)


def build(spark: SparkSession, ds: Datasource, metrics: list[Metric], interval: str = "day", bounds: Query | None = None, watch: Callable[[Source], Source] = lambda x: x) -> None:
    """``watch`` may put counters on what is read."""
    if not ds.index_path:
        raise EngineError(f'datasource "{ds.name}" has no "indexpath"')
    source = watch(read(spark, ds, bounds or Query()))
    write_points(tagged_points(source, metrics, interval, ds.time_field, ds.filter, bounds), ds, metrics, interval)


def stored_at(spark: SparkSession, where: str, width: int, *more: str) -> DataFrame:
    """Stored rows, none where there is no such folder."""
    schema = ", ".join([*(f"k{i} string" for i in range(width)), "value long", *more, "dn_metric string", "dn_bucket string"])
    if not existing(spark, [where]):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", where).parquet(where)


def width_of(metrics: list[Metric]) -> int:
    return max([len(m.breakdowns) for m in metrics], default=0)


def in_bounds(cube: DataFrame, query: Query, interval: str) -> DataFrame:
    """Without the folders that are outside the query's bounds, which are not read."""
    step = INTERVALS[interval]
    if query.seconds is None or not step:
        return cube
    after, before = query.seconds
    text = lambda s: F.substring(iso(F.lit(s)), 1, 13)
    return cube.filter((F.col("dn_bucket") >= text(after // step * step)) & (F.col("dn_bucket") <= text(max(after, before - 1) // step * step)))


def _answer(own: DataFrame, choice: Choice, query: Query) -> tuple[DataFrame, dict]:
    """The rows of one metric that count, and the query's keys. A stored bucket counts if its start is within the bounds."""
    names = {b.name: F.col(f"k{i}") for i, b in enumerate(choice.metric.breakdowns)}
    if query.seconds is not None:
        after, before = query.seconds
        t = names[choice.time_column.name].cast("long")
        own = own.filter((t >= after) & (t < before))
    fields = Stored(names)
    if choice.apply_filter and query.filter:
        own = own.filter(compile_filter(query.filter, fields))
    keys = {}
    for b in query.breakdowns:
        keys[b.name] = bucket(fields[b.name].number, b.aggr, b.step) if b.aggr else names[b.name]
        own = own.filter(keys[b.name].isNotNull())
    return own, keys


def query_frame(cube: DataFrame, able: list[Choice], query: Query, interval: str, watch: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """A query over a cube's frame, by the metrics that are able to answer it, the best first."""
    names = [digest(c.metric) for c in able]
    rows = watch(in_bounds(cube, query, interval).filter(F.col("dn_metric").isin(names)))
    if len(able) == 1:
        return aggregate(*_answer(rows, able[0], query), F.col("value"))
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("dn_metric"))
    best = rows.groupBy(F.col("dn_bucket").alias("at")).agg(F.min(rank).alias("best"))
    rows = rows.join(best, (F.col("dn_bucket") == F.col("at")) & (rank == F.col("best")))
    parts = []
    for name, choice in zip(names, able, strict=True):
        own, keys = _answer(rows.filter(F.col("dn_metric") == name), choice, query)
        parts.append(own.select(*(c.alias(f"k{i}") for i, c in enumerate(keys.values())), "value"))
    keys = {b.name: F.col(f"k{i}") for i, b in enumerate(query.breakdowns)}
    return aggregate(reduce(DataFrame.unionAll, parts), keys, F.col("value"))


def _asked(spark: SparkSession, ds: Datasource, q: Query, interval: str) -> tuple[list[Metric], DataFrame]:
    """The metrics that there are, and all stored rows."""
    if not ds.index_path:
        raise EngineError(f'datasource "{ds.name}" has no "indexpath"')
    if q.after is not None and not ds.time_field:
        raise EngineError('datasource is missing "timefield" for "before" and "after" constraints')
    metrics = load_manifest(spark, ds.index_path, interval)
    return metrics, stored_at(spark, f"{root(ds.index_path, interval)}/data", width_of(metrics))


def query(spark: SparkSession, ds: Datasource, q: Query, interval: str = "day", exact: bool = False, watch: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """The query's result from the datasource's cubes. ``watch`` may put counters on the stored rows that are read."""
    metrics, cube = _asked(spark, ds, q, interval)
    return query_frame(cube, choices(metrics, q, exact), q, interval, watch)


def files_of(spark: SparkSession, ds: Datasource, q: Query, interval: str = "day") -> list[str]:
    """The stored files that a query reads."""
    metrics, cube = _asked(spark, ds, q, interval)
    choices(metrics, q)
    if not existing(spark, [f"{root(ds.index_path, interval)}/data"]):
        return []
    return sorted(r[0] for r in in_bounds(cube, q, interval).select("_metadata.file_path").distinct().toLocalIterator())
