"""The registered queries, over the driver's tables, each with DuckDB SQL for the same rows.

``events`` is the event log: its ``value`` is called latency here, as a result's own column is called value.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bucket import iso
from .operators import cube, extensions
from .operators.histogram import dense
from .operators.scan import drop_counters, scan_source, to_points
from .plans.model import Datasource, Metric, Query
from .plans.parse import parse_breakdowns
from .sources.paths import enumerate_paths
from .sources.readers import json_lines, points, typed
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def scratch(spark: SparkSession) -> str:
    """A folder of its own in what driver and executors share; a temporary one only where nothing is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="tallyrill-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/tallyrill-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("value", "latency")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _scan(df: DataFrame, breakdowns: str = "", filter: dict | None = None, ds_filter: dict | None = None, **bounds) -> DataFrame:
    return scan_source(typed(df), Query.parse(filter, breakdowns, **bounds), "ts", ds_filter)


_P2 = "CASE WHEN {0} < 1 THEN 0 ELSE 1::BIGINT << (length(bin(floor({0})::BIGINT)) - 1) END::BIGINT"
_TS = "(epoch_us(ts) // 1000000)"
_N = "count(*)::BIGINT AS value"


def _shape(name: str, sql: str, table: Callable = events, **query) -> None:
    """Register a plain scan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scan(table(spark, sf_dir), **query)

    run.__name__ = name
    _register(sql)(run)


_shape("count_all", f"SELECT {_N} FROM events")
_shape("count_empty", f"SELECT {_N} FROM events WHERE event_type = 'nothing'", filter={"eq": ["event_type", "nothing"]})
_shape("breakdown_empty", f"SELECT event_type, {_N} FROM events WHERE event_type = 'nothing' GROUP BY 1", filter={"eq": ["event_type", "nothing"]}, breakdowns="event_type")
_shape("breakdown_1", f"SELECT event_type, {_N} FROM events GROUP BY 1", breakdowns="event_type")
_shape("breakdown_2", f"SELECT event_type, user_id::VARCHAR AS user_id, {_N} FROM events GROUP BY 1, 2", breakdowns="event_type,user_id")
for _op, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _shape(f"filter_{_op}", f"SELECT l_returnflag, {_N} FROM lineitem WHERE l_quantity {_sign} 25 GROUP BY 1", table=lineitem, filter={_op: ["l_quantity", 25]}, breakdowns="l_returnflag")
_shape("filter_text", f"SELECT {_N} FROM events WHERE event_type = 'click'", filter={"eq": ["event_type", "click"]})
_shape(
    "filter_and_or",
    f"SELECT event_type, {_N} FROM events WHERE (value >= 50 OR event_type = 'click') AND user_id < 500 GROUP BY 1",
    filter={"and": [{"or": [{"ge": ["latency", 50]}, {"eq": ["event_type", "click"]}]}, {"lt": ["user_id", 500]}]},
    breakdowns="event_type",
)
_shape("filter_empty", f"SELECT {_N} FROM events", filter={})
_shape("filter_loose_eq", f"SELECT {_N} FROM events WHERE json_extract_string(props, '$.k')::DOUBLE = 69", filter={"eq": ["props.k", "69"]})
_shape("filter_missing_field", f"SELECT {_N} FROM events WHERE json_extract_string(props, '$.nowhere') <> 'x'", filter={"ne": ["props.nowhere", "x"]})
_shape("json_breakdown", f"SELECT json_extract_string(props, '$.k') AS \"props.k\", {_N} FROM events GROUP BY 1", breakdowns="props.k")
_shape("quantize", f"SELECT {_P2.format('value')} AS latency, {_N} FROM events GROUP BY 1", breakdowns="latency[aggr=quantize]")
_shape("lquantize", f"SELECT (floor(value / 50) * 50)::BIGINT AS latency, {_N} FROM events GROUP BY 1", breakdowns="latency[aggr=lquantize,step=50]")
_shape("quantize_then_discrete", f"SELECT {_P2.format('l_extendedprice')} AS l_extendedprice, l_returnflag, {_N} FROM lineitem GROUP BY 1, 2", table=lineitem, breakdowns="l_extendedprice[aggr=quantize],l_returnflag")
_shape("discrete_then_quantize", f"SELECT l_returnflag, l_linestatus, {_P2.format('l_extendedprice')} AS l_extendedprice, {_N} FROM lineitem GROUP BY 1, 2, 3", table=lineitem, breakdowns="l_returnflag,l_linestatus,l_extendedprice[aggr=quantize]")
for _name, _step in (("date_day", 86400), ("date_hour", 3600), ("date_minute", 60)):
    _shape(_name, f"SELECT {_TS} // {_step} * {_step} AS t, {_N} FROM events GROUP BY 1", breakdowns=f"t[date,field=ts,aggr=lquantize,step={_step}]")
_shape("date_discrete", f"SELECT {_TS}::VARCHAR AS ts, {_N} FROM events GROUP BY 1", breakdowns="ts[date]")
_shape("time_bounds", f"SELECT event_type, {_N} FROM events WHERE {_TS} >= epoch(TIMESTAMP '2024-01-05') AND {_TS} < epoch(TIMESTAMP '2024-01-12') GROUP BY 1", breakdowns="event_type", after="2024-01-05", before="2024-01-12")
_shape("time_bounds_fractional", f"SELECT {_N} FROM events WHERE {_TS} >= epoch(TIMESTAMP '2024-01-05 01:02:04') AND {_TS} < epoch(TIMESTAMP '2024-01-12 00:00:01')", after="2024-01-05T01:02:03.004", before="2024-01-12T00:00:00.500Z")
_shape("ds_filter_and_user_filter", f"SELECT user_id::VARCHAR AS user_id, {_N} FROM events WHERE event_type = 'click' AND value < 100 GROUP BY 1", ds_filter={"eq": ["event_type", "click"]}, filter={"lt": ["latency", 100]}, breakdowns="user_id")


def _json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as JSON lines: nested, with nulls, gaps, bad dates and broken lines in turn."""
    e, n = events(spark, sf_dir), F.pmod(F.col("event_id"), F.lit(10))
    time = F.when(n == 8, "never").when(n != 9, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    caller = F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, "").when(F.pmod(F.col("event_id"), F.lit(3)) == 1, '"caller":null,').otherwise('"caller":"x",')
    body = F.concat(F.lit('{"req":{'), caller, F.lit('"method":"'), F.col("event_type"), F.lit('"},"latency":'), F.when(n == 7, F.concat(F.lit('"'), F.col("latency").cast("string"), F.lit('"'))).otherwise(F.col("latency").cast("string")), F.when(time.isNull(), "").otherwise(F.concat(F.lit(',"time":"'), time, F.lit('"'))), F.lit("}"))
    return e.select(F.when(n == 6, F.concat(F.lit("oops "), body)).otherwise(body).alias("value"))


_GOOD = "event_id % 10 <> 6"


@_register(f"SELECT CASE event_id % 3 WHEN 0 THEN 'undefined' WHEN 1 THEN 'null' ELSE 'x' END AS \"req.caller\", {_N} FROM events WHERE {_GOOD} GROUP BY 1")
def null_vs_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_source(json_lines(_json_events(spark, sf_dir)), Query.parse(None, "req.caller"))


@_register(f"SELECT event_type AS \"req.method\", {_P2.format('value')} AS latency, {_N} FROM events WHERE {_GOOD} AND event_id % 10 <> 7 AND value < 200 GROUP BY 1, 2")
def json_filter_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_source(json_lines(_json_events(spark, sf_dir)), Query.parse({"lt": ["latency", 200]}, "req.method,latency[aggr=quantize]"))


@_register(f"SELECT (epoch(o_orderdate)::BIGINT // 86400 * 86400)::BIGINT AS day, {_N} FROM orders WHERE o_orderkey % 7 > 1 GROUP BY 1")
def date_parse_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, n = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.pmod(F.col("o_orderkey"), F.lit(7))
    text = F.when(n == 0, F.lit("bogus")).when(n == 1, F.lit(None)).when(n == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n == 3, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return _scan(orders.select(text.alias("placed")), "day[date,field=placed,aggr=lquantize,step=86400]")


@_register(f"SELECT event_type, (3 * count(*))::BIGINT AS value FROM events GROUP BY 1")
def weighted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = to_points(_scan(events(spark, sf_dir), "event_type,user_id"))
    return scan_source(points(once.unionAll(once).unionAll(once)), Query.parse(None, "event_type"))


@_register(f"SELECT event_type, {_P2.format('value')} AS latency, {_N} FROM events GROUP BY 1, 2")
def points_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = Query.parse(None, "event_type,latency[aggr=quantize]")
    return scan_source(points(to_points(scan_source(typed(events(spark, sf_dir)), shape))), shape)


def _cubed(spark: SparkSession, sf_dir: str, interval: str, metrics: list[tuple], query: Query, **how) -> DataFrame:
    """Build a cube of metrics (filter, breakdowns) over the events, and query it."""
    ds = Datasource("events", "-", index_path=scratch(spark), time_field="ts", data_format="parquet")
    own = [Metric(f"m{i}", "events", p, tuple(parse_breakdowns(b))) for i, (p, b) in enumerate(metrics)]
    cube.write_points(cube.tagged_points(typed(events(spark, sf_dir)), own, interval, "ts"), ds, own, interval)
    return cube.query(spark, ds, query, interval, **how)


_DAY = "ts[date,aggr=lquantize,step=86400]"
for _interval in ("all", "day", "hour"):

    def _cube(spark: SparkSession, sf_dir: str, interval=_interval) -> DataFrame:
        return _cubed(spark, sf_dir, interval, [(None, "event_type,latency[aggr=quantize]")], Query.parse({"ne": ["event_type", "view"]}, "event_type,latency[aggr=quantize]"))

    _cube.__name__ = f"cube_{_interval}"
    _register(f"SELECT event_type, {_P2.format('value')} AS latency, {_N} FROM events WHERE event_type <> 'view' GROUP BY 1, 2")(_cube)


@_register(f"SELECT (floor(({_P2.format('value')}) / 100) * 100)::BIGINT AS latency, {_N} FROM events GROUP BY 1")
def cube_rebucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cubed(spark, sf_dir, "all", [(None, "latency[aggr=quantize]")], Query.parse(None, "latency[aggr=lquantize,step=100]"))


@_register(f"SELECT (floor(value / 100) * 100)::BIGINT AS latency, {_N} FROM events GROUP BY 1")
def cube_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = [(None, "latency[aggr=quantize]"), (None, "latency[aggr=lquantize,step=50]")]
    return _cubed(spark, sf_dir, "all", metrics, Query.parse(None, "latency[aggr=lquantize,step=100]"), exact=True)


@_register(f"SELECT user_id::VARCHAR AS user_id, {_N} FROM events WHERE event_type = 'click' GROUP BY 1")
def cube_filtered_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = {"eq": ["event_type", "click"]}
    return _cubed(spark, sf_dir, "day", [({"eq": ["event_type", "view"]}, "user_id"), (click, "user_id")], Query.parse(click, "user_id"))


@_register(f"SELECT event_type, {_N} FROM events WHERE {_TS} // 86400 * 86400 >= epoch(TIMESTAMP '2024-01-05') AND {_TS} // 86400 * 86400 < epoch(TIMESTAMP '2024-01-12 12:00:00') GROUP BY 1")
def cube_time_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cubed(spark, sf_dir, "day", [(None, f"{_DAY},event_type")], Query.parse(None, "event_type", after="2024-01-05", before="2024-01-12T12:00:00"))


def _rebuilt(spark: SparkSession, sf_dir: str, builds: list[tuple[list[tuple], str, str]], query: Query) -> DataFrame:
    """Cubes of the events by day, built one after the other, each with its own metrics (filter, breakdowns) and time range."""
    ds = Datasource("events", "-", index_path=scratch(spark), time_field="ts", data_format="parquet")
    for metrics, after, before in builds:
        own = [Metric(f"m{i}", "events", p, tuple(parse_breakdowns(b))) for i, (p, b) in enumerate(metrics)]
        cube.write_points(cube.tagged_points(typed(events(spark, sf_dir)), own, "day", "ts", bounds=Query.parse(after=after, before=before)), ds, own, "day")
    return cube.query(spark, ds, query, "day")


@_register(f"SELECT event_type, {_N} FROM events WHERE {_TS} < epoch(TIMESTAMP '2024-01-20') GROUP BY 1")
def cube_metrics_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with one metric, then days with another: each day answers with what it holds."""
    builds = [([(None, "event_type")], "2024-01-01", "2024-01-10"), ([(None, "user_id,event_type")], "2024-01-10", "2024-01-20")]
    return _rebuilt(spark, sf_dir, builds, Query.parse(None, "event_type"))


@_register(f"SELECT user_id::VARCHAR AS user_id, {_N} FROM events WHERE event_type = 'click' AND {_TS} < epoch(TIMESTAMP '2024-02-10') GROUP BY 1")
def cube_metrics_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics in another order, over days that are there already."""
    click = ({"eq": ["event_type", "click"]}, "user_id")
    builds = [([(None, "event_type"), click], "2024-01-01", "2024-02-10"), ([click, (None, "event_type")], "2024-01-05", "2024-01-12")]
    return _rebuilt(spark, sf_dir, builds, Query.parse(click[0], "user_id"))


@_register(f"SELECT user_id::VARCHAR AS user_id, {_N} FROM events WHERE {_TS} >= epoch(TIMESTAMP '2024-01-10') AND {_TS} < epoch(TIMESTAMP '2024-01-20') GROUP BY 1")
def cube_metric_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose metrics cannot answer add nothing, though others were in their place."""
    builds = [([(None, "event_type")], "2024-01-01", "2024-01-10"), ([(None, "user_id")], "2024-01-10", "2024-01-20")]
    return _rebuilt(spark, sf_dir, builds, Query.parse(None, "user_id"))


@_register(f"""SELECT 0::INTEGER AS __dn_metric, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS __dn_ts, event_type AS k0, {_N} FROM events GROUP BY 1, 2, 3
UNION ALL SELECT 1::INTEGER, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S.000Z'), user_id::VARCHAR, {_N} FROM events WHERE value < 10 GROUP BY 1, 2, 3""")
def multi_metric_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = [Metric("a", "events", None, tuple(parse_breakdowns("event_type"))), Metric("b", "events", {"lt": ["latency", 10]}, tuple(parse_breakdowns("user_id")))]
    return cube.tagged_points(typed(events(spark, sf_dir)), metrics, "day", "ts")


@_register(f"SELECT event_type, {_N} FROM events WHERE event_id % 10 NOT IN (6, 8, 9) GROUP BY 1")
def stream_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    _json_events(spark, sf_dir).write.text(f"{at}/log")
    ds = Datasource("log", f"{at}/log", index_path=f"{at}/index", time_field="time")
    metrics = [Metric("m", "log", None, tuple(parse_breakdowns("req.method")))]
    incremental.start(spark, ds, metrics, "day", f"{at}/checkpoint").awaitTermination()
    return incremental.query(spark, ds, metrics, Query.parse(None, "req.method"), "day").withColumnRenamed("req.method", "event_type")


@_register(f"""WITH b AS (SELECT event_type, {_P2.format('value')} AS bucket, count(*) AS n FROM events GROUP BY 1, 2),
o AS (SELECT event_type, CASE WHEN bucket = 0 THEN 0 ELSE length(bin(bucket)) END AS o, n FROM b),
g AS (SELECT event_type, unnest(generate_series(0, max(o) + 1)) AS o, sum(n) AS total FROM o GROUP BY event_type)
SELECT g.event_type, CASE WHEN g.o = 0 THEN 0 ELSE 1::BIGINT << (g.o - 1)::INTEGER END::BIGINT AS bucket, coalesce(o.n, 0)::BIGINT AS value, floor(40 * coalesce(o.n, 0) / total + 0.5)::INTEGER AS bar
FROM g LEFT JOIN o ON g.event_type = o.event_type AND g.o = o.o""")
def dense_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query.parse(None, "event_type,latency[aggr=quantize]")
    return dense(scan_source(typed(events(spark, sf_dir)), q), q.breakdowns[-1], ["event_type"])


@_register("SELECT strftime(unnest(generate_series(TIMESTAMP '2014-02-26', TIMESTAMP '2014-03-02', INTERVAL 1 DAY)), '%Y/%m-%d') AS path")
def path_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in enumerate_paths("%Y/%m-%d", "2014-02-26T05:00", "2014-03-03")], "path string")


@_register(f"""WITH r AS (SELECT CASE WHEN event_id % 10 = 6 THEN 'invalid json' WHEN event_type = 'view' THEN 'nfilteredout' WHEN event_id % 10 = 9 THEN 'undef' WHEN event_id % 10 = 8 THEN 'baddate' WHEN event_id % 10 = 7 THEN 'nonnumeric' END AS reason FROM events)
SELECT count(*)::BIGINT AS ninputs, count(*) FILTER (reason IS NULL)::BIGINT AS noutputs, count(*) FILTER (reason = 'invalid json')::BIGINT AS invalid_json, 0::BIGINT AS nfailedeval, count(*) FILTER (reason = 'nfilteredout')::BIGINT AS nfilteredout, count(*) FILTER (reason = 'undef')::BIGINT AS undef, count(*) FILTER (reason = 'baddate')::BIGINT AS baddate, 0::BIGINT AS time_bounds, count(*) FILTER (reason = 'nonnumeric')::BIGINT AS nonnumeric FROM r""")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query.parse({"ne": ["req.method", "view"]}, "t[date,field=time,aggr=lquantize,step=3600],latency[aggr=quantize]")
    return drop_counters(json_lines(_json_events(spark, sf_dir)), q)


@_register(f"SELECT user_id::VARCHAR AS user_id, {_N} FROM events GROUP BY 1 ORDER BY value DESC, user_id LIMIT 10")
def topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.top(_scan(events(spark, sf_dir), "user_id"), 10)


@_register("SELECT event_type, count(*) FILTER (value >= 100)::BIGINT AS part, count(*)::BIGINT AS whole, (count(*) FILTER (value >= 100))::DOUBLE / count(*)::DOUBLE AS ratio FROM events GROUP BY 1")
def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return extensions.ratio(_scan(e, "event_type", {"ge": ["latency", 100]}), _scan(e, "event_type"), ["event_type"])


@_register(f"SELECT n_name AS s_nationkey, {_N} FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def id_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _scan(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_nationkey")
    return extensions.name_ids(counts, "s_nationkey", spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey", "n_name")


@_register(f"SELECT CASE WHEN value < 10 THEN 'fast' WHEN value < 100 THEN 'fair' ELSE 'slow' END AS speed, {_N} FROM events GROUP BY 1")
def case_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return _scan(e.withColumn("speed", extensions.classes(F.col("latency"), {"fast": (float("-inf"), 10), "fair": (10, 100)}, "slow")), "speed")


@_register(f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS hour, {_N} FROM events GROUP BY 1")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(events(spark, sf_dir), "ts[date,aggr=lquantize,step=3600]").select(iso(F.col("ts")).alias("hour"), "value")
