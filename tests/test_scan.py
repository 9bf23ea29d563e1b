"""One list of queries, in three modes (scan, cube of everything, cube by hour): the answers must be the same."""

import json
import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest

from tallyrill.operators import cube, render
from tallyrill.operators.histogram import dense
from tallyrill.operators.scan import drop_counters, rejects, scan, scan_source, to_points
from tallyrill.plans.model import Datasource, EngineError, Metric, Query
from tallyrill.sources.readers import files_of, json_lines, points, read
from tallyrill.streaming import incremental

SHAPES = [
    (None, ""),
    (None, "operation"),
    (None, "operation,req.method,host"),
    (None, "req.caller"),
    (None, "operation,req.caller"),
    ({"eq": ["req.method", "GET"]}, ""),
    ({"eq": ["req.method", "GET"]}, "operation,req.method,host"),
    ({"eq": ["req.caller", "poseidon"]}, ""),
    ({"eq": ["req.caller", "poseidon"]}, "req.caller"),
    (None, "latency[aggr=quantize]"),
    (None, "latency[aggr=quantize],operation,host"),
    (None, "host,operation,latency[aggr=quantize]"),
]


def records():
    """Nine files over five days; in the second day two broken lines, one record without a time and one with a bad one."""
    rng, out = random.Random(1), {}
    start = datetime(2014, 5, 1, tzinfo=UTC)
    for day in range(5):
        for name in ("one", "two") if day < 4 else ("more",):
            lines = []
            for i in range(50):
                at = start + timedelta(days=day, seconds=(i * 2 + (name == "two")) * 860)
                method = rng.choice(["GET", "PUT"])
                req = {"method": method}
                caller = rng.choice(["admin", "poseidon", None, "absent"])
                if caller != "absent":
                    req["caller"] = caller
                lines.append(json.dumps({"time": at.strftime("%Y-%m-%dT%H:%M:%S.000Z"), "host": rng.choice(["ralph", "janey"]), "req": req, "operation": method.lower() + rng.choice(["storage", "object"]), "res": {"statusCode": rng.choice([200, 204, 500])}, "latency": rng.choice([0, 1, 3, 25, 100.5, 2048, 4095])}))
            if (day, name) == (1, "one"):
                lines += ["{oops", "[1, 2]", json.dumps({"host": "ralph", "req": {"method": "GET"}, "operation": "getstorage", "latency": 1}), json.dumps({"time": "never", "host": "ralph", "req": {"method": "GET"}, "operation": "getstorage", "latency": 1})]
            out[f"2014/05-0{day + 1}/{name}.log"] = lines
    return out


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    base = tmp_path_factory.mktemp("log")
    for name, lines in records().items():
        p = base / "data" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("".join(x + "\n" for x in lines))
    return Datasource("log", str(base / "data"), index_path=str(base / "index"), time_field="time", time_format="%Y/%m-%d")


@pytest.fixture(scope="module")
def built(spark, log):
    metric = Metric("all", "log", None, Query.parse(None, "t[date,field=time,aggr=lquantize,step=3600],operation,req.method,host,req.caller,latency[aggr=quantize]").breakdowns)
    for interval in ("all", "hour", "day"):
        cube.build(spark, log, [metric], interval)
    return log


def good():
    return [json.loads(x) for lines in records().values() for x in lines if x.startswith('{"')]


def expected(p, breakdowns, rows):
    out = Counter() if breakdowns.breakdowns else Counter({(): 0})
    for r in rows:
        def get(name):
            if "." not in name:
                return r.get(name, ...)
            a, b = name.split(".")
            return r.get(a, {}).get(b, ...)

        if p and get(p["eq"][0]) != p["eq"][1]:
            continue
        key = []
        for b in breakdowns.breakdowns:
            v = get(b.name)
            if b.aggr:
                key.append(0 if v < 1 else 1 << int(v).bit_length() - 1)
            else:
                key.append("undefined" if v is ... else "null" if v is None else str(v))
        out[tuple(key)] += 1
    return sorted((*k, n) for k, n in out.items())


@pytest.mark.parametrize("mode", ["scan", "all", "hour"])
@pytest.mark.parametrize(("p", "b"), SHAPES)
def test_shapes(spark, built, mode, p, b):
    q = Query.parse(p, b)
    rows = good()
    if mode == "scan":
        result = scan(spark, built, q)
    else:
        result, rows = cube.query(spark, built, q, mode), [r for r in rows if r.get("time", "never") != "never"]
    assert render.rows_of(result, q) == expected(p, q, rows)


def test_counts_and_days(spark, built):
    assert scan(spark, built, Query.parse()).first()[0] == 452
    q = Query.parse(None, "t[date,field=time,aggr=lquantize,step=86400]")
    assert [n for _, n in render.rows_of(scan(spark, built, q), q)] == [100, 100, 100, 100, 50]
    counters = drop_counters(read(spark, built, q), q).first().asDict()
    assert {k: counters[k] for k in ("ninputs", "noutputs", "invalid_json", "undef", "baddate")} == {"ninputs": 454, "noutputs": 450, "invalid_json": 2, "undef": 1, "baddate": 1}
    assert sorted(r["reason"] for r in rejects(read(spark, built, q), q).collect()) == ["baddate", "invalid json", "invalid json", "undef"]


def test_pruning(spark, built):
    q = Query.parse(after="2014-05-02", before="2014-05-03")
    assert len(files_of(spark, built, Query.parse())) == 9 and len(files_of(spark, built, q)) == 2
    assert scan(spark, built, q).first()[0] == 100
    for interval in ("all", "day", "hour"):
        assert cube.query(spark, built, q, interval).first()[0] == 100
    plan = cube.query(spark, built, q, "day")._jdf.queryExecution().executedPlan().toString()
    assert "dn_bucket" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert scan(spark, built, Query.parse(after="2019-05-02", before="2019-05-03")).first()[0] == 0


def test_rebuild_keeps_other_buckets(spark, built):
    metric = cube.load_manifest(spark, built.index_path, "day")
    cube.build(spark, built, metric, "day", Query.parse(after="2014-05-02", before="2014-05-03"))
    assert cube.query(spark, built, Query.parse(), "day").first()[0] == 450


def test_empty_input(spark, tmp_path):
    ds = Datasource("none", "/dev/null", index_path=str(tmp_path / "i"), time_field="time")
    assert [tuple(r) for r in scan(spark, ds, Query.parse()).collect()] == [(0,)]
    assert scan(spark, ds, Query.parse(None, "a,b[aggr=quantize]")).collect() == []
    cube.build(spark, ds, [Metric("m", "none")], "all")
    assert cube.query(spark, ds, Query.parse(), "all").first()[0] == 0


def test_points_are_additive(spark, built):
    q = Query.parse(None, "operation,req.method")
    p = to_points(scan(spark, built, q))
    assert render.rows_of(scan_source(points(p), q), q) == render.rows_of(scan(spark, built, q), q)
    assert scan_source(points(p.unionAll(p)), Query.parse()).first()[0] == 904


def lines(spark, *texts):
    return json_lines(spark.createDataFrame([(t,) for t in texts], "value string"))


def test_fields(spark):
    s = lines(spark, '{"a.b": null, "a": {"b": 1}}', '{"a": {"b": 1}}', '{"a": {"b": "x"}}', '{"a": {"b": true}}', "{}", '{"a": {"b": 1.5}}', '{"a": {"b": {"c": 1}}}', "", "7")
    q = Query.parse(None, "a.b")
    assert dict(render.rows_of(scan_source(s, q), q)) == {"null": 1, "1": 1, "x": 1, "true": 1, "undefined": 1, "1.5": 1, "[object Object]": 1}


@pytest.mark.parametrize(
    ("p", "n"),
    [({"eq": ["s", "200"]}, 2), ({"eq": ["s", 200]}, 2), ({"ne": ["s", 200]}, 3), ({"lt": ["s", 300]}, 2), ({"ge": ["s", 200]}, 3), ({"gt": ["s", 200]}, 1), ({"le": ["s", 200]}, 2), ({"eq": ["s", None]}, 1), ({"ne": ["s", None]}, 4), ({"eq": ["s", "x"]}, 1), ({"or": [{"eq": ["s", 200]}, {"eq": ["q", 1]}]}, 0), ({}, 6)],
)
def test_predicates(spark, p, n):
    s = lines(spark, '{"s": 200}', '{"s": "200"}', '{"s": 500}', '{"s": "x"}', '{"s": null}', "{}")
    assert scan_source(s, Query.parse(p)).first()[0] == n


def test_numbers_only(spark):
    s = lines(spark, *(f'{{"n": {x}}}' for x in ("0", "0.5", "1", "1023.9", "1024", '"7"', "null", "true", "-3", "1e3", "99999999999")))
    q = Query.parse(None, "n[aggr=quantize]")
    assert render.rows_of(scan_source(s, q), q) == [(0, 3), (1, 1), (512, 2), (1024, 1), (1 << 36, 1)]
    q = Query.parse(None, "n[aggr=lquantize,step=500]")
    assert render.rows_of(scan_source(s, q), q) == [(-500, 1), (0, 3), (1000, 3), (99999999500, 1)]


def test_field_applies_to_dates_only(spark):
    s = lines(spark, '{"a": "x", "b": "y", "t": "2014-01-01", "e": 7.9}')
    q = Query.parse(None, "a[field=b],d[date,field=t,aggr=lquantize,step=60],n[date,field=e]")
    assert render.rows_of(scan_source(s, q), q) == [("x", 1388534400, "7", 1)]


def test_stream_is_idempotent(spark, built, tmp_path):
    from dataclasses import replace

    ds = replace(built, index_path=str(tmp_path / "index"))
    metrics = [Metric("m", "log", None, Query.parse(None, "operation").breakdowns)]
    for _ in range(2):  # the second time there is nothing new
        incremental.start(spark, ds, metrics, "day", str(tmp_path / "checkpoint")).awaitTermination()
    q = Query.parse(None, "operation")
    want = expected(None, q, [r for r in good() if r.get("time", "never") != "never"])
    assert render.rows_of(incremental.query(spark, ds, metrics, q, "day"), q) == want
    incremental.compact(spark, ds, metrics, "day")
    assert render.rows_of(cube.query(spark, ds, q, "day"), q) == want


def test_many_groups(spark):
    """What once had to fit one process's heap."""
    from pyspark.sql import functions as F

    from tallyrill.sources.readers import typed

    df = spark.range(1_000_000).select(F.col("id").alias("a"), (F.col("id") % 10).alias("b"))
    assert scan_source(typed(df), Query.parse(None, "a,b")).count() == 1_000_000


def test_dense(spark):
    s = lines(spark, '{"n": 1}', '{"n": 5}', '{"n": 5}')
    q = Query.parse(None, "n[aggr=quantize]")
    r = scan_source(s, q)
    assert sorted(map(tuple, dense(r, q.breakdowns[-1], []).collect())) == [(0, 0, 0), (1, 1, 13), (2, 0, 0), (4, 2, 27), (8, 0, 0)]
    assert list(render.histogram(render.rows_of(r, q), q))[1:4] == ["           value  ------------- Distribution ------------- count", f"               0 |{'':40} 0", f"               1 |{'@' * 13:40} 1"]


def test_errors(spark, built, tmp_path):
    from dataclasses import replace

    for wrong in (
        lambda: scan(spark, replace(built, data_format="junk"), Query.parse()),
        lambda: scan(spark, replace(built, time_field=None), Query.parse(after="2014-05-02", before="2014-05-03")),
        lambda: cube.query(spark, replace(built, index_path=None), Query.parse()),
        lambda: cube.query(spark, replace(built, index_path=str(tmp_path)), Query.parse()),
        lambda: cube.query(spark, built, Query.parse(None, "nothing"), "all"),
        lambda: cube.query(spark, built, Query.parse(), "week"),
    ):
        with pytest.raises(EngineError):
            wrong()
