import pytest

from tallyrill.functions.predicate import both, canonical, fields_of, parse_filter
from tallyrill.plans.model import Catalog, Datasource, EngineError, Metric, Query
from tallyrill.plans.parse import parse_attributes
from tallyrill.plans.select import choose
from tallyrill.sources import store
from tallyrill.sources.paths import enumerate_paths


@pytest.mark.parametrize(
    ("text", "parsed"),
    [
        ("foo", [{"name": "foo"}]),
        ("x", [{"name": "x"}]),
        ("a,b", [{"name": "a"}, {"name": "b"}]),
        ("foo[b]", [{"name": "foo", "b": ""}]),
        ("foo[p=one],bar", [{"name": "foo", "p": "one"}, {"name": "bar"}]),
        (",foo[p1=one,p2,,p3=three],,bar,", [{"name": "foo", "p1": "one", "p2": "", "p3": "three"}, {"name": "bar"}]),
        ("foo[a=1],bar[]", [{"name": "foo", "a": "1"}, {"name": "bar"}]),
        ("foo,bar[,p4=]", [{"name": "foo"}, {"name": "bar", "p4": ""}]),
    ],
)
def test_breakdowns(text, parsed):
    assert parse_attributes(text) == parsed


@pytest.mark.parametrize(("text", "error"), [("foo[", "unexpected end of string"), ("foo[foo=", "unexpected end of string"), ("foo[=]", "missing attribute name"), ("foo[=bar]", "missing attribute name"), ("foo,[]", "missing field name"), ("foo,[b=c]", "missing field name")])
def test_bad_breakdowns(text, error):
    with pytest.raises(EngineError, match=error):
        parse_attributes(text)


@pytest.mark.parametrize("bad", ["x[aggr=junk]", "x[aggr=lquantize]", "x[aggr=lquantize,step=q]", "__dn_x"])
def test_bad_columns(bad):
    with pytest.raises(EngineError):
        Query.parse(None, bad)


@pytest.mark.parametrize("bad", ["{", '{"junk": ["a", "b"]}', '{"eq": ["a"]}', '{"and": []}', "[]", '{"eq": ["a", 1], "ne": ["a", 2]}'])
def test_bad_filters(bad):
    with pytest.raises(EngineError, match="invalid filter"):
        parse_filter(bad)


def test_filter_helpers():
    p = {"and": [{"eq": ["a", 1]}, {"or": [{"lt": ["b.c", 2]}, {"eq": ["a", 3]}]}]}
    assert fields_of(p) == ["a", "b.c"] and fields_of({}) == [] == fields_of(None)
    assert both(None, {}, p) == p and both(None) is None and both(p, p) == {"and": [p, p]}
    assert canonical(p).startswith('{"and":[{"eq":["a",1]}')


@pytest.mark.parametrize(
    ("pattern", "start", "end", "paths"),
    [
        ("plain", "2010-01-01", "2010-01-10", ["plain"]),
        ("my_%%p%%", "2010-01-01", "2010-01-10", ["my_%p%"]),
        ("%Y", "2010-12-03T01:23:45.678Z", "2013-01-01T00:00:00.000", ["2010", "2011", "2012"]),
        ("%Y", "2010-01-01T00:00:00.000Z", "2013-01-01T00:00:00.001", ["2010", "2011", "2012", "2013"]),
        ("%Y", "2014-02-01", "2014-02-01", ["2014"]),
        ("%Y-%m", "2010-10-30", "2011-02-01", ["2010-10", "2010-11", "2010-12", "2011-01"]),
        ("%Y/%m", "2014-01-31T23:59:59.999Z", "2014-02-01T00:00:00.001Z", ["2014/01", "2014/02"]),
        ("%d", "2010-06-12T03:05:06Z", "2010-06-15", ["12", "13", "14"]),
        ("y%Y/m%m/d%d/x", "2014-02-27", "2014-03-02", ["y2014/m02/d27/x", "y2014/m02/d28/x", "y2014/m03/d01/x"]),
        ("%H", "2010-06-12T03:05:06Z", "2010-06-12T06:00:00Z", ["03", "04", "05"]),
        ("%Y/%m/%d/%H", "2014-02-28T22:00:00Z", "2014-03-01T01:00:00Z", ["2014/02/28/22", "2014/02/28/23", "2014/03/01/00"]),
        ("%d/%H", "2014-02-01", "2014-02-01", ["01/00"]),
    ],
)
def test_paths(pattern, start, end, paths):
    assert enumerate_paths(pattern, start, end) == paths


@pytest.mark.parametrize(
    ("pattern", "start", "end", "error"),
    [("my_pattern%", "2010-01-01", "2010-01-10", 'unexpected "%" at char 11'), ("my_pattern%T", "2010-01-01", "2010-01-10", 'unsupported conversion "%T" at char 11'), ("x", "q", "2010-01-10", '"timeStart" is not a valid date'), ("x", "2010-01-10", "q", '"timeEnd" is not a valid date'), ("x", "2010-01-11", "2010-01-10", '"timeStart" may not be after "timeEnd"')],
)
def test_bad_paths(pattern, start, end, error):
    with pytest.raises(EngineError, match=error):
        enumerate_paths(pattern, start, end)


def test_bounds():
    q = Query.parse(after="2014-05-02T04:05:06.123", before="2014-05-02T04:15:10")
    assert q.seconds == (1399003507, 1399004110)
    for bad in ({"after": "2014-01-01"}, {"after": "q", "before": "2014-01-01"}, {"after": "2014-01-02", "before": "2014-01-01"}):
        with pytest.raises(EngineError):
            Query.parse(**bad)
    assert Query.parse(after="2014-01-01", before="2014-01-01").after is not None


def test_choice_of_metrics():
    def m(name, p, b):
        return Metric(name, "d", p, Query.parse(None, b).breakdowns)

    get = {"eq": ["method", "GET"]}
    metrics = [m("a", get, "host"), m("b", None, "host,method"), m("c", None, "t[date,aggr=lquantize,step=60],host,n[aggr=quantize]")]
    assert choose(metrics, Query.parse(get, "host")).metric.name == "a"
    assert not choose(metrics, Query.parse(get, "host")).apply_filter
    assert choose(metrics, Query.parse(None, "host")).metric.name == "b"
    assert choose(metrics, Query.parse({"eq": ["method", "PUT"]}, "host")).metric.name == "b"
    assert choose(metrics, Query.parse(None, "host", after="2014-01-01", before="2014-01-02")).metric.name == "c"
    assert choose(metrics, Query.parse(None, "n[aggr=lquantize,step=9]")).metric.name == "c"
    for q, exact in ((Query.parse(None, "other"), False), (Query.parse({"eq": ["other", 1]}), False), (Query.parse(None, "n[aggr=lquantize,step=9]"), True)):
        with pytest.raises(EngineError, match="no metrics available"):
            choose(metrics, q, exact)


def test_catalog(tmp_path):
    c = Catalog().add_datasource(Datasource("a", "/x", filter={"eq": ["k", 1]})).add_datasource(Datasource("b", "/y", data_format="json-skinner"))
    c = c.add_metric(Metric("m", "a", None, Query.parse(None, "h,t[date,field=time,aggr=lquantize,step=60]").breakdowns))
    store.save(c, tmp_path / "config")
    assert store.load(tmp_path / "config") == c and store.load(tmp_path / "none") == Catalog()
    # An update changes only what it names.
    assert c.update_datasource("b", path="/z").datasource("b") == Datasource("b", "/z", data_format="json-skinner")
    assert c.remove_datasource("a").metrics == {}
    for wrong in (lambda: c.add_datasource(Datasource("a", "/q")), lambda: c.remove_datasource("q"), lambda: c.add_metric(Metric("m", "a")), lambda: c.remove_metric("a", "q"), lambda: c.update_datasource("q"), lambda: c.metrics_of("q"), lambda: Catalog.from_json({"version": "9.0.0"})):
        with pytest.raises(EngineError):
            wrong()
