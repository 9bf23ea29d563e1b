import io

import pytest

from tallyrill import cli


@pytest.fixture
def call(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TALLYRILL_CONFIG", str(tmp_path / "config"))

    def call(*argv, code=0):
        out, err = io.StringIO(), io.StringIO()
        assert cli.run(list(argv), spark, out, err) == code, err.getvalue()
        return out.getvalue() + err.getvalue()

    return call


@pytest.fixture
def data(tmp_path):
    (tmp_path / "in.log").write_text('{"host":"a","n":3,"time":"2014-01-01T00:00:00Z"}\n{"host":"b","n":9,"time":"2014-01-02T00:00:00Z"}\n{"host":"a","n":1,"time":"2014-01-02T01:00:00Z"}\noops\n')
    return str(tmp_path / "in.log")


def test_catalog_verbs(call):
    assert '"path" option is required' in call("datasource-add", "x", code=2)
    assert "invalid filter" in call("datasource-add", "x", "--path=/p", "--filter={", code=2)
    call("datasource-add", "x", "--path=/p", '--filter={"eq":["a","b"]}')
    assert "already exists" in call("datasource-add", "x", "--path=/p", code=1)
    assert call("datasource-list").splitlines() == ["DATASOURCE           LOCATION", "x                    file://p"]
    call("datasource-update", "x", "--time-field=t")
    assert 'filter:     {"eq":["a","b"]}' in (shown := call("datasource-show", "-v", "x")) and 'timeField:  "t"' in shown
    call("metric-add", "--breakdowns=host,n[aggr=quantize]", "x", "m")
    assert "breakdowns: host, n" in call("metric-list", "-v", "x")
    assert '"m"' in call("index-config", "x")
    assert "missing arguments" in call("metric-add", "m", code=2)
    call("metric-remove", "x", "m")
    assert 'metric "m" does not exist' in call("metric-remove", "x", "m", code=1)
    call("datasource-remove", "x")
    assert 'datasource "x" does not exist' in call("datasource-remove", "x", code=1)


def test_scan_build_query(call, data, tmp_path):
    call("datasource-add", "x", f"--path={data}", f"--index-path={tmp_path}/index", "--time-field=time")
    assert call("scan", "x") == "VALUE\n    3\n"
    assert call("scan", "-b", "host", "x") == "HOST VALUE\na        2\nb        1\n"
    assert call("scan", "--points", "-b", "host", "x") == '{"fields":{"host":"a"},"value":2}\n{"fields":{"host":"b"},"value":1}\n'
    assert call("scan", "--raw", "-b", "n[aggr=quantize]", "x") == "[[1,1],[2,1],[4,1]]\n"
    assert "Distribution" in call("scan", "-b", "host,n[aggr=quantize]", "x")
    assert "set xdata time" in call("scan", "--gnuplot", "-b", "t[date,field=time,aggr=lquantize,step=86400]", "x")
    assert "exactly one breakdown" in call("scan", "--gnuplot", "x", code=1)
    assert "in.log" in call("scan", "-n", "x")
    assert "invalid_json" in call("scan", "--counters", "x")
    assert "warn: invalid json" in call("scan", "--warnings", "x")
    assert "total time" in call("-t", "scan", "x")
    assert "no metrics defined" in call("build", "x", code=1)
    call("metric-add", "-b", "host,n[aggr=quantize]", "x", "m")
    for interval in ("day", "hour", "all"):
        call("build", f"--interval={interval}", "x")
        assert call("query", "-b", "host", "-i", interval, "x") == "HOST VALUE\na        2\nb        1\n"
    assert "no metrics available" in call("query", "-b", "time", "x", code=1)
    assert '"__dn_metric":0' in call("index-scan", "x")


def test_tagged_points_through_text(call, data, tmp_path, monkeypatch):
    call("datasource-add", "x", f"--path={data}", f"--index-path={tmp_path}/index", "--time-field=time")
    call("metric-add", "-b", "host", "x", "m")
    monkeypatch.setattr("sys.stdin", io.StringIO(call("index-scan", "x")))
    call("index-read", "x")
    assert call("query", "-b", "host", "x") == "HOST VALUE\na        2\nb        1\n"


@pytest.mark.parametrize(("argv", "message"), [(("-b", "host,x[=bar]"), 'bad value for "breakdowns" ("host,x[=bar]"): missing attribute name'), (("-b", "host,[]"), "missing field name"), (("-b", "host,foo["), "unexpected end of string"), (("-f", "{"), "invalid filter"), (("--junk",), "unknown option")])
def test_bad_usage(call, argv, message):
    assert message in call("scan", *argv, "x", code=2)


def test_bad_queries(call, data):
    call("datasource-add", "x", f"--path={data}", "--data-format=junk")
    assert 'unsupported format: "junk"' in call("scan", "x", code=1)
    assert 'unknown operator "junk"' in call("scan", "-f", '{"junk":["a","b"]}', "x", code=1)
    assert "usage" in call("nothing", code=2)
