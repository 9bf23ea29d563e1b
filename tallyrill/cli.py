"""The command line: ``python -m tallyrill.cli SUBCOMMAND [OPTIONS] ARGS``."""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path
from typing import TextIO

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .functions.predicate import canonical, parse_filter
from .operators import cube, render
from .operators.scan import observed, rejects, scan
from .plans.model import Datasource, EngineError, Metric, Query
from .plans.parse import parse_breakdowns
from .sources import store
from .sources.readers import files_of, points, read, typed_in

#: Options: whether they take a value, and their short forms.
VALUED = {"after": "A", "before": "B", "breakdowns": "b", "filter": "f", "interval": "i", "index-config": "", "backend": "", "path": "", "index-path": "", "time-field": "", "time-format": "", "data-format": "", "assetroot": "", "datasource": ""}
FLAGS = {"raw": "", "points": "", "gnuplot": "", "counters": "", "warnings": "", "dry-run": "n", "verbose": "v"}
_SHAPE = ("after", "before", "filter", "breakdowns")
_SOURCE = ("backend", "path", "index-path", "filter", "time-field", "time-format", "data-format")
#: Subcommands: the options each takes, and its arguments.
COMMANDS = {
    "datasource-add": (_SOURCE, ("DATASOURCE",)),
    "datasource-update": (_SOURCE, ("DATASOURCE",)),
    "datasource-remove": ((), ("DATASOURCE",)),
    "datasource-list": (("verbose",), ()),
    "datasource-show": (("verbose",), ("DATASOURCE",)),
    "metric-add": (("breakdowns", "filter"), ("DATASOURCE", "METRIC")),
    "metric-list": (("verbose",), ("DATASOURCE",)),
    "metric-remove": ((), ("DATASOURCE", "METRIC")),
    "build": (("after", "before", "interval", "index-config", "counters", "warnings", "dry-run", "assetroot"), ("DATASOURCE",)),
    "query": ((*_SHAPE, "interval", "raw", "points", "gnuplot", "counters", "dry-run", "assetroot"), ("DATASOURCE",)),
    "scan": ((*_SHAPE, "raw", "points", "gnuplot", "counters", "warnings", "dry-run", "assetroot"), ("DATASOURCE",)),
    "index-config": ((), ("DATASOURCE",)),
    "index-scan": ((*_SHAPE, "interval", "index-config", "counters"), ("DATASOURCE",)),
    "index-read": (("interval", "index-config"), ("DATASOURCE",)),
}


class UsageError(EngineError):
    """Shown together with how to call the command."""


def usage() -> str:
    lines = ["usage: tallyrill SUBCOMMAND [OPTIONS] ARGS", ""]
    for name, (options, args) in COMMANDS.items():
        lines.append(" ".join([f"tallyrill {name}", *(f"[--{o}={o.upper()}]" if o in VALUED else f"[--{o}]" for o in options), *args]))
    return "\n".join(lines)


def parse_args(command: str, argv: list[str]) -> tuple[dict, list[str]]:
    options, names = COMMANDS[command]
    short = {s: o for o, s in (VALUED | FLAGS).items() if s}
    got, args = {"breakdowns": []}, []
    argv = list(argv)
    while argv:
        a = argv.pop(0)
        if not a.startswith("-") or a == "-":
            args.append(a)
            continue
        name, eq, value = a[2:].partition("=") if a.startswith("--") else (short.get(a[1:2], a[1:2]), "=" if a[2:] else "", a[2:])
        if name not in options:
            raise UsageError(f'unknown option: "{a}"')
        if name in FLAGS:
            got[name] = True
            continue
        if not eq:
            if not argv:
                raise UsageError(f'option "{a}" needs a value')
            value = argv.pop(0)
        if name == "breakdowns":
            got[name].append(value)
        else:
            got[name] = value
    if len(args) != len(names):
        raise UsageError("missing arguments" if len(args) < len(names) else "extra arguments")
    try:
        got["filter"] = parse_filter(got.get("filter"))
        got["breakdowns"] = parse_breakdowns(got["breakdowns"])
    except EngineError as e:
        raise e if "predicate" in str(e) or "invalid query" in str(e) else UsageError(str(e)) from None
    return got, args


def _list(datasources: list[Datasource], verbose: bool, out: TextIO) -> None:
    print(f"{'DATASOURCE':<20} {'LOCATION':<59}".rstrip(), file=out)
    for d in datasources:
        print(f"{d.name:<20} {d.path if '://' in d.path else d.backend + ':/' + d.path}", file=out)
        if verbose:
            for label, value in (("filter", None if d.filter is None else canonical(d.filter)), ("dataFormat", json.dumps(d.data_format)), ("indexPath", d.index_path and json.dumps(d.index_path)), ("timeFormat", d.time_format and json.dumps(d.time_format)), ("timeField", d.time_field and json.dumps(d.time_field))):
                if value:
                    print(f"    {label + ':':<11} {value}", file=out)


def _show(result, q: Query, o: dict, title: str, out: TextIO) -> None:
    if o.get("points"):
        lines = render.points(render.each_row(result, q, whole=bool(o.get("counters"))), q)
    elif o.get("raw"):
        lines = [render.raw(render.rows_of(result, q), q)]
    else:
        rows = render.rows_of(result, q)
        lines = render.gnuplot(rows, q, title) if o.get("gnuplot") else render.pretty(rows, q)
    for line in lines:
        print(line, file=out)


def _metrics(catalog, name: str, o: dict) -> list[Metric]:
    if o.get("index-config"):
        return [Metric.from_json(m) for m in json.loads(Path(o["index-config"]).read_text())["metrics"]]
    found = catalog.metrics_of(name)
    if not found:
        raise EngineError(f'no metrics defined for datasource "{name}"')
    return found


def run(argv: list[str], spark: SparkSession | None = None, out: TextIO = sys.stdout, err: TextIO = sys.stderr) -> int:
    """Exit code: 0, 1 for errors, 2 for wrong usage."""
    timing = argv[:1] == ["-t"]
    argv, began = argv[timing:], time.time()
    try:
        _run(argv, spark, out, err)
        return 0
    except UsageError as e:
        print(f"tallyrill: {e}\n{usage()}", file=err)
        return 2
    except EngineError as e:
        print(f"tallyrill: {e}", file=err)
        return 1
    finally:
        if timing:
            print(f"total time: {time.time() - began:.3f} s", file=err)


def _run(argv: list[str], spark: SparkSession | None, out: TextIO, err: TextIO) -> None:
    if not argv or argv[0] not in COMMANDS:
        raise UsageError(f'no such command: "{argv[0]}"' if argv else "no command specified")
    command = argv[0]
    o, args = parse_args(command, argv[1:])
    catalog = store.load()
    if command in ("datasource-add", "datasource-update"):
        given = {k.replace("-", "_"): o.get(k) for k in _SOURCE}
        if command == "datasource-add":
            if not o.get("path"):
                raise UsageError('"path" option is required')
            catalog = catalog.add_datasource(Datasource(args[0], **{k: v for k, v in given.items() if v is not None}))
        else:
            catalog = catalog.update_datasource(args[0], **given)
        store.save(catalog)
    elif command == "datasource-remove":
        store.save(catalog.remove_datasource(args[0]))
    elif command in ("datasource-list", "datasource-show"):
        _list([catalog.datasource(a) for a in args] or list(catalog.datasources.values()), bool(o.get("verbose")), out)
    elif command == "metric-add":
        store.save(catalog.add_metric(Metric(args[1], args[0], o["filter"], tuple(o["breakdowns"]))))
    elif command == "metric-remove":
        store.save(catalog.remove_metric(*args))
    elif command == "metric-list":
        print(f"{'DATASOURCE':<20} {'METRIC':<20}".rstrip(), file=out)
        for m in catalog.metrics_of(args[0]):
            print(f"{m.datasource:<20} {m.name:<20}".rstrip(), file=out)
            if o.get("verbose"):
                if m.filter is not None:
                    print(f"    filter:     {canonical(m.filter)}", file=out)
                if m.breakdowns:
                    print(f"    breakdowns: {', '.join(b.name for b in m.breakdowns)}", file=out)
    elif command == "index-config":
        print(json.dumps(cube.manifest(catalog.datasource(args[0]), _metrics(catalog, args[0], o)), indent=1), file=out)
    else:
        _data(command, o, args[0], catalog, spark or SparkSession.builder.appName("tallyrill").getOrCreate(), out, err)


def _data(command: str, o: dict, name: str, catalog, spark: SparkSession, out: TextIO, err: TextIO) -> None:
    ds, interval = catalog.datasource(name), o.get("interval", "day")
    shape = {} if command in ("build", "index-scan", "index-read") else {"filter": o["filter"], "breakdowns": o["breakdowns"]}
    q = Query.parse(**shape, after=o.get("after"), before=o.get("before"))
    if o.get("gnuplot") and len(q.breakdowns) != 1:
        raise EngineError("--gnuplot can only be used with exactly one breakdown")
    warn = lambda text: print(f"warn: {text}", file=err)
    if o.get("dry-run"):
        files = cube.files_of(spark, ds, q, interval) if command == "query" else files_of(spark, ds, q)
        print("would scan files:", *(f"    {f}" for f in files), sep="\n", file=err)
        return
    # Counters come from the one job that reads the records.
    counters = Observation() if o.get("counters") else None
    watch = (lambda source: observed(source, counters, q, ds.time_field, ds.filter)) if counters else (lambda source: source)
    if command == "scan":
        _show(scan(spark, ds, q, warn, watch), q, o, ds.name, out)
    elif command == "query":
        stored = (lambda rows: rows.observe(counters, F.count("*").alias("nstored"), F.sum("value").alias("nrecords"))) if counters else (lambda rows: rows)
        _show(cube.query(spark, ds, q, interval, watch=stored), q, o, ds.name, out)
    elif command == "build":
        cube.build(spark, ds, _metrics(catalog, name, o), interval, q, watch)
    elif command == "index-scan":
        tagged = cube.tagged_points(watch(read(spark, ds, q, warn)), _metrics(catalog, name, o), interval, ds.time_field, ds.filter, q)
        rows = tagged.select(F.to_json(F.struct(*(c for c in tagged.columns if c != "value"))).alias("f"), "value")
        for r in rows.collect() if counters else rows.toLocalIterator():
            print(f'{{"fields":{r["f"]},"value":{r["value"]}}}', file=out)
    else:
        metrics = _metrics(catalog, name, o)
        width = max([len(m.breakdowns) for m in metrics], default=0)
        s = points(typed_in(spark))
        tagged = s.df.filter(~s.invalid).select(s.fields["__dn_metric"].number.cast("int").alias("__dn_metric"), s.fields["__dn_ts"].text.alias("__dn_ts"), *(s.fields[f"k{i}"].text.alias(f"k{i}") for i in range(width)), "value")
        cube.write_points(tagged.groupBy(*(c for c in tagged.columns if c != "value")).agg(F.sum("value").cast("long").alias("value")), ds, metrics, interval)
    if counters:
        for label, n in counters.get.items():
            print(f"{label:<20} {n or 0:>12}", file=err)
    if o.get("warnings"):
        source = read(spark, ds, q)
        for r in rejects(source, q, ds.time_field, ds.filter).toLocalIterator():
            print(f"warn: {r['reason']}: {r['rec'] if 'rec' in r else r}", file=err)


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
