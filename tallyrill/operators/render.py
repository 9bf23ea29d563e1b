"""Results as text: tables, histograms, points, raw rows and plots. A result is as small as its groups are few."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import EngineError, Query
from .histogram import BAR, FAR


def each_row(result: DataFrame, query: Query, whole: bool = False) -> Iterator[tuple]:
    """All rows, the value last, in order of their columns from the left (sorted by Spark).

    The driver holds one partition at a time, or all rows (``whole``), which a frame that is observed needs: only then does Spark report.
    """
    rows = result.select(*(F.col(f"`{b.name}`").alias(f"c{i}") for i, b in enumerate(query.breakdowns)), F.col("value").alias("v"))
    rows = rows.orderBy(*rows.columns) if query.breakdowns else rows
    yield from map(tuple, rows.collect() if whole else rows.toLocalIterator())


def rows_of(result: DataFrame, query: Query) -> list[tuple]:
    return list(each_row(result, query, whole=True))


def iso_text(seconds: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def _ordinal(least: int, b) -> int:
    return least.bit_length() if b.aggr == "quantize" else least // b.step


def _least(ordinal: int, b) -> int:
    return (1 << ordinal - 1 if ordinal > 0 else 0) if b.aggr == "quantize" else ordinal * b.step


def points(rows: Iterable[tuple], query: Query) -> Iterator[str]:
    names = [b.name for b in query.breakdowns]
    for r in rows:
        yield json.dumps({"fields": dict(zip(names, r[:-1], strict=True)), "value": r[-1]}, separators=(",", ":"), ensure_ascii=False)


def raw(rows: list[tuple], query: Query) -> str:
    """One JSON array of rows; buckets are ordinals."""
    out = [[*(_ordinal(x, b) if b.aggr else x for x, b in zip(r, query.breakdowns, strict=False)), r[-1]] for r in rows]
    return json.dumps(out, separators=(",", ":"), ensure_ascii=False)


def table(rows: list[tuple], query: Query) -> Iterator[str]:
    if not rows:
        return
    bs = query.breakdowns
    shown = [[*(iso_text(x) if b.date and b.aggr else str(x) for x, b in zip(r, bs, strict=False)), str(r[-1])] for r in rows]
    heads = [*(b.name.upper() for b in bs), "VALUE"]
    right = [*(bool(b.aggr) for b in bs), True]
    widths = [max(len(h), *(len(s[i]) for s in shown)) for i, h in enumerate(heads)]
    for line in (heads, *shown):
        yield " ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(line, widths, right, strict=True)).rstrip("\n")


def histogram(rows: list[tuple], query: Query) -> Iterator[str]:
    """A distribution of the last breakdown for each group of the others."""
    last, groups = query.breakdowns[-1], {}
    for r in rows:
        label = ", ".join(iso_text(x) if b.date and b.aggr else str(x) for x, b in zip(r[:-2], query.breakdowns, strict=False))
        groups.setdefault(label, {})
        at = _ordinal(r[-2], last)
        groups[label][at] = groups[label].get(at, 0) + r[-1]
    width = 26 if last.date else 16
    for label in sorted(groups):
        counts = groups[label]
        yield label
        yield "value".rjust(width) + "  " + " Distribution ".center(BAR, "-") + " count"
        total, first = sum(counts.values()), min(counts)
        for at in range(first if first > FAR else 0, max(counts) + 2):
            n, least = counts.get(at, 0), _least(at, last)
            bar = "@" * int(BAR * n / total + 0.5) if total else ""
            yield f"{(iso_text(least) if last.date else str(least)).rjust(width)} |{bar.ljust(BAR)} {n}"


def gnuplot(rows: list[tuple], query: Query, title: str) -> Iterator[str]:
    if len(query.breakdowns) != 1:
        raise EngineError("--gnuplot can only be used with exactly one breakdown")
    (b,) = query.breakdowns
    yield from ("# A graph of counts, for gnuplot: gnuplot < FILE > PICTURE", "set terminal png size 1000,500", f'set title "{title}"')
    if b.date:
        # How gnuplot reads and shows seconds.
        yield from ("set xdata time;", 'set timefmt "%s";', 'set format x "%m/%d\\n%H:%MZ"')
    yield from ("set yrange [0:*]", 'set ylabel "Count"', "set ytics")
    # Buckets are numbers on the x-axis; other keys label the rows.
    yield f'plot "-" using {"1:2" if b.aggr else "(column(0)):2:xtic(1)"} with linespoints title "Value"'
    for x, value in rows:
        yield f"\t{x} {value}"
    yield "\te"


def pretty(rows: list[tuple], query: Query) -> Iterator[str]:
    """A histogram if the last breakdown is of buckets, else a table."""
    yield from (histogram if query.breakdowns and query.breakdowns[-1].aggr else table)(rows, query)
