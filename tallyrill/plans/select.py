"""Which metrics can answer a query: those that have what it needs, in the order of definition."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.predicate import canonical, fields_of
from .model import Breakdown, EngineError, Metric, Query


@dataclass(frozen=True)
class Choice:
    """apply_filter: the metric holds all records, so the query's filter is still to be applied."""

    number: int
    metric: Metric
    apply_filter: bool
    time_column: Breakdown | None


def _divides(have: Breakdown, want: Breakdown) -> bool:
    """Are the wanted buckets unions of those at hand?"""
    if have.aggr is None:
        return True
    if have.aggr == "quantize":
        return want.aggr == "quantize"
    return want.aggr == "lquantize" and want.step % have.step == 0


def choices(metrics: list[Metric], query: Query, exact: bool = False) -> list[Choice]:
    """One or more. ``exact``: only metrics of which the query's buckets can be made without loss."""
    out = []
    for number, m in enumerate(metrics):
        if m.filter and canonical(m.filter) != canonical(query.filter):
            continue
        time_column = next((b for b in m.breakdowns if b.date), None)
        if query.after is not None and time_column is None:
            continue
        have = {b.name: b for b in m.breakdowns}
        needed = {b.name for b in query.breakdowns} | (set() if m.filter else set(fields_of(query.filter)))
        if not needed <= have.keys():
            continue
        if exact and not all(_divides(have[b.name], b) for b in query.breakdowns):
            continue
        out.append(Choice(number, m, not m.filter, time_column))
    if out:
        return out
    raise EngineError("no metrics available to serve query")


def choose(metrics: list[Metric], query: Query, exact: bool = False) -> Choice:
    """The first that can."""
    return choices(metrics, query, exact)[0]
