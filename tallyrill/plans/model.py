"""Queries, datasources, metrics and the catalog. All are immutable: an update returns a new catalog, or raises."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from datetime import UTC, datetime


class EngineError(Exception):
    """Anything a user can set right: bad arguments, unknown names, impossible queries."""


RESERVED = "__dn"
AGGREGATIONS = ("quantize", "lquantize")


@dataclass(frozen=True)
class Breakdown:
    """A result column. ``field`` is where a date column reads from; all others read the field of their name."""

    name: str
    field: str = ""
    date: bool = False
    aggr: str | None = None
    step: int | None = None

    @classmethod
    def of(cls, attributes: dict[str, str], allow_reserved: bool = False) -> Breakdown:
        name = attributes["name"]
        if name.startswith(RESERVED) and not allow_reserved:
            raise EngineError(f'invalid query: field name "{name}" is reserved')
        aggr, step = attributes.get("aggr"), attributes.get("step")
        if aggr is not None and aggr not in AGGREGATIONS:
            raise EngineError(f'invalid query: unsupported aggr: "{aggr}"')
        if aggr == "lquantize":
            if step is None:
                raise EngineError('invalid query: aggr "lquantize" requires "step"')
            try:
                step = int(step)
            except ValueError:
                raise EngineError(f'invalid query: aggr "lquantize": invalid value for "step": "{step}"') from None
            if step <= 0:
                raise EngineError(f'invalid query: aggr "lquantize": invalid value for "step": "{step}"')
        else:
            step = None
        return cls(name, attributes.get("field") or name, "date" in attributes, aggr, step)

    def to_json(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v not in (None, False)}


def parse_time(text: str | datetime, label: str) -> int:
    """Milliseconds since 1970 (UTC where the text has no zone)."""
    try:
        when = text if isinstance(text, datetime) else datetime.fromisoformat(text)
    except ValueError:
        raise EngineError(f'"{label}" is not a valid date') from None
    when = when if when.tzinfo else when.replace(tzinfo=UTC)
    delta = when - datetime(1970, 1, 1, tzinfo=UTC)
    return delta.days * 86_400_000 + delta.seconds * 1000 + delta.microseconds // 1000


@dataclass(frozen=True)
class Query:
    """after and before: milliseconds, both or none."""

    filter: dict | None = None
    breakdowns: tuple[Breakdown, ...] = ()
    after: int | None = None
    before: int | None = None

    @classmethod
    def parse(cls, filter: dict | str | None = None, breakdowns: str | list[str] | tuple = (), after=None, before=None, allow_reserved: bool = False) -> Query:
        from ..functions.predicate import parse_filter
        from .parse import parse_breakdowns

        if (after is None) != (before is None):
            raise EngineError('"after" and "before" must be given together')
        bounds = (None, None)
        if after is not None:
            bounds = parse_time(after, "after"), parse_time(before, "before")
            if bounds[0] > bounds[1]:
                raise EngineError('"after" may not be after "before"')
        return cls(parse_filter(filter), tuple(parse_breakdowns(breakdowns, allow_reserved)), *bounds)

    @property
    def seconds(self) -> tuple[int, int] | None:
        """The bounds as whole seconds; both are rounded up."""
        return None if self.after is None else (-(-self.after // 1000), -(-self.before // 1000))


@dataclass(frozen=True)
class Datasource:
    name: str
    path: str
    backend: str = "file"
    index_path: str | None = None
    time_format: str | None = None
    time_field: str | None = None
    filter: dict | None = None
    data_format: str = "json"


@dataclass(frozen=True)
class Metric:
    name: str
    datasource: str
    filter: dict | None = None
    breakdowns: tuple[Breakdown, ...] = ()

    def to_json(self) -> dict:
        return {"name": self.name, "datasource": self.datasource, "filter": self.filter, "breakdowns": [b.to_json() for b in self.breakdowns]}

    @classmethod
    def from_json(cls, x: dict) -> Metric:
        return cls(x["name"], x.get("datasource", ""), x.get("filter"), tuple(Breakdown(**{"field": b["name"], **b}) for b in x.get("breakdowns", [])))


VERSION = (0, 1, 0)


@dataclass(frozen=True)
class Catalog:
    datasources: dict[str, Datasource] = field(default_factory=dict)
    metrics: dict[str, dict[str, Metric]] = field(default_factory=dict)

    def datasource(self, name: str) -> Datasource:
        if name not in self.datasources:
            raise EngineError(f'datasource "{name}" does not exist')
        return self.datasources[name]

    def add_datasource(self, ds: Datasource) -> Catalog:
        if ds.name in self.datasources:
            raise EngineError(f'datasource "{ds.name}" already exists')
        return replace(self, datasources=self.datasources | {ds.name: ds})

    def update_datasource(self, name: str, **changes) -> Catalog:
        """Only what is given changes."""
        ds = replace(self.datasource(name), **{k: v for k, v in changes.items() if v is not None})
        return replace(self, datasources=self.datasources | {name: ds})

    def remove_datasource(self, name: str) -> Catalog:
        self.datasource(name)
        without = lambda d: {k: v for k, v in d.items() if k != name}
        return replace(self, datasources=without(self.datasources), metrics=without(self.metrics))

    def metrics_of(self, datasource: str) -> list[Metric]:
        self.datasource(datasource)
        return list(self.metrics.get(datasource, {}).values())

    def add_metric(self, m: Metric) -> Catalog:
        own = self.metrics.get(m.datasource, {})
        if m.name in own:
            raise EngineError(f'metric "{m.name}" already exists')
        return replace(self, metrics=self.metrics | {m.datasource: own | {m.name: m}})

    def remove_metric(self, datasource: str, name: str) -> Catalog:
        own = self.metrics.get(datasource, {})
        if name not in own:
            raise EngineError(f'datasource "{datasource}" metric "{name}" does not exist')
        return replace(self, metrics=self.metrics | {datasource: {k: v for k, v in own.items() if k != name}})

    def to_json(self) -> dict:
        return {
            "version": ".".join(map(str, VERSION)),
            "datasources": [asdict(d) for d in self.datasources.values()],
            "metrics": [m.to_json() for name in self.datasources for m in self.metrics.get(name, {}).values()],
        }

    @classmethod
    def from_json(cls, x: dict) -> Catalog:
        if not isinstance(x, dict) or str(x.get("version", "")).split(".")[0] != str(VERSION[0]):
            raise EngineError(f"unsupported configuration version: {x.get('version') if isinstance(x, dict) else x!r}")
        known = {f.name for f in fields(Datasource)}
        out = cls()
        for d in x.get("datasources", []):
            if bad := d.keys() - known or {"name", "path"} - d.keys():
                raise EngineError(f"invalid configuration: datasource: {', '.join(sorted(bad))}")
            out = out.add_datasource(Datasource(**d))
        for m in x.get("metrics", []):
            out = out.add_metric(Metric.from_json(m))
        return out
