"""Predicates as JSON: ``{"eq": [field, constant]}``, also ne, lt, le, gt, ge; ``{"and": [...]}``, ``{"or": [...]}``; ``{}`` is true."""

from __future__ import annotations

import json
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import EngineError

_COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}
_JOIN = {"and": operator.and_, "or": operator.or_}


def parse_filter(given: dict | str | None) -> dict | None:
    """A checked predicate, or None for none."""
    if given is None:
        return None
    if isinstance(given, str):
        try:
            given = json.loads(given)
        except ValueError as e:
            raise EngineError(f"invalid filter: {e}") from None
    check(given)
    return given


def check(p) -> None:
    def fail(why: str):
        raise EngineError(f"invalid query: invalid filter: predicate {json.dumps(p)}: {why}")

    if not isinstance(p, dict):
        fail("is no object")
    if not p:
        return
    if len(p) > 1:
        fail("has more than one operator")
    ((op, args),) = p.items()
    if op in _JOIN:
        if not isinstance(args, list) or not args:
            fail(f'"{op}" takes a list of predicates')
        for a in args:
            check(a)
    elif op in _COMPARE:
        if not isinstance(args, list) or len(args) != 2 or not isinstance(args[0], str) or isinstance(args[1], (dict, list)):
            fail(f'"{op}" takes a field name and a constant')
    else:
        fail(f'unknown operator "{op}"')


def fields_of(p: dict | None) -> list[str]:
    """The fields that a predicate reads, in order, once each."""
    if not p:
        return []
    ((op, args),) = p.items()
    return list(dict.fromkeys(f for a in args for f in fields_of(a))) if op in _JOIN else [args[0]]


def both(*ps: dict | None) -> dict | None:
    """All of them; None if there are none."""
    some = [p for p in ps if p]
    return None if not some else some[0] if len(some) == 1 else {"and": some}


def canonical(p: dict | None) -> str:
    """Equal texts for equal predicates; the order of what is joined counts."""
    return json.dumps(p or {}, separators=(",", ":"))


def _compare(op: str, field, constant) -> Column:
    f = _COMPARE[op]
    if constant is None:
        same = field.null
        return same if op in ("eq", "le", "ge") else ~same if op == "ne" else F.lit(False)
    if field.plain and field.plain[1] == ("text" if isinstance(constant, str) else "" if isinstance(constant, bool) else "number"):
        out = f(field.plain[0], F.lit(constant))
        return out | field.null if op == "ne" else out  # null, which counts as false, for the others
    if isinstance(constant, str):
        # Texts compare as texts; numbers with what number the constant may be.
        try:
            by_number = f(field.number, F.lit(float(constant)))
        except ValueError:
            by_number = F.lit(op == "ne")
        out = F.when(field.number.isNotNull(), by_number).when(field.text.isNotNull(), f(field.text, F.lit(constant))).when(field.truth.isNotNull(), f(field.truth.cast("string"), F.lit(constant)))
    elif isinstance(constant, bool):
        out = F.when(field.truth.isNotNull(), f(field.truth, F.lit(constant))).otherwise(f(field.loose_number, F.lit(float(constant))))
    else:
        out = f(field.loose_number, F.lit(float(constant)))
    return F.coalesce(out, F.lit(op == "ne"))


def compile_filter(p: dict | None, fields) -> Column:
    """True for records that fulfil the predicate. A record without any of its fields is never one."""
    if not p:
        return F.lit(True)

    def walk(p: dict) -> Column:
        if not p:
            return F.lit(True)
        ((op, args),) = p.items()
        return reduce(_JOIN[op], map(walk, args)) if op in _JOIN else _compare(op, fields[args[0]], args[1])

    return ~any_missing(p, fields) & walk(p)


def any_missing(p: dict | None, fields) -> Column:
    return reduce(operator.or_, (fields[f].missing for f in fields_of(p)), F.lit(False))
