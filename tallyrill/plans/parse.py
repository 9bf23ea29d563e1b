"""The grammar of breakdowns: ``name[key=value,flag],name``, with empty items skipped."""

from __future__ import annotations

from .model import Breakdown, EngineError


def parse_attributes(text: str) -> list[dict[str, str]]:
    """Each item's name and attributes; a flag's value is empty."""
    out, at = [], 0
    while at < len(text):
        stops = [i for i in (text.find(",", at), text.find("[", at)) if i >= 0]
        end = min(stops, default=len(text))
        name, at = text[at:end], end
        item = {"name": name}
        if text[at : at + 1] == "[":
            if not name:
                raise EngineError("missing field name")
            close = text.find("]", at)
            if close < 0:
                raise EngineError("unexpected end of string")
            for attribute in filter(None, text[at + 1 : close].split(",")):
                key, _, value = attribute.partition("=")
                if not key:
                    raise EngineError("missing attribute name")
                item[key] = value
            at = close + 1
        at += text[at : at + 1] == ","
        if name:
            out.append(item)
    return out


def parse_breakdowns(given: str | list | tuple, allow_reserved: bool = False) -> list[Breakdown]:
    """Breakdowns from one text, several, or ready ones."""
    out = []
    for one in [given] if isinstance(given, str) else given:
        if isinstance(one, Breakdown):
            out.append(one)
            continue
        try:
            items = parse_attributes(one)
        except EngineError as e:
            raise EngineError(f'bad value for "breakdowns" ("{one}"): {e}') from None
        out += (Breakdown.of(i, allow_reserved) for i in items)
    return out
