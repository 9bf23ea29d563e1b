"""The catalog's file: $TALLYRILL_CONFIG, or .tallyrillrc in the home folder. Written beside, then moved into place."""

from __future__ import annotations

import json
import os
from pathlib import Path

from ..plans.model import Catalog, EngineError


def place() -> Path:
    return Path(os.environ.get("TALLYRILL_CONFIG") or Path.home() / ".tallyrillrc")


def load(path: Path | None = None) -> Catalog:
    path = path or place()
    if not path.exists():
        return Catalog()
    try:
        return Catalog.from_json(json.loads(path.read_text()))
    except ValueError as e:
        raise EngineError(f'failed to load config: "{path}": {e}') from None


def save(catalog: Catalog, path: Path | None = None) -> None:
    path = path or place()
    beside = path.with_name(f"{path.name}.{os.getpid()}")
    beside.write_text(json.dumps(catalog.to_json(), indent=4) + "\n")
    beside.replace(path)
