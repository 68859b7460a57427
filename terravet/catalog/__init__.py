"""All registered queries, by module."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules

from .registry import ENTRIES, Entry


def load_entries() -> dict[str, Entry]:
    for module in sorted(m.name for m in iter_modules(__path__)):
        if module not in ("registry", "bindings"):
            import_module(f"{__name__}.{module}")
    return dict(ENTRIES)
