"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry


def _load() -> None:
    package = importlib.import_module(__package__)
    for module in pkgutil.iter_modules(package.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__package__}.{module.name}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
