"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry


def entries() -> dict[str, registry.Entry]:
    package = importlib.import_module(__package__)
    for module in pkgutil.iter_modules(package.__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__package__}.{module.name}")
    return registry.ENTRIES
