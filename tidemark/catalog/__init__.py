"""Queries over the given tables, each with the SQL a database would run for it."""

from . import registry


def load() -> registry.Registry:
    import importlib
    import pkgutil

    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if m.name not in ("registry", "ctes"):
            importlib.import_module(f"{__name__}.{m.name}")
    return registry.REGISTRY
