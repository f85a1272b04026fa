"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ("parity", "catalogs", "mappings", "audits", "loads", "linting", "logs")


def load_all() -> None:
    for name in MODULES:
        import_module(f"workloads.{name}")
