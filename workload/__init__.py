"""Queries over the given tables, each next to the SQL it must agree with."""

from importlib import import_module

_MODULES = ("scores", "scalars", "windows", "joins", "clocks", "bundles", "rules", "exchange")


def load_all() -> None:
    for name in _MODULES:
        import_module(f"workload.{name}")
