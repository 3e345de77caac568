"""Registered queries: the library's operators on the driver's tables, each with its SQL counterpart."""

from importlib import import_module


def load() -> None:
    """Import every module that registers queries."""
    for name in ("windows", "months", "panels", "distributions", "models", "files"):
        import_module(f"freshet.catalog.{name}")
