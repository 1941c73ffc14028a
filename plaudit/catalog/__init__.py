"""Named queries over the driver's tables, with the equivalent DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("text", "opinion", "terms", "records", "learning")


def _merged(part: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        merged.update(getattr(import_module(f"plaudit.catalog.{name}"), part)())
    return merged


def queries() -> dict:
    return _merged("queries")


def oracle_sql() -> dict:
    return _merged("oracle_sql")
