"""Queries over the mapped tables, each with SQL for the same rows."""

from __future__ import annotations

from importlib import import_module

AREAS = ("staging", "series", "decisions", "checks", "scoring", "io", "history", "streams")


def _all():
    for area in AREAS:
        import_module(f"depotlake.catalog.{area}")
    return import_module("depotlake.catalog.base")


def queries() -> dict:
    return _all().QUERIES


def oracles() -> dict[str, str]:
    return _all().ORACLES
