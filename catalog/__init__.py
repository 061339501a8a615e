"""Every query of the package on the given tables, with its SQL equivalent."""

from __future__ import annotations

from importlib import import_module

_GROUPS = ("profile", "cleaning", "charts", "model", "reports", "sources")


def _merged(name: str) -> dict:
    merged: dict = {}
    for group in _GROUPS:
        merged |= getattr(import_module(f"catalog.{group}"), name)
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict[str, str]:
    return _merged("ORACLES")
