"""Registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module


def _all(what: str) -> dict:
    found: dict = {}
    for name in ("scores", "prep", "models", "explained", "closed"):
        found |= getattr(import_module(f"assayer.plans.{name}"), what)
    return found


def queries() -> dict:
    return _all("QUERIES")


def sql() -> dict[str, str]:
    return _all("SQL")
