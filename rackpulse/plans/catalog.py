"""All registered queries and oracles."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("correlation", "kpi", "forecasting", "rootcause", "star", "features", "evaluation", "ingest", "models", "streams")


def _merge(attribute: str) -> dict:
    merged: dict = {}
    for group in GROUPS:
        entries = getattr(import_module(f"rackpulse.plans.{group}"), attribute)
        clash = merged.keys() & entries.keys()
        if clash:
            raise ValueError(f"duplicate query names: {sorted(clash)}")
        merged.update(entries)
    return merged


def queries() -> dict:
    return _merge("QUERIES")


def oracles() -> dict:
    return _merge("ORACLES")
