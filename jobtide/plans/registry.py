"""All queries of the inventory engine and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalars", "labels", "inventory", "feed", "reconcile", "fusion", "figures", "gates", "selection", "landed", "streams", "texts", "schedule")


def _merged(part: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), part)()
    return out


def queries() -> dict:
    return _merged("queries")


def oracle() -> dict[str, str]:
    return _merged("oracle")
