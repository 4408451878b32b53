"""The registered queries of the core and their SQL twins."""

from __future__ import annotations

import importlib

_MODULES = ["boxes", "texts", "documents", "library", "config", "native"]


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        for k, v in getattr(importlib.import_module(f"pagewright.plans.{m}"), name).items():
            if k in out:
                raise ValueError(f"two queries are named {k}")
            out[k] = v
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
