"""Operators that prepare training text. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

_MODULES = ["p1_pairs", "p2_residue", "p4_lines", "p6_near", "p7_leaks", "p5_cut", "p3_scan", "p8_mix", "p9_encoding"]


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"pagewright.llm.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
