"""All registered queries: ``key -> (builder(catalog) -> DataFrame, oracle SQL | None)``.

The oracle SQL is written independently in DuckDB's dialect over the same
fixture views; ``None`` marks a job whose result is checked another way
(streaming twins, brute force on a fixture).
"""

from __future__ import annotations

from importlib import import_module

from ledgerloom.plans.oracle import with_views

_MODULES = ("catalog", "supply", "sales", "stock", "people", "finance", "windows", "ledger", "rules", "validation",
            "streams")


def entries() -> dict:
    out: dict = {}
    for m in _MODULES:
        try:
            mod = import_module(f"ledgerloom.plans.{m}")
        except ModuleNotFoundError as exc:
            if exc.name != f"ledgerloom.plans.{m}":
                raise
            continue
        for k, v in mod.ENTRIES.items():
            if k in out:
                raise ValueError(f"duplicate query key {k}")
            out[k] = v
    return out


def oracle_texts() -> dict[str, str]:
    return {k: with_views(sql) for k, (_, sql) in entries().items() if sql}
