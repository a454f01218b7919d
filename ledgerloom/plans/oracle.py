"""Helpers for writing the independent DuckDB oracle SQL.

Each oracle body is plain SQL over the ERP view names; :func:`with_views`
prefixes the fixture CTEs it (transitively) references, so the text runs
on a DuckDB connection that only has the driver's tables registered.
"""

from __future__ import annotations

import re

from ledgerloom.sources.views import VIEWS, as_plain_sql, dependencies

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _closure(names: set[str]) -> list[str]:
    seen: set[str] = set()

    def visit(n: str) -> None:
        if n in seen or n not in VIEWS:
            return
        for d in dependencies(n):
            visit(d)
        seen.add(n)

    for n in names:
        visit(n)
    return [n for n in VIEWS if n in seen]  # registration order


def with_views(body: str) -> str:
    used = {w for w in _WORD.findall(body) if w in VIEWS}
    ctes = _closure(used)
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({as_plain_sql(n)})" for n in ctes) + "\n" + body


def M(expr: str) -> str:
    """Money rounding Q1 as DOUBLE, same arithmetic as ``functions.money``."""
    return f"(CAST(floor(({expr})*100+0.5) AS DOUBLE)/100)"


def Z(expr: str) -> str:
    return f"COALESCE({expr}, CAST(0 AS DECIMAL(18,2)))"
