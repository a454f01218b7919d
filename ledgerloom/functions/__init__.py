"""Column helpers shared by the operators. All are built-in expressions
(whole-stage codegen), no Python UDFs."""

from __future__ import annotations

import string
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
HALF = Decimal("0.5")


def money(c: Column | str) -> Column:
    """Q1 rounding to cents, half toward +infinity (``floor(x*100+0.5)/100``),
    returned as DOUBLE. Sums and the rounding are exact in DECIMAL; only the
    result is a DOUBLE, so totals above 2^53 cents (9e13 units) keep 15
    digits. Callers that need more take the DECIMAL before this step."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 100 + F.lit(HALF)).cast("double") / 100


def zero_if_null(c: Column | str) -> Column:
    """``COALESCE(x, 0)`` for money: SUM over no rows is NULL (Q17)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(0).cast(MONEY))


def missing(c: Column | str) -> Column:
    """JavaScript falsiness of a numeric or date request field: NULL or 0 (Q30)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == 0)


def missing_text(c: Column | str) -> Column:
    """JavaScript falsiness of a text field: NULL or the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def blank(c: Column | str) -> Column:
    """NULL or only whitespace."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.trim(c) == "")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Ordered rejection reason: the first check that holds, else NULL."""
    out = F.lit(None).cast("string")
    for cond, reason in reversed(checks):
        out = F.when(cond, F.lit(reason)).otherwise(out)
    return out


_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def like_contains(c: Column | str, text: str) -> Column:
    """SQLite ``LIKE '%text%'`` (Q2): case is folded for ASCII letters only,
    ``%`` and ``_`` typed by the user stay wildcards, and a backslash is an
    ordinary character (SQLite has no default escape; Spark's is ``\\``)."""
    c = F.col(c) if isinstance(c, str) else c
    pattern = "%" + text.translate(_FOLD).replace("\\", "\\\\") + "%"
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase).like(pattern)


def conditional_sum(value: Column, cond: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0).cast(MONEY)))


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def date_key(c: Column | str) -> Column:
    """A date as the number YYYYMMDD (NULL without a date), which sorts like it."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.year(c) * 10_000 + F.month(c) * 100 + F.dayofmonth(c)).cast("bigint")


def remainder(total: Column, paid: Column) -> Column:
    """What is left of an amount, never below 0; missing amounts are 0."""
    zero = F.lit(0).cast(MONEY)
    return F.greatest(zero, F.coalesce(total, zero) - F.coalesce(paid, zero))
