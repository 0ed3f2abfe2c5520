"""Column expressions shared by the operators.

Every helper returns a native Catalyst expression, so it stays inside
whole-stage codegen, filters on it push down, and no Python runs per row.
Spark 4 runs in ANSI mode: bad casts, out-of-range indexes and division by
zero raise, so the helpers use ``try_cast``, ``get`` and ``try_divide``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paysift.functions import lookups as L


def col_of(c: str | Column) -> Column:
    """A column by name; names may hold spaces or '/', so quote them."""
    if isinstance(c, Column):
        return c
    return F.col(f"`{c}`") if not c.startswith("`") else F.col(c)


def safe_double(c: str | Column) -> Column:
    """String to double; malformed values become null instead of raising."""
    return col_of(c).try_cast("double")


def safe_int(c: str | Column) -> Column:
    return col_of(c).try_cast("int")


def keep_or_other(c: str | Column, keep: Iterable[str],
                  other: str = L.OTHER) -> Column:
    """Keep listed values, map everything else (and null) to ``other``.

    ``isin`` with more than a handful of literals becomes a hash-set lookup
    (``InSet``) in the optimised plan.
    """
    x = col_of(c)
    return F.when(x.isin(list(keep)), x).otherwise(F.lit(other))


def ladder(c: str | Column, arms: Sequence[tuple[str, Sequence[str]]],
           default: str = L.OTHER) -> Column:
    """First-match bucketing: the first arm listing the value wins.

    Built as one CASE WHEN chain of set lookups; a value listed in two arms
    takes the earlier bucket, exactly like an if/else-if ladder.
    """
    x = col_of(c)
    expr = None
    for bucket, keys in arms:
        cond = x.isin(list(keys))
        expr = F.when(cond, F.lit(bucket)) if expr is None else expr.when(
            cond, F.lit(bucket))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def location_region(c: str | Column,
                    sep: str = L.LOCATION_SEPARATOR,
                    us_regions=L.US_REGIONS, us_default: str = L.US_DEFAULT,
                    country_regions=L.COUNTRY_REGIONS,
                    country_default: str = L.COUNTRY_DEFAULT) -> Column:
    """Route "City, ST" to a US region and "City, Region, Country" to a
    country group.

    Fewer than three parts: the second part is a US state.  A missing part
    (no comma) and a null location both take the US branch with a null
    state, hence the US default; ``coalesce(size, -1)`` keeps the legacy
    ``size(null) = -1`` routing that ANSI mode would otherwise turn to null.
    """
    parts = F.split(col_of(c), _regex_quote(sep))
    n = F.coalesce(F.size(parts), F.lit(-1))
    state = F.get(parts, 1)
    country = F.get(parts, 2)
    return F.when(n < 3, ladder(state, us_regions, us_default)).otherwise(
        ladder(country, country_regions, country_default))


def location_key(c: str | Column, sep: str = L.LOCATION_SEPARATOR) -> Column:
    """The part of a location the router looks up (state or country)."""
    parts = F.split(col_of(c), _regex_quote(sep))
    n = F.coalesce(F.size(parts), F.lit(-1))
    return F.when(n < 3, F.get(parts, 1)).otherwise(F.get(parts, 2))


def degree_flag(c: str | Column, degrees: Sequence[str] = L.DEGREES) -> Column:
    """Unanchored, case-sensitive regex match of any listed degree."""
    return col_of(c).rlike("|".join(degrees))


def smape(actual: str | Column, pred: str | Column) -> Column:
    """100·|a−p| / (|a|+|p|), range 0–100; null when both are zero."""
    a, p = col_of(actual), col_of(pred)
    return F.try_divide(F.lit(100.0) * F.abs(a - p), F.abs(a) + F.abs(p))


def mape(actual: str | Column, pred: str | Column) -> Column:
    """100·|a−p| / |a|; null when the actual value is zero."""
    a, p = col_of(actual), col_of(pred)
    return F.try_divide(F.lit(100.0) * F.abs(a - p), F.abs(a))


def hash_percent(key: str | Column) -> Column:
    """Stable 0–99 bucket of a key: first 8 hex digits of md5 mod 100.

    Independent of partitioning and of the engine (SQL engines with md5
    give the same bucket), unlike ``randomSplit``.
    """
    h = F.conv(F.substring(F.md5(col_of(key).cast("string")), 1, 8), 16, 10)
    return (h.cast("bigint") % 100).cast("int")


def _regex_quote(s: str) -> str:
    special = set(".^$*+?{}[]\\|()")
    return "".join("\\" + ch if ch in special else ch for ch in s)
