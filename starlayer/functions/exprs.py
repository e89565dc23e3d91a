"""Column-expression helpers shared by all operators (all JVM-side builtins)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lit_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def money(col) -> Column:
    """Money as decimal(18,2); ``try_cast`` so raw strings never raise."""
    return _c(col).try_cast(MONEY)


def round_half_away(x, scale: int) -> Column:
    """Round a double half away from zero at ``scale`` decimals, computed as
    ``sign(x) * floor(|x| * 10^scale + 0.5) / 10^scale`` — the same IEEE
    operations SQL engines use for ROUND on DOUBLE, so results agree bit for bit."""
    m = float(10 ** scale)
    x = _c(x)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(m) + F.lit(0.5)).cast("double") / F.lit(m)


def ratio(num, den, scale: int = 2, factor: int | None = None, as_double: bool = True) -> Column:
    """Ratio of sums as in ``ROUND(num / NULLIF(den, 0), scale)``.

    The sums stay exact (decimal / integer) until the single double division,
    so both the quotient and its rounding are deterministic whatever the
    partitioning. ``factor`` multiplies the numerator first (100 for
    percentages). ``as_double=False`` returns the rounded value as an exact
    decimal, safe to sum further.
    """
    n = _c(num)
    if factor is not None:
        n = n * F.lit(factor)
    d = _c(den).cast("double")
    q = F.when(d != 0, n.cast("double") / d)
    r = round_half_away(q, scale)
    return r if as_double else r.cast(f"decimal(28,{scale})")


def period_start(period: str, as_of) -> Column:
    """First day (inclusive) of a period code ending at ``as_of`` (inclusive).

    Codes: ``1d`` (the day), ``Nd`` (last N days), ``1w`` (last 7 days),
    ``1m`` / ``mtd`` (calendar month to date), ``ytd`` (year to date),
    ``td`` (everything up to as_of → NULL start).
    """
    a = lit_date(as_of)
    p = period.lower()
    if p == "td":
        return F.lit(None).cast("date")
    if p in ("1m", "mtd"):
        return F.trunc(a, "month")
    if p == "ytd":
        return F.trunc(a, "year")
    if p == "1w":
        return F.date_sub(a, 6)
    if p.endswith("d") and p[:-1].isdigit():
        return F.date_sub(a, int(p[:-1]) - 1)
    raise ValueError(f"unknown period code {period!r}")


def in_period(date_col, period: str, as_of) -> Column:
    """Predicate: ``date_col`` lies in the period ending at ``as_of``."""
    d = _c(date_col)
    a = lit_date(as_of)
    if period.lower() == "td":
        return d <= a
    return (d >= period_start(period, as_of)) & (d <= a)
