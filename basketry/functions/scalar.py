"""Scalar column helpers shared by every operator.

Numeric policy (so results are identical across engines and independent of
evaluation order):

* money stays ``decimal`` until it is reported, so sums are exact;
* averages are ``cast(sum as double) / count`` of the non-null values;
* ratios are computed in double;
* every reported rounding goes through ``decimal(38,10)`` and rounds half
  away from zero, then is reported as double (1.005 -> 1.01);
* counts, tiles, day differences and date parts are reported as bigint.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions import labels as L


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(x: str | Column, n: int = 2) -> Column:
    """Round half away from zero on the decimal value, report as double."""
    return F.round(col(x).cast("decimal(38,10)"), n).cast("double")


def as_double(x: str | Column) -> Column:
    return col(x).cast("double")


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den in double; NULL when den is 0 or NULL (NULLIF semantics)."""
    return as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def pct_raw(num: str | Column, den: str | Column) -> Column:
    """100.0 * num / NULLIF(den, 0) in double, multiplied before dividing."""
    return ratio(F.lit(100.0) * as_double(num), den)


def pct(num: str | Column, den: str | Column, n: int = 2) -> Column:
    """ROUND(100.0 * num / NULLIF(den, 0), n)."""
    return round_half_up(pct_raw(num, den), n)


def mean(x: str | Column) -> Column:
    """AVG of the non-null values as cast(sum as double) / count."""
    return ratio(F.sum(col(x)), F.count(col(x)))


def count_if(cond: Column) -> Column:
    """COUNT(CASE WHEN cond THEN 1 END) as bigint."""
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as bigint."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def flag(cond: Column) -> Column:
    """CASE WHEN cond THEN 1 ELSE 0 END (int)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


# ---- dates ---------------------------------------------------------------

def month_key(ts: str | Column) -> Column:
    """'yyyy-MM' label of a date / timestamp."""
    return F.date_format(col(ts), "yyyy-MM")


def weekday_name(ts: str | Column) -> Column:
    return F.date_format(col(ts), "EEEE")


def weekday_number(ts: str | Column) -> Column:
    """Sunday = 1 ... Saturday = 7."""
    return F.dayofweek(col(ts)).cast("bigint")


def days_between(start: str | Column, end: str | Column) -> Column:
    """Calendar-day boundaries crossed from start to end (23:59 -> 00:01 is 1)."""
    return F.datediff(F.to_date(col(end)), F.to_date(col(start))).cast("bigint")


# ---- bands ---------------------------------------------------------------

def band(x: str | Column, spec: list[tuple]) -> Column:
    """CASE WHEN x BETWEEN lo AND hi THEN label ... ELSE last label END.

    NULL (or anything outside the listed ranges) falls into the last band.
    """
    x = col(x)
    out = None
    for label, lo, hi in spec[:-1]:
        cond = x.between(lo, hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(spec[-1][0]))


def purchase_band(n: str | Column) -> Column:
    return band(n, L.PURCHASE_BANDS)


def age_group(age: str | Column) -> Column:
    return band(age, L.AGE_BANDS)


def product_type(is_premium: str | Column) -> Column:
    return F.when(col(is_premium) == 1, F.lit(L.PREMIUM)).otherwise(F.lit(L.STANDARD))
