"""Column-level helpers (rounding, ratios, dates, bands) and fixed labels."""

from basketry.functions import labels
from basketry.functions.scalar import (age_group, as_double, band, count_if, days_between,
                                       flag, mean, month_key, pct, product_type,
                                       purchase_band, ratio, round_half_up, sum_if,
                                       weekday_name, weekday_number)

__all__ = ["labels", "age_group", "as_double", "band", "count_if", "days_between", "flag",
           "mean", "month_key", "pct", "product_type", "purchase_band", "ratio",
           "round_half_up", "sum_if", "weekday_name", "weekday_number"]
