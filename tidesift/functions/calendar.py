"""Calendar features; weekdays count from Monday = 0 and names are English."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RULES, RuleConfig


def day_of_week(c: Column) -> Column:
    return F.weekday(c)


def day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def floor_to(unit: str, c: Column) -> Column:
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def season_features(c: Column, cfg: RuleConfig = RULES) -> dict[str, Column]:
    month, weekday = F.month(c), day_of_week(c)
    return {
        "month": month,
        "day_of_week": weekday,
        "is_weekend": weekday.isin(*cfg.weekend_days),
        "is_peak_season": month.isin(*cfg.peak_months),
        "is_off_season": month.isin(*cfg.off_months),
    }


def temporal_features(c: Column, cfg: RuleConfig = RULES) -> dict[str, Column]:
    return {"year": F.year(c), "quarter": F.quarter(c), "day_name": day_name(c), **season_features(c, cfg)}
