"""Outlier rules as boolean column expressions.

Thresholds that come from the data arrive as plain numbers (see ``operators.ranks``), so a rule is an ordinary predicate with
literals: no join. Comparisons are left bare, since a filter wrapped in ``coalesce`` never reaches the scan. Their inputs
(measures of prepared lines and of invoices) have no NULL; with one, a rule is NULL, which a filter and ``when`` take
for False. ``holds`` turns that into False where it becomes a column of its own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BENIGN, HARMFUL, NORMAL, RULES, STRATEGIC, RuleConfig


class Fences(NamedTuple):
    """Lower and upper limit; None when the input had no values."""

    low: float | None
    high: float | None


def holds(predicate: Column) -> Column:
    """A comparison with NULL counts as False."""
    return F.coalesce(predicate, F.lit(False))


def above(c: Column, limit: float | None) -> Column:
    return F.lit(False) if limit is None else c > F.lit(limit)


def at_most(c: Column, limit: float | None) -> Column:
    return F.lit(False) if limit is None else c <= F.lit(limit)


def outside(c: Column, fences: Fences) -> Column:
    """Strictly beyond either fence."""
    if fences.low is None:
        return F.lit(False)
    return (c < F.lit(fences.low)) | (c > F.lit(fences.high))


def is_segment(c: Column, name: str) -> Column:
    return F.lower(c).eqNullSafe(F.lit(name))


def harmful(price: Column, quantity: Column, cfg: RuleConfig = RULES) -> Column:
    """Data-quality errors: no or next to no price, no quantity, or an impossible quantity."""
    return (price <= 0) | (quantity <= 0) | (price < F.lit(cfg.min_price)) | (quantity > F.lit(cfg.max_quantity))


def strategic(customer_type: Column, quantity: Column, revenue: Column, is_harmful: Column,
              quantity_high: float | None, revenue_high: float | None, cfg: RuleConfig = RULES) -> Column:
    """Wholesaler bulk orders, or clean orders of very high value."""
    bulk = is_segment(customer_type, cfg.wholesaler) & above(quantity, quantity_high)
    return bulk | (above(revenue, revenue_high) & ~is_harmful)


def benign(customer_type: Column, quantity: Column, is_outlier: Column, is_harmful: Column, is_strategic: Column,
           quantity_high: float | None, cfg: RuleConfig = RULES) -> Column:
    """Statistically extreme private purchases without any other finding."""
    return (is_outlier & is_segment(customer_type, cfg.private) & ~is_harmful & ~is_strategic
            & at_most(quantity, quantity_high))


def in_tails(c: Column, tails: Fences) -> Column:
    """At or beyond the outer percentiles."""
    if tails.low is None:
        return F.lit(False)
    return (c >= F.lit(tails.high)) | (c <= F.lit(tails.low))


def outlier_class(is_harmful: Column, is_strategic: Column, is_benign: Column) -> Column:
    return F.when(is_harmful, HARMFUL).when(is_strategic, STRATEGIC).when(is_benign, BENIGN).otherwise(NORMAL)


def business_class(price: Column, quantity: Column, revenue: Column, customer_type: Column, is_peak: Column,
                   quantity_high: float | None, revenue_high: float | None, cfg: RuleConfig = RULES) -> Column:
    """Class the business rules alone suggest, NULL where none applies."""
    bulk = is_segment(customer_type, cfg.wholesaler) & above(quantity, quantity_high)
    seasonal = holds(is_peak) & above(revenue, revenue_high)
    return F.when(harmful(price, quantity, cfg), HARMFUL).when(bulk | seasonal, STRATEGIC)
