"""Aggregate and arithmetic expressions shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COARSE, _FINE = 2.0**20, 2.0**80  # units per 1 of the two parts a double is summed in
_BIGINT = 2.0**42  # below it a whole number of coarse units fits a bigint, which converts faster; the number is the same
_HALF = 2.0**44  # larger whole numbers of coarse units are split by it
_HUGE = 1e25  # from here on, and for infinities, the coarse units of many rows would not fit a decimal


def exact_sum(df: DataFrame, column: str, where: Column | None = None) -> Column:
    """Sum that does not depend on row order or partitioning.

    Decimal input is summed as it is. A double is split, without rounding, into a multiple of 2^-20 and a rest that is
    kept to 2^-80; both parts are summed as whole numbers. So a value is off by 2^-81 at most, and the total is rounded
    to a double once. Amounts of 1e25 and more, and infinities, are added as doubles next to it.
    """
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.DecimalType):
        return F.sum(c if where is None else F.when(where, c))
    c = c.cast("double")
    fits = F.abs(c) < _HUGE
    if where is not None:
        c, fits = F.when(where, c), F.when(where, fits)
    units = F.rint(c * _COARSE)
    # A double becomes a decimal by its shortest text, which can lack the last digits; as two whole numbers it keeps all of them.
    upper = (units / _HALF).cast("bigint")
    lower = (units - upper.cast("double") * _HALF).cast("bigint")
    halves = upper.cast("decimal(19,0)") * F.lit(int(_HALF)).cast("decimal(14,0)") + lower.cast("decimal(19,0)")
    whole = (F.when(F.abs(c) < _BIGINT, units.cast("bigint").cast("decimal(38,0)"))
             .when(fits, halves.cast("decimal(38,0)")))
    rest = F.when(fits, F.rint((c - units / _COARSE) * _FINE).cast("bigint").cast("decimal(18,0)"))
    small = F.sum(whole).cast("double") / _COARSE + F.sum(rest).cast("double") / _FINE
    large = F.sum(F.when(~fits, c))
    return F.when(large.isNull(), small).otherwise(large + F.coalesce(small, F.lit(0.0)))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, 0.0 on a zero or missing base."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def or_zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def signed_distortion(with_value: Column, without_value: Column) -> Column:
    """Percent by which the value with harmful rows differs from the one without; 0.0 on a zero base."""
    return F.coalesce(F.try_divide(with_value - without_value, without_value) * 100.0, F.lit(0.0))


def direction_label(direction: Column) -> Column:
    return (F.when(direction > 0, "Overestimation").when(direction < 0, "Underestimation").otherwise("No change"))
