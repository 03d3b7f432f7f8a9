"""Trimmed mean from two order statistics and one conditional sum; rows are neither sorted nor numbered."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import exact_sum
from ..functions.values import finite_or_null
from .ranks import melt, ranked_values


@dataclass(frozen=True)
class Trim:
    """``cut`` values go on each side of ``n``; ``low`` and ``high`` are the outermost values that stay."""

    n: int
    cut: int
    low: float | None
    high: float | None
    kind: T.DecimalType | None = None  # of decimal values, whose edges are added as decimals


def trim_limits(df: DataFrame, column: str, share: float) -> Trim:
    def cut_of(n: int) -> int:
        k = math.floor(n * share)
        return k if n > 2 * k else 0

    ranked = ranked_values(melt(df, [column]), lambda _, n: [cut_of(n), n - 1 - cut_of(n)]).get(column)
    if ranked is None:
        return Trim(0, 0, None, None)
    k, kind = cut_of(ranked.n), df.schema[column].dataType
    return Trim(ranked.n, k, ranked.values[k], ranked.values[ranked.n - 1 - k],
                kind if isinstance(kind, T.DecimalType) else None)


def trim_parts(df: DataFrame, column: str, trim: Trim) -> dict[str, Column]:
    """Aggregates that can be summed up further; ``trimmed_mean_of`` puts them together."""
    x = finite_or_null(F.col(column).cast("double"))
    low, high = F.lit(trim.low).cast("double"), F.lit(trim.high).cast("double")
    return {
        "kept_inside": exact_sum(df, column, (x > low) & (x < high)),
        "at_or_below": F.count_if(x <= low),
        "at_or_above": F.count_if(x >= high),
    }


def trimmed_mean_of(inside: Column, at_or_below: Column, at_or_above: Column, trim: Trim) -> Column:
    if trim.n == 0:
        return F.lit(0.0)
    if trim.low == trim.high:
        return F.lit(trim.low)
    # Ties at a limit are cut one by one: what is left of them counts with the limit's value.
    below, above = at_or_below - trim.cut, at_or_above - trim.cut
    kept = F.lit(float(trim.n - 2 * trim.cut))
    if trim.kind is None:
        # An infinite limit none of whose copies stays must not turn into NaN.
        edges = [F.when(n > 0, F.lit(limit) * n).otherwise(0.0) for limit, n in ((trim.low, below), (trim.high, above))]
        return (F.coalesce(inside.cast("double"), F.lit(0.0)) + (edges[0] + edges[1])) / kept
    scale = trim.kind.scale
    low, high = (F.lit(limit).cast(T.DecimalType(min(38, trim.kind.precision + 4), scale)) for limit in (trim.low, trim.high))
    zero = F.lit(0).cast(T.DecimalType(38, scale))
    total = F.coalesce(inside.cast(T.DecimalType(38, scale)), zero) + (low * below + high * above)
    return total.cast("double") / kept


def trimmed_mean(df: DataFrame, column: str, share: float = 0.05) -> DataFrame:
    """One row: the mean without the ``share`` smallest and largest values; 0.0 without any value."""
    trim = trim_limits(df, column, share)
    parts = df.agg(*[c.alias(name) for name, c in trim_parts(df, column, trim).items()])
    mean = trimmed_mean_of(F.col("kept_inside"), F.col("at_or_below"), F.col("at_or_above"), trim)
    return parts.select(mean.alias("trimmed_mean"))
