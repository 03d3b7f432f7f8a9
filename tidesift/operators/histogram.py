"""Equal-width histogram per series: every value falls into the bin whose edges enclose it, the last bin is closed.

Bins span the finite values. Infinite ones are counted in rows of their own, bin -1 from and to -inf and one bin after
the last from and to inf; a series without any has no such row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _edges(low: float | None, high: float | None, bins: int) -> list[float]:
    if low is None:
        low, high = 0.0, 1.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    return [float(e) for e in np.linspace(low, high, bins + 1)]


def histogram(df: DataFrame, column: str, series: dict[str, Column], bins: int = 50) -> DataFrame:
    """Rows (series, bin, bin_start, bin_end, count), empty bins included, infinities in rows of their own.

    ``series`` maps a name to the predicate that selects its rows; every series has its own range. Series must not
    overlap: a row counts for the first one that holds.
    """
    x = F.col(column).cast("double")
    name = F.lit(None).cast("string")
    for label, predicate in reversed(list(series.items())):
        name = F.when(predicate, label).otherwise(name)
    rows = df.select(name.alias("series"), x.alias("x")).where("series is not null and x is not null")

    finite = F.when(F.abs("x") < math.inf, F.col("x"))
    ranges = {r["series"]: (r["low"], r["high"]) for r in
              rows.groupBy("series").agg(F.min(finite).alias("low"), F.max(finite).alias("high")).collect()}
    edges = {label: _edges(*ranges.get(label, (None, None)), bins) for label in series}

    # Per series its first edge, bins per unit and all edges, as one literal the row picks.
    spec = F.lit(None)
    for label, e in edges.items():
        own = F.struct(F.lit(e[0]).alias("first"), F.lit(bins / (e[-1] - e[0])).alias("per_unit"),
                       F.lit(e).alias("edges"))
        spec = F.when(F.col("series") == label, own).otherwise(spec)
    guess = F.floor((finite - F.col("s.first")) * F.col("s.per_unit"))
    last = F.lit(bins - 1)
    placed = (rows.withColumn("s", spec).withColumn("g", F.least(guess, last).cast("int"))
              .select("series", "x", "g", F.get("s.edges", F.col("g")).alias("low"),
                      F.get("s.edges", F.col("g") + 1).alias("high")))
    # The product can land one bin off; the edges decide.
    bin_column = (F.when(F.col("x") == math.inf, bins).when(F.col("x") == -math.inf, -1)
                  .when(F.col("x") < F.col("low"), F.col("g") - 1)
                  .when((F.col("x") >= F.col("high")) & (F.col("g") < last), F.col("g") + 1).otherwise(F.col("g")))
    counts = placed.groupBy("series", bin_column.alias("bin")).agg(F.count(F.lit(1)).alias("count"))

    frame = df.sparkSession.createDataFrame(
        [(label, i, e[i], e[i + 1]) for label, e in edges.items() for i in range(bins)],
        "series string, bin int, bin_start double, bin_end double")
    infinite = F.when(F.col("bin") < 0, -math.inf).otherwise(math.inf)
    return (frame.join(counts, ["series", "bin"], "full")
            .select("series", "bin", F.coalesce("bin_start", infinite).alias("bin_start"),
                    F.coalesce("bin_end", infinite).alias("bin_end"), F.coalesce("count", F.lit(0)).alias("count")))
