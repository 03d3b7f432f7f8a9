"""Exact order statistics and quantiles by counting, without a global sort.

The built-in exact ``percentile`` sends every distinct value to one task. Here a first scan makes a mergeable quantile sketch of every
group, which brackets each wanted rank between two values. A second scan counts what lies below, between and inside the brackets; inside by
value, so that the ranks are read off. Both scans combine in the tasks and send a bounded number of rows. Two more ways make the result exact
whatever the data look like:

* Where the brackets hold too many rows to count them by value, they are cut into equal parts, and the part that holds a wanted rank again
  between its own smallest and largest value, until few enough are left.
* Where a sketch has missed a rank, which it may do by chance, the whole range of doubles is counted in cells of about 2 % relative width
  first, and the cells are then cut in the same way.

A rank is settled as soon as its cell has a single value. The driver sees counts only, whose number is bounded by the constants below.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Fences
from .staging import evaluated

CELLS_PER_OCTAVE = 32
CELLS_PER_SPLIT = 4096
GATHER_ROWS = 50_000
SKETCH_K = 4000
BRACKET = 0.002  # of all rows, to either side of a wanted rank: more than twice a sketch's usual error
_OCTAVES = 1100  # more than the exponents a double can have, on either side of 1
_INFINITY_CELL = 2 * _OCTAVES * CELLS_PER_OCTAVE


@dataclass
class Ranked:
    """``n`` values in the group; per wanted rank its value and how many values are strictly smaller."""

    n: int
    values: dict[int, float] = field(default_factory=dict)
    smaller: dict[int, int] = field(default_factory=dict)
    equal: dict[int, int] = field(default_factory=dict)


@dataclass(frozen=True)
class _Cell:
    group: str
    low: float
    high: float
    rows: int
    below: int


@dataclass
class _Bracket:
    low: float
    high: float
    ranks: list[int]


def _relative_cell(x: Column) -> Column:
    """Whole number that never falls when x rises, about 2 % of x wide."""
    size = F.abs(x)
    step = F.floor(F.log2(size) * F.lit(float(CELLS_PER_OCTAVE))) + F.lit(_OCTAVES * CELLS_PER_OCTAVE)
    magnitude = (F.when(size == 0, F.lit(0).cast("long"))
                 .when(size == F.lit(math.inf), F.lit(_INFINITY_CELL).cast("long")).otherwise(step))
    return F.when(x < 0, -magnitude).otherwise(magnitude)


def _counts(df: DataFrame, *keys: str) -> list:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("x").alias("low"),
                                 F.max("x").alias("high")).collect()


def _locate(rows: list, below: int, ranks: Iterable[int], group: str, out: Ranked) -> dict[_Cell, list[int]]:
    """Settle the ranks that a sorted run of cells decides; return the others by cell."""
    open_cells: dict[_Cell, list[int]] = {}
    todo = sorted(ranks)
    for r in rows:
        while todo and todo[0] < below + r["rows"]:
            rank = todo.pop(0)
            if r["low"] == r["high"]:
                out.values[rank], out.smaller[rank], out.equal[rank] = r["low"], below, r["rows"]
            else:
                cell = _Cell(group, r["low"], r["high"], r["rows"], below)
                open_cells.setdefault(cell, []).append(rank)
        below += r["rows"]
    return open_cells


def _bracketed(long: DataFrame, wanted: Callable[[str, int], Iterable[int]]) -> tuple[dict[str, Ranked], dict[str, list[_Bracket]]]:
    """The first scan: each group's size, and disjoint brackets in which its wanted ranks are to be found."""
    sketched = long.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"),
                                       F.kll_sketch_agg_double("x", F.lit(SKETCH_K)).alias("sketch")).collect()
    found: dict[str, Ranked] = {}
    asked: dict[str, list[tuple[int, float, float]]] = {}
    for r in sketched:
        out = found[r["grp"]] = Ranked(r["n"])
        places = {k: k / max(out.n - 1, 1) for k in wanted(r["grp"], out.n) if 0 <= k < out.n}
        asked[r["grp"]] = [(k, max(0.0, p - BRACKET), min(1.0, p + BRACKET)) for k, p in sorted(places.items())]
    # Places must be literals: all groups are asked for the places of all.
    every = sorted({p for ranks in asked.values() for _, a, b in ranks for p in (a, b)})
    if not every:
        return found, {}
    read = long.sparkSession.createDataFrame([(r["grp"], r["sketch"]) for r in sketched], "grp string, sketch binary").select(
        "grp", F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in every])).alias("values")).collect()
    values = {r["grp"]: dict(zip(every, r["values"], strict=True)) for r in read}
    ends = [{"grp": r["grp"], "rank": k, "low": r["low"] if a <= 0 else values[r["grp"]][a], "high": r["high"] if b >= 1 else values[r["grp"]][b]}
            for r in sketched for k, a, b in asked[r["grp"]]]
    brackets: dict[str, list[_Bracket]] = {}
    for r in sorted(ends, key=lambda r: (r["grp"], r["low"])):
        own = brackets.setdefault(r["grp"], [])
        if own and r["low"] <= own[-1].high:
            own[-1].high = max(own[-1].high, r["high"])
            own[-1].ranks.append(r["rank"])
        else:
            own.append(_Bracket(r["low"], r["high"], [r["rank"]]))
    return found, brackets


def _part_of_bracket(brackets: dict[str, list[_Bracket]]) -> Column:
    """Number of the equal part of its bracket that a value falls into."""
    ends = None
    for group, own in brackets.items():
        for i, b in enumerate(own):
            here, both = (F.col("grp") == F.lit(group)) & (F.col("slot") == 2 * i + 1), F.struct(F.lit(b.low).alias("low"), F.lit(b.high).alias("high"))
            ends = F.when(here, both) if ends is None else ends.when(here, both)
    width = ends["high"] - ends["low"]
    share = F.when(width > 0, (F.col("x") - ends["low"]) / width).otherwise(F.lit(0.0))
    return F.least(F.floor(share * F.lit(float(CELLS_PER_SPLIT))), F.lit(CELLS_PER_SPLIT - 1).cast("long"))


def _count_brackets(long: DataFrame, brackets: dict[str, list[_Bracket]], found: dict[str, Ranked], gather_rows: int) -> tuple[dict, dict]:
    """The second scan: ranks it settles go to ``found``; cells still open, and ranks that lie in no bracket, by group."""
    x, slot = F.col("x"), None
    for group, own in brackets.items():
        for i, b in enumerate(own):
            for place, reached in ((2 * i, x < F.lit(b.low)), (2 * i + 1, x <= F.lit(b.high))):
                here = (F.col("grp") == F.lit(group)) & reached
                slot = F.when(here, F.lit(place)) if slot is None else slot.when(here, F.lit(place))
    expected = sum(2 * BRACKET * found[g].n * len(b.ranks) for g, own in brackets.items() for b in own)
    by_value = expected <= gather_rows
    placed = evaluated(long, F.col("grp").alias("grp"), x.alias("x"), slot.alias("slot")).where(F.col("slot").isNotNull())
    part = F.col("x") if by_value else _part_of_bracket(brackets)
    counted: dict[tuple[str, int], list] = {}
    for r in _counts(placed.withColumn("part", F.when(F.col("slot") % 2 == 1, part)), "grp", "slot", "part"):
        counted.setdefault((r["grp"], r["slot"]), []).append(r)
    open_cells: dict[_Cell, list[int]] = {}
    missed: dict[str, list[int]] = {}
    for group, own in brackets.items():
        below = 0
        for i, b in enumerate(own):
            below += sum(r["rows"] for r in counted.get((group, 2 * i), ()))
            rows = sorted(counted.get((group, 2 * i + 1), ()), key=lambda r: r["low"])
            held = sum(r["rows"] for r in rows)
            inside_ranks = [k for k in b.ranks if below <= k < below + held]
            missed.setdefault(group, []).extend(k for k in b.ranks if k not in inside_ranks)
            open_cells.update(_locate(rows, below, inside_ranks, group, found[group]))
            below += held
    return open_cells, {g: ranks for g, ranks in missed.items() if ranks}


def _count_cells(long: DataFrame, missed: dict[str, list[int]], found: dict[str, Ranked]) -> dict[_Cell, list[int]]:
    """Cells over the whole range of doubles, for the ranks that no bracket holds."""
    open_cells: dict[_Cell, list[int]] = {}
    by_group: dict[str, list] = {}
    own = long.where(F.col("grp").isin(list(missed)))
    for r in _counts(own.withColumn("cell", _relative_cell(F.col("x"))), "grp", "cell"):
        by_group.setdefault(r["grp"], []).append(r)
    for group, rows in by_group.items():
        rows.sort(key=lambda r: r["low"])
        open_cells.update(_locate(rows, 0, missed[group], group, found[group]))
    return open_cells


def ranked_values(long: DataFrame, wanted: Callable[[str, int], Iterable[int]],
                  gather_rows: int = GATHER_ROWS) -> dict[str, Ranked]:
    """Order statistics of ``x`` within each ``grp`` of ``long``.

    ``grp`` (text) may have a handful of values. ``wanted(grp, n)`` names 0-based ranks. NULL and NaN are ignored.
    """
    long = long.where(F.col("x").isNotNull() & ~F.isnan("x"))
    found, brackets = _bracketed(long, wanted)
    open_cells, missed = _count_brackets(long, brackets, found, gather_rows) if brackets else ({}, {})
    if missed:
        open_cells.update(_count_cells(long, missed, found))
    while open_cells:
        cells = list(open_cells)
        gather = sum(c.rows for c in cells) <= gather_rows
        picked = _rows_in(long, cells)
        if gather:
            counted = [{"cell": r["cell"], "rows": r["rows"], "low": r["x"], "high": r["x"]}
                       for r in picked.groupBy("cell", "x").agg(F.count(F.lit(1)).alias("rows")).collect()]
        else:
            counted = _counts(picked, "cell", "part")
        parts: dict[int, list] = {}
        for r in counted:
            parts.setdefault(r["cell"], []).append(r)
        narrowed: dict[_Cell, list[int]] = {}
        for i, cell in enumerate(cells):
            rows = sorted(parts[i], key=lambda r: r["low"])
            narrowed.update(_locate(rows, cell.below, open_cells[cell], cell.group, found[cell.group]))
        open_cells = narrowed
    return found


def _rows_in(long: DataFrame, cells: Sequence[_Cell]) -> DataFrame:
    """Rows inside the open cells with the cell's number and the part of the cell they fall into."""
    x = F.col("x")
    home = None
    for i, c in enumerate(cells):
        inside = (F.col("grp") == F.lit(c.group)) & x.between(F.lit(c.low), F.lit(c.high))
        spot = F.struct(F.lit(i).alias("i"), F.lit(c.low).alias("low"), F.lit(c.high).alias("high"))
        home = F.when(inside, spot) if home is None else home.when(inside, spot)
    share = (x - F.col("home.low")) / (F.col("home.high") - F.col("home.low"))
    part = F.least(F.floor(share * F.lit(float(CELLS_PER_SPLIT))), F.lit(CELLS_PER_SPLIT - 1).cast("long"))
    return (long.withColumn("home", home).where(F.col("home").isNotNull())
            .select("x", F.col("home.i").alias("cell"), part.alias("part")))


def melt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per (column name, value): all columns are then counted in the same pass."""
    if len(columns) == 1:
        return evaluated(df, F.lit(columns[0]).alias("grp"), F.col(columns[0]).cast("double").alias("x"))
    pairs = F.array(*[F.struct(F.lit(c).alias("grp"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(F.explode(pairs).alias("kv")).select("kv.grp", "kv.x")


def _neighbours(n: int, p: float) -> tuple[int, int]:
    position = (n - 1) * p
    return math.floor(position), math.ceil(position)


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]],
                    gather_rows: int = GATHER_ROWS) -> dict[str, dict[float, float | None]]:
    """Quantiles with linear interpolation between neighbouring values, for several columns at once."""
    ranked = ranked_values(
        melt(df, list(wanted)),
        lambda col, n: [r for p in wanted[col] for r in _neighbours(n, p)],
        gather_rows,
    )
    result: dict[str, dict[float, float | None]] = {}
    for column, probabilities in wanted.items():
        got = ranked.get(column)
        result[column] = {}
        for p in probabilities:
            if got is None:
                result[column][p] = None
                continue
            first, second = _neighbours(got.n, p)
            a, b = got.values[first], got.values[second]
            result[column][p] = a if a == b else a + (b - a) * ((got.n - 1) * p - first)
    return result


def iqr_fences(quantiles: Mapping[float, float | None], k: float) -> Fences:
    """Fences from the quartiles in ``quantiles``."""
    q1, q3 = quantiles[0.25], quantiles[0.75]
    if q1 is None:
        return Fences(None, None)
    spread = k * (q3 - q1)
    return Fences(q1 - spread, q3 + spread)


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, Fences]:
    quantiles = exact_quantiles(df, {c: (0.25, 0.75) for c in columns})
    return {c: iqr_fences(quantiles[c], k) for c in columns}
