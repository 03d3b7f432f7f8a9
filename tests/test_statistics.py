"""Exact statistics against the plain formula on random data."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidesift.functions.measures import exact_sum
from tidesift.operators import ranks
from tidesift.operators.histogram import histogram
from tidesift.operators.ranks import exact_quantiles, iqr_bounds, melt, ranked_values
from tidesift.operators.trimmed import trimmed_mean

few = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
money = st.one_of(st.integers(-50, 50).map(float), st.floats(-1e12, 1e12).map(lambda v: round(v, 2)),
                  st.sampled_from([0.0, 1e-300, -1e-300, 1e300, 0.1, 99.99]))


def column(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


@few
@given(values=st.lists(money, min_size=1, max_size=60), gather=st.sampled_from([0, 3, 1000]))
def test_every_rank(spark, values, gather):
    got = ranked_values(melt(column(spark, values), ["x"]), lambda _, n: range(n), gather)["x"]
    ordered = sorted(values)
    assert got.n == len(values)
    assert [got.values[r] for r in range(got.n)] == ordered
    assert all(got.smaller[r] == sum(v < ordered[r] for v in values) for r in got.values if r in got.smaller)


@few
@given(values=st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=50), p=st.floats(0, 1))
def test_quantile_matches_numpy(spark, values, p):
    got = exact_quantiles(column(spark, values), {"x": [p]}, 4)["x"][p]
    assert got == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-6)


def test_many_rows_need_several_rounds(spark):
    """More rows than are gathered, one third of them equal, long tails."""
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(
        F.exp(F.rand(7) * 40 - 20)).alias("x"), (F.col("id") % 11).cast("double").alias("y")).cache()
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, {"x": probabilities, "y": probabilities}, 200)
    want = df.toPandas()
    for c in ("x", "y"):
        assert [got[c][p] for p in probabilities] == pytest.approx([want[c].quantile(p) for p in probabilities],
                                                                   rel=1e-12)


def test_two_scans_settle_the_quantiles(spark, monkeypatch):
    """One scan for the sketches, one that counts; more only where the brackets hold too many rows or a sketch misses a rank."""
    df = spark.range(60_000).select(((F.col("id") * 7919 % 60_013) / 7.0).alias("x"), (F.col("id") % 1000).cast("double").alias("y"))
    x = np.arange(60_000) * 7919 % 60_013 / 7.0
    y = np.arange(60_000) % 1000
    wanted = {"x": (0.01, 0.25, 0.5, 0.75, 0.99), "y": (0.0, 0.25, 1.0)}
    want = {"x": {p: pytest.approx(np.quantile(x, p)) for p in wanted["x"]}, "y": {p: pytest.approx(np.quantile(y, p)) for p in wanted["y"]}}
    scans, counts = [], ranks._counts
    monkeypatch.setattr(ranks, "_counts", lambda long, *keys: scans.append(keys) or counts(long, *keys))
    assert exact_quantiles(df, wanted) == want and scans == [("grp", "slot", "part")]
    scans.clear()
    assert exact_quantiles(df, wanted, gather_rows=200) == want  # cut into parts, and again
    assert scans[0] == ("grp", "slot", "part") and ("cell", "part") not in scans[:1]
    monkeypatch.setattr(ranks, "SKETCH_K", 8)
    monkeypatch.setattr(ranks, "BRACKET", 1e-5)
    scans.clear()
    assert exact_quantiles(df, wanted) == want  # a rough sketch and narrow brackets miss ranks
    assert ("grp", "cell") in scans


def test_missing_and_infinite(spark):
    df = column(spark, [None, math.nan, 1.0, math.inf, -math.inf, 3.0])
    got = ranked_values(melt(df, ["x"]), lambda _, n: range(n), 0)["x"]
    assert [got.values[i] for i in range(4)] == [-math.inf, 1.0, 3.0, math.inf]
    empty = exact_quantiles(column(spark, [None]), {"x": [0.5]})
    assert empty == {"x": {0.5: None}}
    assert iqr_bounds(column(spark, [None]), ["x"])["x"] == (None, None)


def test_fences(spark):
    low, high = iqr_bounds(column(spark, [1.0, 2.0, 3.0, 4.0]), ["x"])["x"]
    assert (low, high) == (1.75 - 1.5 * 1.5, 3.25 + 1.5 * 1.5)


def test_counts_stay_small(spark):
    """What reaches the driver in the first pass depends on the spread of the values, not on their number."""
    df = spark.range(20_000).select(F.lit("g").alias("grp"), (F.rand(1) * 1e6).alias("x"))
    cells = df.groupBy(ranks._relative_cell(F.col("x"))).count().count()
    assert cells < ranks.CELLS_PER_OCTAVE * 40


def plain_trimmed(values, share=0.05):
    s = sorted(values)
    k = int(len(s) * share)
    s = s[k:len(s) - k] if len(s) > 2 * k else s
    return sum(s) / len(s) if s else 0.0


@few
@given(values=st.lists(st.integers(-30, 30).map(lambda v: v / 4), max_size=50),
       share=st.sampled_from([0.0, 0.05, 0.25, 0.6]))
def test_trimmed_mean(spark, values, share):
    got = trimmed_mean(column(spark, values), "x", share).collect()[0][0]
    assert got == pytest.approx(plain_trimmed(values, share), abs=1e-12)


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 41])
def test_trimmed_mean_sizes(spark, n):
    values = [float(i * i) for i in range(n)]
    got = trimmed_mean(column(spark, [*values, None, math.nan]), "x").collect()[0][0]
    assert got == pytest.approx(plain_trimmed(values))


@few
@given(values=st.lists(st.floats(-1e6, 1e6).map(lambda v: round(v, 3)), min_size=1, max_size=80),
       bins=st.sampled_from([1, 7, 50]))
def test_histogram_matches_numpy(spark, values, bins):
    rows = histogram(column(spark, values), "x", {"all": F.lit(True), "none": F.lit(False)}, bins).collect()
    counts, edges = np.histogram(values, bins)
    got = sorted((r["bin"], r["bin_start"], r["bin_end"], r["count"]) for r in rows if r["series"] == "all")
    assert [g[3] for g in got] == counts.tolist()
    assert [g[1] for g in got] + [got[-1][2]] == edges.tolist()
    empty = [r for r in rows if r["series"] == "none"]
    assert len(empty) == bins and sum(r["count"] for r in empty) == 0
    assert min(r["bin_start"] for r in empty) == 0.0 and max(r["bin_end"] for r in empty) == 1.0


def test_histogram_of_a_constant(spark):
    rows = histogram(column(spark, [4.0] * 3), "x", {"all": F.lit(True)}, 50).collect()
    counts, _ = np.histogram([4.0] * 3, 50)
    assert [r["count"] for r in sorted(rows, key=lambda r: r["bin"])] == counts.tolist()


def test_histogram_lists_infinities(spark):
    rows = histogram(column(spark, [1.0, 2.0, 3.0, math.inf, math.inf, -math.inf, None]), "x", {"all": F.lit(True)}, 2).collect()
    got = sorted((r["bin"], r["bin_start"], r["bin_end"], r["count"]) for r in rows)
    assert got == [(-1, -math.inf, -math.inf, 1), (0, 1.0, 2.0, 1), (1, 2.0, 3.0, 2), (2, math.inf, math.inf, 2)]
    rows = histogram(column(spark, [math.inf]), "x", {"all": F.lit(True)}, 1).collect()
    assert sorted((r["bin"], r["count"]) for r in rows) == [(0, 0), (1, 1)]


@pytest.mark.parametrize(("values", "share", "want"), [
    ([1.0, 2.0, math.inf, math.inf], 0.25, math.inf), ([1.0, 2.0, 3.0, math.inf], 0.25, 2.5), ([-math.inf, 1.0, 2.0], 0.0, -math.inf),
    ([1e-9, 2e-9, 3e-9], 0.34, 2e-9), ([1.0, math.inf, math.inf, math.inf, math.inf], 0.2, math.inf)])
def test_trimmed_mean_of_infinities_and_tiny_values(spark, values, share, want):
    assert trimmed_mean(column(spark, values), "x", share).collect()[0][0] == pytest.approx(want, rel=1e-12)


def total(df, **kwargs):
    return df.agg(exact_sum(df, "x", **kwargs).alias("s")).first().s


@pytest.mark.parametrize(("values", "want"), [
    ([4e-7] * 1000, 4e-4), ([1e-20] * 50, 5e-19), ([8.9e12, 9.1e12, 0.25], 1.8e13 + 0.25), ([1e24, 1.0, -1e24], 1.0), ([1e30, 2.0], 1e30),
    ([math.inf, 1.0], math.inf), ([0.1] * 10, 1.0), ([], None), ([None], None), ([-0.0, 0.0], 0.0)])
def test_sums_of_doubles(spark, values, want):
    got = total(column(spark, values))
    assert got is None if want is None else got == pytest.approx(want, rel=1e-12)
    assert len({total(column(spark, values).repartition(k)) for k in (1, 3, 7)}) == 1


@few
@given(values=st.lists(st.floats(-1e14, 1e14), min_size=1, max_size=60), seed=st.integers(0, 3))
def test_sums_are_those_of_fsum(spark, values, seed):
    df = column(spark, values)
    assert total(df) == pytest.approx(math.fsum(values), rel=1e-15, abs=1e-18)
    chosen = [v for v in values if v > 0]
    assert total(df, where=F.col("x") > 0) == (pytest.approx(math.fsum(chosen), rel=1e-15) if chosen else None)


@pytest.mark.parametrize("values", [[51032059839686.0, -45773416017873.5], [9.87654321987654e24, -9.87654321987653e24], [-2.0**42 - 0.125, 2.0**43 + 0.25]])
def test_sums_of_large_amounts_keep_all_digits(spark, values):
    assert total(column(spark, values)) == math.fsum(values)
