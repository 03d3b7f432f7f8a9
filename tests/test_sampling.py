import hashlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidesift.operators.sampling import sample_rows, share_by_class, stratified_split


def place(key, seed):
    return hashlib.md5(f"{key}-{seed}".encode()).hexdigest()


@pytest.mark.parametrize(("sizes", "share"), [((10, 20, 30), 0.2), ((2, 3, 50), 0.25), ((7, 7, 7), 0.2)])
def test_split(spark, sizes, share):
    rows = [(f"{c}{i}", c) for c, n in zip("abc", sizes, strict=True) for i in range(n)]
    got = stratified_split(spark.createDataFrame(rows, "k string, c string"), "k", "c", share, 42).collect()
    want = share_by_class(dict(zip("abc", sizes, strict=True)), share)
    assert sum(want.values()) == -(-sum(sizes) * share // 1)
    assert Counter(r.c for r in got if r.is_test) == Counter({c: n for c, n in want.items() if n})
    for c, n in want.items():
        first = sorted((k for k, kind in rows if kind == c), key=lambda k: place(k, 42))[:n]
        assert {r.k for r in got if r.is_test and r.c == c} == set(first)
    assert len(got) == len(rows)


def test_split_needs_two_rows_per_class(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "k string, c string")
    with pytest.raises(ValueError, match="at least two rows"):
        stratified_split(df, "k", "c", 0.2, 42)
    with pytest.raises(ValueError, match="at least two rows"):
        stratified_split(df.where("false"), "k", "c", 0.2, 42)


def double_text(x):
    units = round(x * 2**20)
    return f"{units}:{round((x - units / 2**20) * 2**80)}"


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.tuples(st.integers(0, 6), st.sampled_from([1.0, 2.0, 0.1])), min_size=1, max_size=60),
       size=st.integers(1, 70))
def test_sample_is_exact_and_repeatable(spark, values, size):
    """Also when a third of the rows are copies of one another; every copy has a place of its own."""
    df = spark.createDataFrame(values, "k int, x double")
    got = [tuple(r) for r in sample_rows(df, size, 42).collect()]
    copies = [(v, n + 1) for v, total in Counter(values).items() for n in range(total)]
    want = [v for v, n in sorted(copies, key=lambda c: place(f"{c[0][0]}|{double_text(c[0][1])}#{c[1]}", 42))[:size]]
    assert sorted(got) == sorted(want)
    again = [tuple(r) for r in sample_rows(df.repartition(3), size, 42).collect()]
    assert sorted(again) == sorted(got)


def test_a_hot_row_gets_its_share(spark):
    """Over many seeds the number of taken rows of a key that holds half of all stays within what chance allows."""
    rows = [("hot", float(n), 1.0) for n in range(60)] + [("hot", 1.0, 2.0)] * 40 + [(f"c{n}", 1.0, 1.0) for n in range(100)]
    df = spark.createDataFrame(rows, "k string, q double, p double").coalesce(1).cache()
    taken, copies = [], []
    for seed in range(200):
        # The places alone, as sample_rows uses them: far fewer jobs.
        def at(row, n):
            return place(f"{row[0]}|{double_text(row[1])}|{double_text(row[2])}#{n}", seed)

        numbered = [(v, n + 1) for v, total in Counter(rows).items() for n in range(total)]
        first = [v for v, n in sorted(numbered, key=lambda c: at(*c))[:40]]
        taken.append(sum(v[0] == "hot" for v in first))
        copies.append(first.count(("hot", 1.0, 2.0)))
    # Hypergeometric: 40 of 200, 100 (40) of them in question.
    assert abs(sum(taken) / 200 - 20) < 4 * (40 * 0.25 * 160 / 199 / 200) ** 0.5
    assert abs(sum(copies) / 200 - 8) < 4 * (40 * 0.16 * 160 / 199 / 200) ** 0.5
    for seed in (3, 4):
        assert sum(r.k == "hot" for r in sample_rows(df, 40, seed).collect()) == taken[seed]
