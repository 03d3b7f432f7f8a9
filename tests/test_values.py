import datetime
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesift.functions import calendar
from tidesift.functions.values import clean_text, na_to_null, strip, to_number, to_timestamp

NUMBERS = {"1e3": 1000.0, " 12 ": 12.0, "\t7\n": 7.0, "abc": None, "inf": math.inf, "-Infinity": -math.inf,
           "nan": None, "NaN": None, "1,000": None, "1d": None, "1F": None, "2.5f ": None, "0x10": None, "0x1p3": None,
           "True": None, "": None, ".5": 0.5, "5.": 5.0, "+3": 3.0, "-0.05": -0.05, "1e": None, None: None, "--1": None}


def apply(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_numbers(spark):
    assert apply(spark, to_number, NUMBERS) == list(NUMBERS.values())


def test_typed_numbers(spark):
    df = spark.createDataFrame([(math.nan,), (1.5,), (None,), (math.inf,)], "v double")
    assert [r[0] for r in df.select(to_number(F.col("v"), T.DoubleType())).collect()] == [None, 1.5, None, math.inf]
    assert spark.range(3).select(to_number(F.col("id"), T.LongType())).collect()[2][0] == 2.0


def test_texts(spark):
    cases = {"\t a\n": "a", "  ": None, "": None, " nan ": None, "N/A": None, "None": None, "<NA>": None, "na": "na",
             "x y": "x y", " z　": "z", None: None, "007": "007"}
    assert apply(spark, clean_text, cases) == list(cases.values())
    assert apply(spark, strip, [" a "]) == ["a"]
    assert apply(spark, na_to_null, [" NA", "NA"]) == [" NA", None]


@pytest.mark.parametrize(("formats", "cases"), [
    ((), {"2024-01-05": (2024, 1, 5), "2024-01-05 10:30": (2024, 1, 5, 10, 30), "2024-01-05T10:30:15": (2024, 1, 5, 10, 30, 15),
          " 2024-02-29 ": (2024, 2, 29), "2023-02-29": None, "05/01/2024": None, "not-a-date": None, "": None}),
    (("dd/MM/yyyy", "yyyy-MM-dd"), {"05/01/2024": (2024, 1, 5), "2024-01-05": (2024, 1, 5), "2024-01-05 10:30": None}),
])
def test_timestamps(spark, formats, cases):
    want = [v and datetime.datetime(*v) for v in cases.values()]
    assert apply(spark, lambda c: to_timestamp(c, formats=formats), cases) == want


def test_calendar(spark):
    days = [datetime.datetime(2024, 9, d) for d in range(2, 9)]  # Monday to Sunday
    df = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz")
    got = df.select("d", *[c.alias(n) for n, c in calendar.temporal_features(F.col("d")).items()])
    rows = got.orderBy("d").collect()
    assert [r.day_of_week for r in rows] == list(range(7))
    assert rows[0].day_name == "Monday" and rows[6].day_name == "Sunday"
    assert [r.is_weekend for r in rows] == [False] * 5 + [True] * 2
    assert all(r.is_peak_season and not r.is_off_season and r.quarter == 3 and r.year == 2024 for r in rows)
