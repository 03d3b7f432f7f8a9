"""Line and invoice reports on small hand-made rows, against the two-copy definition in pandas."""

import datetime
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import DAY, frame, line, rows_of
from tidesift.config import RuleConfig
from tidesift.plans import dataset, distortion, retention
from tidesift.plans.lines import add_pricing_features, integrate_lines, prepare_lines

KEYS = ["invoice_id", "date", "customer_id", "customer_type"]


def random_lines(seed, n=400):
    """A third of all lines share one invoice, customer and product; headers of an id may disagree."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        hot = r.random() < 0.34
        out.append(line(
            invoice="hot" if hot else f"i{r.randrange(60)}", day=0 if hot else r.randrange(70),
            customer="hot" if hot else f"c{r.randrange(25)}", kind=r.choice(["private", "Wholesaler", "wholesaler", None]),
            product="hot" if hot else f"p{r.randrange(30)}", category=r.choice(["A", "B", "C", None]),
            quantity=r.choice([1.0, 2.0, 5.0, 300.0, 20000.0, 0.0]), price=r.choice([0.0, 0.05, 0.1, 9.5, 120.25]),
            total=None if r.random() < 0.8 else r.choice([0.0, 33.33, 1e6])))
    return out


def harmful(d):
    return (d.price <= 0) | (d.quantity <= 0) | (d.price < 0.1) | (d.quantity > 10000)


def kpis(d):
    d = d.dropna(subset=KEYS)
    total, i, c = d.line_total.sum(), d.invoice_id.nunique(), d.customer_id.nunique()
    return {"Total_Revenue": total, "AOV": total / i if i else 0.0, "Revenue_per_Customer": total / c if c else 0.0,
            "Invoices": i, "Customers": c}


@pytest.mark.parametrize("decimal", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_kpis_equal_the_two_copy_definition(spark, seed, decimal):
    df = frame(spark, random_lines(seed), decimal).cache()
    d = df.withColumn("line_total", F.col("line_total").cast("double")).toPandas()
    clean = d[~harmful(d)]
    for r in distortion.distortion_summary(df).collect():
        w, wo = kpis(d)[r.KPI], kpis(clean)[r.KPI]
        direction = (w - wo) / wo * 100 if wo else 0.0
        assert (r.With_Harmful, r.Without_Harmful) == pytest.approx((w, wo))
        assert (r["Distortion_Magnitude_%"], r["Distortion_Direction_%"]) == pytest.approx((abs(direction), direction))
    got = {(r.customer_type, r.KPI): (r.With_Harmful, r.Without_Harmful) for r in distortion.distortion_by_segment(df).collect()}
    want = {(s, k): (v, kpis(clean[clean.customer_type == s])[k]) for s in d.customer_type.dropna().unique()
            for k, v in kpis(d[d.customer_type == s]).items() if k in distortion.KPIS}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    meta = distortion.meta(df).collect()[0]
    assert tuple(meta) == pytest.approx((len(d), harmful(d).sum(), harmful(d).mean() * 100, kpis(d)["Invoices"], kpis(d)["Customers"]))


@pytest.mark.parametrize("seed", [3, 4])
def test_removal_reports(spark, seed):
    df = frame(spark, random_lines(seed), True).cache()
    d = df.withColumn("line_total", F.col("line_total").cast("double")).toPandas()

    def fences(s):
        a, b = s.quantile(0.25), s.quantile(0.75)
        return a - 1.5 * (b - a), b + 1.5 * (b - a)

    (lo, hi), (_, qhi) = fences(d.line_total), fences(d.quantity)
    out, harm = (d.line_total < lo) | (d.line_total > hi), harmful(d)
    strat = ((d.customer_type.str.lower() == "wholesaler") & (d.quantity > qhi)) | ((d.line_total > hi) & ~harm)
    flagged = retention.flag_lines(df)
    counts = {(r.is_outlier, r.is_harmful, r.is_strategic): r["count"] for r in
              flagged.groupBy("is_outlier", "is_harmful", "is_strategic").count().collect()}
    assert counts == pd.crosstab([out, harm, strat], "n")["n"].to_dict()

    blanket, context = d[~out].dropna(subset=KEYS), d[~harm].dropna(subset=KEYS)

    def aov(x):
        return x.line_total.sum() / x.invoice_id.nunique()

    revenue = context.groupby(KEYS).line_total.sum().sort_values()
    k = int(len(revenue) * 0.05)
    truth = revenue.iloc[k:len(revenue) - k].mean()
    b_err, c_err = abs(aov(blanket) - truth) / truth, abs(aov(context) - truth) / truth
    got = retention.aov_comparison(flagged).collect()[0]
    assert tuple(got) == pytest.approx((aov(blanket), aov(context), truth, b_err, c_err, (b_err - c_err) / b_err * 100,
                                        (aov(blanket) - truth) / truth * 100, (aov(context) - truth) / truth * 100))
    kept = d[out & strat]
    overall = retention.retention_overall(flagged).collect()[0]
    assert tuple(overall) == pytest.approx((d[out].line_total.sum(), kept.line_total.sum(),
                                            kept.line_total.sum() / d[out].line_total.sum() * 100))
    by_type = kept.groupby("customer_type").line_total.sum()
    got = {r.customer_type: (r.retained_strategic_revenue, r["share_%"]) for r in retention.retention_by_segment(flagged).collect()}
    assert got == {t: pytest.approx((v, v / by_type.sum() * 100)) for t, v in by_type.items()}
    month = {r.month: (r.blanket_revenue, r.context_revenue) for r in retention.monthly_comparison(flagged).collect()}
    want = pd.concat([x.groupby(x.date.dt.to_period("M").dt.to_timestamp()).line_total.sum() for x in (blanket, context)],
                     axis=1).fillna(0)
    assert month == {m.to_pydatetime(): pytest.approx(tuple(v)) for m, v in zip(want.index, want.to_numpy(), strict=True)}


def test_zero_bases(spark):
    bad = [line("a", kind="private", price=0.0, total=5.0), line("b", kind="shop", price=1.0, quantity=2.0)]
    rows = {(r.customer_type, r.KPI): r for r in distortion.distortion_by_segment(frame(spark, bad)).collect()}
    r = rows["private", "Total_Revenue"]
    assert (r.With_Harmful, r.Without_Harmful, r["Distortion_Magnitude_%"], r["Distortion_Direction_%"]) == (5.0, 0.0, 0.0, 0.0)
    assert rows["private", "AOV"].Without_Harmful == 0.0


def test_empty_input(spark):
    none = frame(spark, [])
    summary = distortion.distortion_summary(none).collect()
    assert [(r.With_Harmful, r.Direction_Label) for r in summary] == [(0.0, "No change")] * 3
    assert tuple(distortion.meta(none).collect()[0]) == (0, 0, None, 0, 0)
    flagged = retention.flag_lines(none)
    assert tuple(retention.retention_overall(flagged).collect()[0]) == (0.0, 0.0, 0.0)
    assert tuple(retention.aov_comparison(flagged).collect()[0]) == (0.0,) * 8
    assert dataset.model_dataset(none).count() == 0


def test_share_is_missing_on_a_zero_sum(spark):
    rows = [line(f"n{i}", total=float(i % 3)) for i in range(20)] + [line("x", total=900.0), line("y", total=-900.0, quantity=99.0, kind="wholesaler")]
    got = retention.retention_by_segment(retention.flag_lines(frame(spark, rows))).collect()
    assert {r.customer_type for r in got} == {"private", "wholesaler"} and all(r["share_%"] is None for r in got)


def test_top_lists_break_ties(spark):
    rows = [line(f"i{i:02d}", product=f"p{i}", price=0.01, total=7.0) for i in range(30)]
    got = distortion.top_harmful(frame(spark, rows)).collect()
    assert [r.invoice_id for r in got] == [f"i{i:02d}" for i in range(20)]


def test_weekdays_in_order(spark):
    rows = [line(f"i{d}", day=d, total=d + 1.0) for d in range(8)]
    got = rows_of(distortion.day_of_week_profile(frame(spark, rows)))
    assert got[0] == ("Monday", 2, 9.0) and [g[0] for g in got][-1] == "Sunday" and len(got) == 7


def test_daily_needs_both_sides(spark):
    rows = [line("a", 0), line("b", 1, price=0.0, total=3.0), line("c", 2), line("d", 2, price=0.0, total=4.0)]
    got = rows_of(distortion.daily_revenue(frame(spark, rows)))
    assert got == [(DAY, 10.0, 10.0), (DAY + datetime.timedelta(days=2), 14.0, 10.0)]


def test_dominant_category(spark):
    rows = [line("a", category="B", total=5.0), line("a", category="A", total=3.0), line("a", category="A", total=2.0),
            line("b", category=None, total=9.0), line("b", category="Z", total=1.0), line("c", category=None)]
    assert sorted(rows_of(dataset.dominant_category(frame(spark, rows)))) == [("a", "A"), ("b", "Z")]


def test_labels(spark):
    cfg = RuleConfig()
    rows = [line(f"n{i:03d}", quantity=10.0, price=10.0 + i % 7, kind="private" if i % 2 else "Wholesaler") for i in range(200)]
    rows += [line("harm", quantity=20000.0, price=50.0), line("bulk", quantity=500.0, kind="WHOLESALER", price=1.0),
             line("tiny", quantity=1.0, price=0.2, kind="private"), line("lost", kind=None)]
    got = {r.invoice_id: r for r in dataset.labelled_invoices(frame(spark, rows), cfg).collect()}
    assert got["harm"].outlier_class == "Harmful" and got["bulk"].outlier_class == "Strategic"
    assert got["tiny"].outlier_class == "Benign" and got["n003"].outlier_class == "Normal"
    assert "lost" not in got
    assert got["n000"].day_of_week == 0 and got["n000"].is_off_season and not got["n000"].is_weekend
    model = {r.invoice_id: r for r in dataset.model_dataset(frame(spark, rows), cfg).collect()}
    assert set(model) == {k for k, r in got.items() if r.is_statistical_outlier}
    assert model["harm"].dominant_category == "A"


def test_infinite_total_shows(spark):
    rows = [line("a", total=math.inf), line("b", total=2.0)]
    assert distortion.kpi_set(frame(spark, rows)).collect()[0].Total_Revenue == math.inf


def test_prepare_and_pricing(spark):
    raw = spark.createDataFrame([("i", "2024-01-02", "c", "private", "p", "x", "A", 0.0, "2", "3.5", "7"),
                                 ("i", "bad", "c", "private", "p", "x", "A", 4.0, "2", "3.5", "7"),
                                 ("i", "2024-01-02", "c", None, "p", "x", "A", 4.0, "2", "abc", "7")],
                                "invoice_id string, date string, customer_id string, customer_type string, product_id string, "
                                "item string, category string, product_price double, quantity string, price string, line_total string")
    got = add_pricing_features(prepare_lines(raw)).collect()
    assert len(got) == 1
    assert (got[0].day_of_week, got[0].day_name, got[0].price_discount_pct, got[0].calculated_line_total,
            got[0].line_total_error) == (1, "Tuesday", None, 7.0, 0.0)


def test_integration_fills_the_total(spark):
    tables = {
        "customers": spark.createDataFrame([("c", "private")], "customer_id string, customer_type string"),
        "products": spark.createDataFrame([("p", "x", "A", 9.0)], "product_id string, item string, category string, price double"),
        "purchases": spark.createDataFrame([("i", DAY, "c"), ("j", DAY, "zz")], "invoice_id string, purchase_date timestamp_ntz, customer_id string"),
        "invoice_items": spark.createDataFrame([("i", "p", 2.0, 3.0, None), ("j", "p", 2.0, 3.0, None), ("i", "q", 1.0, 1.0, 1.0)],
                                               "invoice_id string, product_id string, quantity double, unit_price double, line_total double")}
    got = integrate_lines(tables).collect()
    assert [(r.invoice_id, r.line_total, r.product_price) for r in got] == [("i", 6.0, 9.0)]
