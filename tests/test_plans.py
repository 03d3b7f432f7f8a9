"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as registry
from helpers import frame, line, plan_of
from tidesift.operators import constraints
from tidesift.operators.staging import stage
from tidesift.plans import dataset, distortion, retention
from tidesift.plans.lines import integrate_lines

QUERIES = registry.report_queries()
NOT_ALLOWED = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas",
               "FlatMapGroupsInPandas")
TRAINED = {"rf_predictions", "rf_classification_report", "retrain_predictions", "rf_prediction_rows", "retrain_prediction_rows"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED - {"permutation_importance"}))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not [word for word in NOT_ALLOWED if word in plan]
    if name not in ("top_features_per_run", "topk_jaccard", "shap_importance", "rf_shap_importance"):  # a row per run and rank, or per feature
        assert "Window" not in plan


@pytest.mark.parametrize("name", ["distortion_summary", "distortion_by_segment", "rq2_meta", "daily_revenue", "dow_profile",
                                  "rq2_invoice_level", "dominant_category"])
def test_each_table_is_scanned_once(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for table in ("orders", "lineitem", "customer", "part"):
        assert len(re.findall(rf"FileScan parquet.*/{table}\.parquet", plan)) <= 1


def test_columns_are_pruned(spark, sf_dir):
    lines = registry.stored_lines(spark, sf_dir)
    read = re.findall(r"ReadSchema: struct<([^\n]*)", plan_of(retention.revenue_bias(retention.flag_lines(lines))))
    assert read and all("item" not in r and "product_id" not in r and "category" not in r for r in read)


def test_one_large_shuffle_for_the_kpis(spark, sf_dir):
    plan = plan_of(distortion.distortion_summary(registry.stored_lines(spark, sf_dir)))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_filters_reach_the_scan(spark, sf_dir):
    lines = registry.stored_lines(spark, sf_dir)
    assert "TakeOrderedAndProject" in plan_of(distortion.top_harmful(lines))
    plain = stage(lines.withColumn("line_total", lines.line_total.cast("double")), "double-lines")

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")

    def pushed(df):
        return " ".join(re.findall(r"PushedFilters: (\[[^\n]*)", plan_of(df)))

    assert "LessThanOrEqual(price,0.0)" in pushed(distortion.top_harmful(plain))
    flagged = retention.flag_lines(plain)
    for report in (retention.top_strategic(flagged), retention.retention_by_category(flagged)):
        assert "GreaterThan(line_total," in pushed(report)
    tails = dataset.labelled_invoices(plain).where("is_statistical_outlier")
    assert "GreaterThanOrEqual(invoice_revenue," in pushed(tails)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_checks_read_the_columns_they_check(spark, sf_dir):
    tables = registry.keyed_raw(spark, sf_dir)
    read = dict(re.findall(r"FileScan parquet.*?/(\w+)\.parquet.*?ReadSchema: struct<([^\n]*)>", plan_of(
        constraints.null_counts(tables["invoice_items"], ("invoice_id", "product_id")))))
    assert "l_quantity" not in read["lineitem"] and "l_extendedprice" not in read["lineitem"]
    for check in (constraints.check_not_null, constraints.check_duplicate_keys, constraints.check_orphans):
        plan = plan_of(check(tables))
        assert "l_quantity" not in plan and "l_extendedprice" not in plan and "o_orderdate" not in plan


def test_tables_of_a_report_share_one_scan(spark, sf_dir):
    """Three tables of distortion and four of retention come from staged sums, the lines are read once for each."""
    lines = registry.stored_lines(spark, sf_dir)
    tables = distortion.distortion_tables(lines)
    assert all("/per-id-sums" in plan_of(t) and "/lines-" not in plan_of(t) for t in tables.values())
    assert rows(tables["Summary"]) == rows(distortion.distortion_summary(lines))
    assert rows(tables["Meta"]) == rows(distortion.meta(lines))
    assert rows(tables["Segments"]) == rows(distortion.distortion_by_segment(lines))
    flagged = retention.flag_lines(lines)
    tables = retention.retention_tables(flagged)
    assert all("/retention-cells" in plan_of(t) and "/lines-" not in plan_of(t) for t in tables.values())
    assert rows(tables["Overall"]) == rows(retention.retention_overall(flagged))
    assert rows(tables["Segments"]) == rows(retention.retention_by_segment(flagged))
    assert rows(tables["Categories"]) == rows(retention.retention_by_category(flagged))
    assert rows(tables["Months"]) == rows(retention.retention_by_month(flagged))
    assert plan_of(retention.retention_by_segment(flagged)).count("FileScan") == 1


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_a_hot_join_key_is_split(spark):
    """Adaptive execution splits the partition of a key that holds a third of the lines, below the aggregation too."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "30KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
                "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        invoice = "if(id % 3 = 0, 'hot', concat('i', id % 5000))"
        tables = {
            "invoice_items": spark.range(0, n, 1, 8).selectExpr(
                f"{invoice} invoice_id", "concat('p', pmod(hash(id), 40)) product_id", "1.0D quantity", "2.0D unit_price",
                "cast(id as double) line_total"),
            "purchases": stage(spark.range(n).selectExpr(f"{invoice} invoice_id").distinct().selectExpr(
                "invoice_id", "timestamp_ntz'2024-01-01' purchase_date", "concat('c', pmod(hash(invoice_id), 9)) customer_id"),
                "test-purchases"),
            "customers": stage(spark.range(9).selectExpr("concat('c', id) customer_id", "'private' customer_type"), "test-customers"),
            "products": stage(spark.range(40).selectExpr("concat('p', id) product_id", "'x' item", "'A' category", "1.0D price"),
                              "test-products")}
        report = distortion.invoice_level(integrate_lines(tables))
        rows = {r.invoice_id: r for r in report.collect()}
        assert rows["hot"].revenue == sum(range(0, n, 3)) and rows["hot"]["items"] == 40
        assert re.search(r"SortMergeJoin\(skew=true\) \[invoice_id", plan_of(report))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_double_money_is_order_independent(spark):
    rows = [line(f"i{n}", total=0.1 * n) for n in range(200)]
    df = frame(spark, rows)
    totals = {distortion.kpi_set(df.repartition(k)).collect()[0].Total_Revenue for k in (1, 3, 7)}
    assert len(totals) == 1
