"""Queries over the given tables and the SQL their results are checked with."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import check_sql  # noqa: E402
import fixture_views  # noqa: E402
from tidesift.config import OUTLIER_CLASSES, ForestConfig  # noqa: E402
from tidesift.functions.values import clean_text, to_number, to_timestamp  # noqa: E402
from tidesift.operators import cleaning, constraints  # noqa: E402
from tidesift.operators.ranks import exact_quantiles, iqr_bounds  # noqa: E402
from tidesift.operators.staging import stage, staging_path  # noqa: E402
from tidesift.operators.trimmed import trimmed_mean  # noqa: E402
from tidesift.plans import classifier, dataset, distortion, evaluation, explain, forest, retention  # noqa: E402
from tidesift.plans.lines import (  # noqa: E402
    add_pricing_features,
    add_temporal_features,
    integrate_lines,
    is_harmful_line,
    prepare_lines,
)
from tidesift.session import tune  # noqa: E402
from tidesift.functions.dates import readings  # noqa: E402
from tidesift.sources.csv_tables import extra_records, first_date, read_csv, write_csv  # noqa: E402
from tidesift.sources.tables import load_tables, read_rejected  # noqa: E402

try:
    import corpus_pipeline
    from llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("llm", "llm.queries", "corpus_pipeline"):
        raise
    llm_queries = corpus_pipeline = None

FOREST = ForestConfig(num_trees=int(os.environ.get("TIDESIFT_TREES", "300")))

# What several queries of one application share, as they would share a loaded table or a trained model.
_shared: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]) -> object:
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


# ---- inputs -------------------------------------------------------------------------------------------------------
def line_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrated lines straight from the four tables, for the reports that scan once."""
    return prepare_lines(fixture_views.lines(tune(spark), sf_dir))


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integrated lines as a stored table, for the reports that need several passes."""
    return _once(spark, sf_dir, "lines", lambda: stage(line_view(spark, sf_dir), "lines"))


def flagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "flagged", lambda: retention.flag_lines(stored_lines(spark, sf_dir)))


def model_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the line view, which its two passes read by few columns: storing all lines would move several times as much."""
    return _once(spark, sf_dir, "model data",
                 lambda: stage(dataset.model_dataset(line_view(spark, sf_dir)), "model-data"))


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixture_views.raw(tune(spark), sf_dir)


def clean_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return cleaning.clean_tables(raw_tables(spark, sf_dir), ["src_row"])


def stored_clean(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The cleaned tables, written once as the processed files are."""
    return _once(spark, sf_dir, "clean tables",
                 lambda: {n: stage(df, f"clean-{n}") for n, df in clean_tables(spark, sf_dir).items()})


def keyed_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw tables under their final column names, ids cleaned, nothing removed."""
    def keyed(df: DataFrame) -> DataFrame:
        df = df.withColumnsRenamed({"CustomerID": "customer_id", "InvoiceID": "invoice_id"})
        return cleaning.rewrite(df, cleaning.texts(df, "customer_id", "product_id", "invoice_id"))

    return {n: keyed(df) for n, df in raw_tables(spark, sf_dir).items()}


def _turned(c: str):
    """The next outlier class: a wrong prediction."""
    names = F.array(*[F.lit(n) for n in OUTLIER_CLASSES])
    return F.get(names, F.array_position(names, F.col(c)).cast("int") % len(OUTLIER_CLASSES))


def fixed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outliers with a known share of wrong predictions."""
    data = dataset.outliers_only(model_data(spark, sf_dir))
    wrong = F.col("invoice_id") % 7 == 0
    return data.withColumns({"true_class": F.col("outlier_class"),
                             "pred_class": F.when(wrong, _turned("outlier_class")).otherwise(F.col("outlier_class"))})


def fixed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = dataset.outliers_only(model_data(spark, sf_dir)).select("invoice_id", "outlier_class")
    runs = data.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(5))))
    wrong = (F.col("invoice_id") + F.col("run")) % 11 == 0
    return runs.withColumn("pred_class", F.when(wrong, _turned("outlier_class")).otherwise(F.col("outlier_class")))


def yearly_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories ranked by revenue, one run per year."""
    known = line_view(spark, sf_dir).dropna(subset=["category"])
    scores = known.groupBy(F.year("date").alias("run"), F.col("category").alias("feature")).agg(
        F.sum("line_total").cast("double").alias("importance"))
    return explain.top_features_per_run(scores, FOREST.listed_features, "importance")


def _encoded(spark: SparkSession, sf_dir: str, share: float) -> classifier.Encoded:
    return _once(spark, sf_dir, f"encoded {share}",
                 lambda: classifier.split_and_encode(model_data(spark, sf_dir), share, FOREST))


def report_split(spark: SparkSession, sf_dir: str) -> classifier.Encoded:
    return _encoded(spark, sf_dir, FOREST.report_test_share)


def validation_split(spark: SparkSession, sf_dir: str) -> classifier.Encoded:
    return _encoded(spark, sf_dir, FOREST.validation_test_share)


def report_model(spark: SparkSession, sf_dir: str):
    return _once(spark, sf_dir, "report model",
                 lambda: classifier.train_forest(report_split(spark, sf_dir), FOREST.seed, FOREST))


def retrained(spark: SparkSession, sf_dir: str) -> list:
    return _once(spark, sf_dir, "retrained", lambda: explain.retrain(validation_split(spark, sf_dir), FOREST))


def fixed_forest(spark: SparkSession, encoded: classifier.Encoded) -> DataFrame:
    """The fixture's forest with features by their place in the encoding; one that is not encoded is 0 for all rows."""
    places = {f: i for i, f in enumerate(encoded.features)}
    absent = len(encoded.features)
    rows = [(t, n, None if f is None else places.get(f, absent), x, a, b, c) for t, n, f, x, a, b, c in fixture_views.forest_nodes()]
    return spark.createDataFrame(rows, forest.NODES)


def _scored_rows(frame: DataFrame) -> DataFrame:
    return frame.select("invoice_id", "outlier_class", forest.nonzero("features").alias("entries"))


def permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "permuted", lambda: explain.permutation_importances(
        retrained(spark, sf_dir), validation_split(spark, sf_dir), FOREST))


# ---- queries ------------------------------------------------------------------------------------------------------
def _on(make_input: Callable, report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report(make_input(spark, sf_dir))



def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = (0.01, 0.25, 0.5, 0.75, 0.99)
    found = exact_quantiles(stored_lines(spark, sf_dir), {"quantity": wanted, "line_total": wanted})
    return spark.createDataFrame([(c, p, v) for c, q in found.items() for p, v in q.items()],
                                 "column_name string, p double, value double")


def fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = iqr_bounds(stored_lines(spark, sf_dir), ["quantity", "line_total"])
    return spark.createDataFrame([(c, f.low, f.high) for c, f in found.items()],
                                 "column_name string, low double, high double")


def trimmed_invoice_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = retention.invoice_level(stored_lines(spark, sf_dir)).select("revenue")
    return trimmed_mean(stage(invoices, "invoice-revenue"), "revenue")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw products with names that need quoting and a padded header to CSV, read back, cleaned, to CSV, read back."""
    quoted = spark.sql(fixture_views.QUOTED, products=raw_tables(spark, sf_dir)["products"])
    raw = write_csv(quoted.withColumnRenamed("price", " price "), staging_path(spark, "raw-products"))
    clean = write_csv(cleaning.clean_products(read_csv(spark, raw)), staging_path(spark, "clean-products"))
    return read_csv(spark, clean, "product_id string, item string, category string, price double")


def csv_extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of two files with different column orders and records of too many fields, read without these; how many they are."""
    folder = staging_path(spark, "raw-products")
    records = spark.sql(fixture_views.CSV_RECORDS, products=raw_tables(spark, sf_dir)["products"])
    for i, header in enumerate(fixture_views.CSV_HEADERS):
        own = records.where(F.col("file") == i).select(F.lit(1).alias("place"), "record")
        lines = spark.createDataFrame([(0, header)], "place int, record string").union(own)
        lines.repartition(1).sortWithinPartitions("place", "record").select("record").write.mode("append").text(folder)
    return read_csv(spark, folder, extra_fields="drop").withColumn("n_extra", F.lit(extra_records(spark, folder)).cast("bigint"))


def inferred_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers from files whose dates are written day first, and month first, cleaned with the format that the first date has."""
    raw, day = raw_tables(spark, sf_dir)["purchases"], F.col("date")
    year, month, dom = F.substring(day, 1, 4), F.substring(day, 6, 2), F.substring(day, 9, 2)
    found = []
    for notation, parts in (("day first", (dom, month, year)), ("month first", (month, dom, year))):
        turned = raw.withColumn("date", F.when(day.rlike("^[0-9]"), F.concat_ws("/", *parts)).otherwise(day))
        # The first rows, which decide, have a day that no month has.
        decides = turned.withColumn("decides", F.col("date").rlike("(^|/)(1[3-9]|2[0-9]|3[01])/"))
        # Sorted by all columns: by the first two alone, nearly all rows would be one key, one task and one file.
        placed = decides.orderBy("src_row", F.desc("decides"), "InvoiceID", "date", "CustomerID").drop("src_row", "decides")
        path = write_csv(placed, staging_path(spark, "purchases"))
        formats = readings(first_date(spark, path))
        headers = read_csv(spark, path, file_order=True)
        found.append(cleaning.clean_purchases(headers, formats=formats[:1]).withColumn("notation", F.lit(notation)))
    return found[0].unionByName(found[1])


def refresh_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full refresh of the stored tables; rows loaded and set aside per table."""
    target = staging_path(spark, "tables")
    tables = load_tables(stored_clean(spark, sf_dir), target, on_violation="quarantine")

    def counts(frames: dict[str, DataFrame], name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias(name)) for n, df in frames.items()])

    rejected = {n: read_rejected(spark, target, n) for n in tables}
    return counts(tables, "loaded").join(counts(rejected, "rejected"), "table_name")


def coerced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = raw_tables(spark, sf_dir)["invoice_items"]
    return items.select(F.col("InvoiceID").alias("invoice_id"),
                        *[to_number(F.col(c)).alias(c) for c in ("quantity", "price", "line_total")])


def trimmed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_tables(spark, sf_dir)["customers"].select(
        F.col("CustomerID").alias("raw_id"), clean_text(F.col("CustomerID")).alias("customer_id"),
        F.col("customer_type").alias("raw_type"), clean_text(F.col("customer_type")).alias("customer_type"))


def coerced_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_tables(spark, sf_dir)["purchases"].select(
        F.col("InvoiceID").alias("invoice_id"), F.col("date").alias("raw_date"),
        to_timestamp(F.col("date")).alias("purchase_date"))


def first_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = raw_tables(spark, sf_dir)["purchases"].dropna(subset=["InvoiceID"])
    renamed = headers.withColumnsRenamed({"InvoiceID": "invoice_id", "CustomerID": "customer_id"})
    return cleaning.first_per_key(renamed, "invoice_id", ["src_row"])


def american_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers whose dates are written month first in one of the two sources, cleaned with both formats."""
    raw = raw_tables(spark, sf_dir)["purchases"]
    day = F.col("date")
    turned = F.concat_ws("/", F.substring(day, 6, 2), F.substring(day, 9, 2), F.substring(day, 1, 4))
    mixed = raw.withColumn("date", F.when((F.col("src_row") == 0) & day.rlike("^[0-9]"), turned).otherwise(day))
    return cleaning.clean_purchases(mixed, ["src_row"], ("MM/dd/yyyy", "yyyy-MM-dd"))


def kpis_of_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs of money as doubles far below a cent, rounded for the comparison only."""
    small = line_view(spark, sf_dir).withColumn("line_total", F.col("line_total").cast("double") / F.lit(7000003.0))
    return distortion.kpi_set(small).withColumns({
        "Total_Revenue": F.round("Total_Revenue", 3), "AOV": F.round("AOV", 6),
        "Revenue_per_Customer": F.round("Revenue_per_Customer", 6)})


def _shown(invoices: DataFrame) -> DataFrame:
    """Mean prices to six decimals, as the check SQL shows them."""
    return invoices.withColumn("avg_price", F.round("avg_price", 6))


def _clean_one(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: cleaning.clean_tables({name: raw_tables(spark, sf_dir)[name]}, ["src_row"])[name]


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "ruled", lambda: evaluation.add_rule_class(fixed_predictions(spark, sf_dir)))


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.feature_importance(report_model(spark, sf_dir), report_split(spark, sf_dir).features)


def _with_total(scores: DataFrame) -> DataFrame:
    """Features next to the rounded sum of all scores."""
    gathered = scores.agg(F.collect_list("feature").alias("features"), F.round(F.sum("importance"), 6).alias("total_importance"))
    return gathered.select(F.explode("features").alias("feature"), "total_importance")


def fixed_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under encoded feature names: revenue per customer type and category, and two totals."""
    money = F.col("line_total")
    scores = F.array(
        F.struct(F.concat(F.lit("customer_type_"), "customer_type").alias("feature"), money.alias("score")),
        F.struct(F.concat(F.lit("dominant_category_"), "category").alias("feature"), money.alias("score")),
        F.struct(F.lit("invoice_revenue").alias("feature"), money.alias("score")),
        F.struct(F.lit("n_items").alias("feature"), F.lit(1).cast("decimal(20,6)").alias("score")))
    return (line_view(spark, sf_dir).select(F.inline(scores)).dropna(subset=["feature"]).groupBy("feature")
            .agg(F.sum("score").alias("importance")))


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.predict(report_model(spark, sf_dir), report_split(spark, sf_dir)).select(
        "invoice_id", "true_class", "pred_class")


def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes and classes of all labelled outliers by the fixture's forest."""
    encoded = report_split(spark, sf_dir)
    rows, names = _scored_rows(encoded.frame), F.array(*[F.lit(c) for c in fixture_views.FOREST_CLASSES])
    voted = forest.votes(rows, fixed_forest(spark, encoded), ["invoice_id"])
    return rows.join(voted, "invoice_id").select(
        "invoice_id", F.col("outlier_class").alias("true_class"), F.get(names, forest.winner()).alias("pred_class"),
        *[F.get("votes", F.lit(i)).alias(c) for i, c in enumerate(fixture_views.FOREST_CLASSES)])


def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = report_split(spark, sf_dir)
    return forest.impurity_importance(fixed_forest(spark, encoded), encoded.features).withColumn("importance", F.round("importance", 9))


def permutation_importance_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation importance of all encoded features for the fixture's forest, whose classes are the labels' names."""
    encoded = validation_split(spark, sf_dir)
    label = (F.array_position(F.array(*[F.lit(c) for c in fixture_views.FOREST_CLASSES]), F.col("outlier_class")) - 1).cast("double")
    numbered, n = explain.number_rows(encoded.test.select("invoice_id", "features", label.alias("label")), "invoice_id", FOREST.seed)
    found = explain.permutation_importance(explain.of_nodes(fixed_forest(spark, encoded)), encoded.features, numbered, n,
                                           FOREST.permutation_seed + 1, FOREST.permutation_repeats)
    return found.select("feature", F.round("importance_mean", 9).alias("importance_mean"), F.round("importance_std", 9).alias("importance_std"))


def _fixed_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = report_split(spark, sf_dir)
    return _once(spark, sf_dir, "fixed shap", lambda: stage(
        forest.shap_values(_scored_rows(encoded.test), fixed_forest(spark, encoded), "invoice_id"), "shap"))


def shap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHAP values of the test part under the fixture's forest, by feature and class."""
    features = report_split(spark, sf_dir).features
    named = spark.createDataFrame(list(enumerate([*features, "absent"])), "feature int, name string")
    classes = F.array(*[F.lit(c) for c in fixture_views.FOREST_CLASSES])
    return _fixed_shap(spark, sf_dir).join(named, "feature").select(
        "invoice_id", F.col("name").alias("feature"), F.get(classes, F.col("class")).alias("class"), F.round("value", 9).alias("value"))


def shap_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = report_split(spark, sf_dir)
    found = forest.shap_importance(_fixed_shap(spark, sf_dir), encoded.features, fixture_views.FOREST_CLASSES, encoded.test.count())
    return found.withColumns({c: F.round(c, 9) for c in (*fixture_views.FOREST_CLASSES, "importance")})


def rf_shap_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.shap_report(report_model(spark, sf_dir), report_split(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return report_queries() | (llm_queries.QUERIES | {"pipeline": corpus_pipeline.run} if llm_queries else {})


def report_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    lines, stored, flagged, data = line_view, stored_lines, flagged_lines, model_data
    return {
        # sources, checks, cleaning
        "csv_roundtrip": csv_roundtrip,
        "csv_extra_fields": csv_extra_fields,
        "refresh_load": refresh_load,
        "check_duplicate_keys": _on(keyed_raw, constraints.check_duplicate_keys),
        "check_not_null": _on(keyed_raw, constraints.check_not_null),
        "check_orphans": _on(stored_clean, constraints.check_orphans),
        "integrated_lines": _on(stored_clean, integrate_lines),
        "drop_null_keys": _on(raw_tables, lambda t: cleaning.drop_missing(
            t["invoice_items"].select(F.col("InvoiceID").alias("invoice_id"), "product_id"), "invoice_id", "product_id")),
        "trim_text": trimmed_texts,
        "coerce_numeric": coerced_numbers,
        "range_filter": _on(coerced_numbers, lambda d: cleaning.in_range(d, ["quantity"], ["price"]).drop("line_total")),
        "coerce_timestamp": coerced_timestamps,
        "distinct_rows": _on(raw_tables, lambda t: cleaning.distinct_rows(t["customers"])),
        "dedupe_first": first_headers,
        "clean_customers": _clean_one("customers"),
        "clean_products": _clean_one("products"),
        "clean_purchases": _clean_one("purchases"),
        "clean_purchases_formats": american_purchases,
        "purchases_inferred_format": inferred_purchases,
        "clean_invoice_items": _clean_one("invoice_items"),
        # features and flags
        "temporal_features": _on(lines, lambda d: add_temporal_features(d).select(
            "invoice_id", "product_id", "date", "year", "quarter", "month", "day_of_week", "day_name", "is_weekend",
            "is_peak_season", "is_off_season")),
        "pricing_features": _on(lines, lambda d: add_pricing_features(d).select(
            "invoice_id", "product_id", "quantity", "price", "price_vs_product_price", "price_discount_pct",
            "calculated_line_total", "line_total_error")),
        "flag_harmful_lines": _on(lines, lambda d: d.select(
            "invoice_id", "product_id", "quantity", "price", "line_total", is_harmful_line().alias("is_harmful"))),
        "flag_stat_outlier_lines": _on(flagged, lambda d: d.select(
            "invoice_id", "product_id", "quantity", "price", "line_total", "is_outlier")),
        "flag_strategic_lines": _on(flagged, lambda d: d.select(
            "invoice_id", "product_id", "customer_type", "quantity", "price", "line_total", "is_strategic")),
        "quantiles": quantiles,
        "iqr_bounds": fences,
        "trimmed_mean": trimmed_invoice_mean,
        # distortion by harmful lines
        "distortion_summary": _on(lines, distortion.distortion_summary),
        "distortion_by_segment": _on(lines, distortion.distortion_by_segment),
        "kpi_set": _on(lines, distortion.kpi_set),
        "kpi_set_double": kpis_of_doubles,
        "rq2_meta": _on(lines, distortion.meta),
        "rq2_invoice_level": _on(lines, distortion.invoice_level),
        "top_harmful": _on(lines, distortion.top_harmful),
        "dow_profile": _on(lines, distortion.day_of_week_profile),
        "daily_revenue": _on(lines, distortion.daily_revenue),
        "weekly_distortion": _on(lines, distortion.weekly_distortion),
        "line_total_histogram": _on(stored, distortion.line_total_histogram),
        # blanket against context-aware removal
        "rq3_invoice_level": _on(lines, retention.invoice_level),
        "aov_comparison": _on(flagged, retention.aov_comparison),
        "revenue_bias": _on(flagged, retention.revenue_bias),
        "retention_overall": _on(flagged, retention.retention_overall),
        "retention_by_segment": _on(flagged, retention.retention_by_segment),
        "retention_by_category": _on(flagged, retention.retention_by_category),
        "retention_by_month": _on(flagged, retention.retention_by_month),
        "top_strategic": _on(flagged, retention.top_strategic),
        "monthly_comparison": _on(flagged, retention.monthly_comparison),
        "scatter_series": _on(stored, retention.scatter_series),
        # classifier data
        "rq1_invoice_features": _on(lines, lambda d: _shown(dataset.invoice_features(d))),
        "dominant_category": _on(lines, dataset.dominant_category),
        "rq1_labels": _on(stored, lambda d: _shown(dataset.labelled_invoices(d))),
        "rq1_model_dataset": _on(stored, lambda d: _shown(dataset.model_dataset(d))),
        "class_filter": _on(data, lambda d: dataset.outliers_only(d).select("invoice_id", "outlier_class")),
        "class_distribution": _on(data, dataset.class_distribution),
        "stratified_split": _on(report_split, lambda e: e.frame.select("invoice_id", "outlier_class", "is_test")),
        "model_features": _on(report_split, lambda e: classifier.sparse_features(e).withColumn(
            "value", F.when(F.col("feature") == "avg_price", F.round("value", 6)).otherwise(F.col("value")))),
        # reports on fixed predictions
        "classification_report": _on(fixed_predictions, evaluation.classification_report),
        "confusion_matrix": _on(fixed_predictions, evaluation.confusion_matrix),
        "business_rules": _on(_rules, lambda d: d.select("invoice_id", "rule_class")),
        "rule_alignment": _on(_rules, evaluation.rule_alignment),
        "rule_alignment_breakdown": _on(_rules, evaluation.rule_alignment_breakdown),
        "contextual_contribution": _on(fixed_importances, evaluation.contextual_contribution),
        "bucket_breakdown": _on(fixed_importances, lambda d: evaluation.bucket_breakdown(d).withColumn(
            "importance", F.col("importance").cast("double"))),
        "prediction_stability": _on(fixed_runs, explain.prediction_stability),
        "top_features_per_run": yearly_ranking,
        "topk_jaccard": _on(yearly_ranking, lambda d: explain.topk_jaccard(d).withColumn(
            "Top3_Feature_Consistency_Jaccard", F.round("Top3_Feature_Consistency_Jaccard", 9))),
        # a fixed forest as a table of nodes
        "forest_predictions": forest_predictions,
        "forest_importance": forest_importance,
        "permutation_importance_fixed": permutation_importance_fixed,
        "shap_values": shap_values,
        "shap_importance": shap_importance,
        # the trained model: no SQL can restate it
        "rf_predictions": model_predictions,
        "rf_classification_report": _on(model_predictions, evaluation.classification_report),
        "rf_prediction_rows": _on(model_predictions, lambda d: d.drop("pred_class")),
        "retrain_prediction_rows": lambda spark, sf_dir: explain.retrain_predictions(
            retrained(spark, sf_dir), validation_split(spark, sf_dir)).drop("pred_class"),
        "feature_importance_names": _on(importances, _with_total),
        "permutation_importance_names": lambda spark, sf_dir: permuted(spark, sf_dir).select("run", "feature"),
        "feature_importance": importances,
        "rf_shap_importance": rf_shap_importance,
        "rf_contextual_contribution": _on(importances, evaluation.contextual_contribution),
        "rf_bucket_breakdown": _on(importances, evaluation.bucket_breakdown),
        "retrain_predictions": lambda spark, sf_dir: explain.retrain_predictions(
            retrained(spark, sf_dir), validation_split(spark, sf_dir)),
        "permutation_importance": permuted,
    }


def oracle_sql() -> dict[str, str]:
    return check_sql.SQL | (llm_queries.SQL if llm_queries else {})


def entry(spark: SparkSession) -> DataFrame:
    return queries()["distortion_summary"](spark, "/root/testdata/sf0.001")
