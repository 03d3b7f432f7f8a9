"""Invoice-level data set of the outlier classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import OUTLIER_CLASSES, RULES, RuleConfig
from ..functions import calendar, rules
from ..functions.measures import exact_sum
from ..functions.rules import Fences
from ..operators.ranks import exact_quantiles, iqr_fences
from ..operators.staging import stage
from ..schemas import INVOICE_KEYS, MODEL_COLUMNS
from .distortion import invoiced


def invoice_features(lines: DataFrame) -> DataFrame:
    """Revenue, quantity, unweighted mean price and distinct products per invoice."""
    mean_price = exact_sum(lines, "price").cast("double") / F.count("price")
    return invoiced(lines).groupBy(*INVOICE_KEYS).agg(
        exact_sum(lines, "line_total").cast("double").alias("invoice_revenue"),
        exact_sum(lines, "quantity").cast("double").alias("total_qty"),
        mean_price.alias("avg_price"),
        F.count_distinct("product_id").alias("n_items"))


def dominant_category(lines: DataFrame) -> DataFrame:
    """Per invoice id the category of highest revenue; the alphabetically first among equals.

    Two combinable aggregations: revenue per (invoice, category), then the best pair. No sort, no window.
    """
    known = lines.dropna(subset=["invoice_id", "category"])
    revenue = known.groupBy("invoice_id", "category").agg(exact_sum(known, "line_total").alias("revenue"))
    best = F.min(F.struct((-F.col("revenue")).alias("key"), "category"))
    return (revenue.groupBy("invoice_id").agg(best.alias("best"))
            .select("invoice_id", F.col("best.category").alias("dominant_category")))


def label_invoices(invoices: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    """Season features, rule flags and outlier class of every invoice.

    All limits (tails and fences of revenue, fence of quantity) come from one set of counting passes.
    """
    q = exact_quantiles(invoices, {"invoice_revenue": (cfg.low_tail, 0.25, 0.75, cfg.high_tail),
                                   "total_qty": (0.25, 0.75)})
    revenue_q = q["invoice_revenue"]
    tails = Fences(revenue_q[cfg.low_tail], revenue_q[cfg.high_tail])
    revenue_high = iqr_fences(revenue_q, cfg.fence_k).high
    quantity_high = iqr_fences(q["total_qty"], cfg.fence_k).high
    kind, quantity, revenue = F.col("customer_type"), F.col("total_qty"), F.col("invoice_revenue")
    return (
        invoices.withColumns(calendar.season_features(F.col("date"), cfg))
        .withColumns({"is_statistical_outlier": rules.in_tails(revenue, tails),
                      "is_harmful": rules.harmful(F.col("avg_price"), quantity, cfg)})
        .withColumn("is_strategic", rules.strategic(kind, quantity, revenue, F.col("is_harmful"), quantity_high,
                                                    revenue_high, cfg))
        .withColumn("is_benign", rules.benign(kind, quantity, F.col("is_statistical_outlier"), F.col("is_harmful"),
                                              F.col("is_strategic"), quantity_high, cfg))
        .withColumn("outlier_class", rules.outlier_class(F.col("is_harmful"), F.col("is_strategic"),
                                                         F.col("is_benign")))
    )


def labelled_invoices(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    """``label_invoices`` of the lines' invoices, without the dominant category."""
    return label_invoices(stage(invoice_features(lines), "invoice-features"), cfg)


def model_dataset(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    """Invoices in the revenue tails with all features and labels.

    Labels do not depend on the category and 98 % of the invoices are in no tail: only the lines of those that are
    go into the category's aggregations.
    """
    tails = labelled_invoices(lines, cfg).where("is_statistical_outlier")
    own = lines.join(tails.select("invoice_id").distinct(), "invoice_id", "left_semi")
    return tails.join(dominant_category(own), "invoice_id", "left").select(*MODEL_COLUMNS)


def outliers_only(dataset: DataFrame) -> DataFrame:
    """The three outlier classes, without Normal."""
    return dataset.where(F.col("outlier_class").isin(*OUTLIER_CLASSES))


def class_distribution(dataset: DataFrame) -> DataFrame:
    return (dataset.groupBy("outlier_class").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "outlier_class"))
