"""Reports on class predictions and on feature importances.

Everything after the first grouping works on a table of at most classes x classes rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import OUTLIER_CLASSES, RULES, RuleConfig
from ..functions import rules
from ..functions.measures import ratio
from ..operators.ranks import iqr_bounds
from ..schemas import CATEGORICAL_FEATURES


def _confusion_counts(predictions: DataFrame, truth: str, guess: str) -> DataFrame:
    return predictions.groupBy(F.col(truth).alias("t"), F.col(guess).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(predictions: DataFrame, truth: str = "true_class", guess: str = "pred_class") -> DataFrame:
    """Precision, recall, f1 and support per class, then accuracy (repeated in every column) and both averages."""
    counts = _confusion_counts(predictions, truth, guess)
    zero, n = F.lit(0).cast("long"), F.col("n")
    hit = F.when(F.col("t") == F.col("p"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("t").alias("label"), hit.alias("hits"), n.alias("support"), zero.alias("predicted")),
        F.struct(F.col("p").alias("label"), zero.alias("hits"), zero.alias("support"), n.alias("predicted")))
    per_label = counts.select(F.inline(sides)).groupBy("label").agg(
        F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    scored = per_label.select("label", "hits", "support", precision.alias("precision"), recall.alias("recall"))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    # A handful of rows from here on: gathered in label order, so the averages always add up in the same order.
    gathered = scored.withColumn("f1", f1).agg(F.array_sort(F.collect_list(
        F.struct("label", "precision", "recall", "f1", "support", "hits"))).alias("c"))

    def total(field: str, weighted: bool = False):
        def add(acc, c):
            return acc + (c[field] * c["support"] if weighted else c[field].cast("double"))
        return F.aggregate("c", F.lit(0.0), add)

    support, classes = total("support"), F.size("c").cast("double")
    accuracy = ratio(total("hits"), support)

    def row(label, p, r, f, s):
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1-score"),
                        s.alias("support"))

    fields = ("precision", "recall", "f1")
    summary = F.array(
        row("accuracy", accuracy, accuracy, accuracy, accuracy),
        row("macro avg", *[ratio(total(f), classes) for f in fields], support),
        row("weighted avg", *[ratio(total(f, True), support) for f in fields], support))
    classes_first = F.transform("c", lambda c: F.struct(
        c["label"].alias("label"), c["precision"].alias("precision"), c["recall"].alias("recall"),
        c["f1"].alias("f1-score"), c["support"].cast("double").alias("support")))
    return gathered.where(F.size("c") > 0).select(F.inline(F.concat(classes_first, summary)))


def confusion_matrix(predictions: DataFrame, truth: str = "true_class", guess: str = "pred_class",
                     labels: Sequence[str] = OUTLIER_CLASSES) -> DataFrame:
    """One row ``true_<label>`` and one column ``pred_<label>`` per class in the given order, zeros kept."""
    cells = [F.count_if((F.col("t") == t) & (F.col("p") == p)) for t in labels for p in labels]
    wide = (predictions.select(F.col(truth).alias("t"), F.col(guess).alias("p"))
            .agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]))
    k = len(labels)
    rows = [F.struct(F.lit(f"true_{t}").alias("index"),
                     *[F.col(f"c{i * k + j}").alias(f"pred_{p}") for j, p in enumerate(labels)])
            for i, t in enumerate(labels)]
    return wide.select(F.inline(F.array(*rows)))


def is_contextual(feature) -> object:
    """Encoded columns of the categorical features."""
    tests = [feature.startswith(f"{c}_") for c in CATEGORICAL_FEATURES]
    return tests[0] | tests[1]


def contextual_contribution(importances: DataFrame) -> DataFrame:
    """Share of the contextual features in the summed importance (one row)."""
    contextual = F.coalesce(F.sum(F.when(is_contextual(F.col("feature")), F.col("importance"))), F.lit(0.0))
    total = F.coalesce(F.sum("importance"), F.lit(0.0))
    sums = importances.agg(contextual.alias("Contextual_Importance_Sum"), total.alias("Total_Importance_Sum"))
    return sums.withColumn("Contextual_Contribution_%", ratio(F.col("Contextual_Importance_Sum"),
                                                              F.col("Total_Importance_Sum")) * 100.0)


def bucket_breakdown(importances: DataFrame) -> DataFrame:
    bucket = F.when(is_contextual(F.col("feature")), "Contextual").otherwise("Numeric/Temporal")
    return (importances.groupBy(bucket.alias("bucket")).agg(F.sum("importance").alias("importance"))
            .orderBy(F.desc("importance"), "bucket"))


def add_rule_class(invoices: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    """Class by the business rules alone; the fences come from the given invoices."""
    fences = iqr_bounds(invoices, ["total_qty", "invoice_revenue"], cfg.fence_k)
    return invoices.withColumn("rule_class", rules.business_class(
        F.col("avg_price"), F.col("total_qty"), F.col("invoice_revenue"), F.col("customer_type"),
        F.col("is_peak_season"), fences["total_qty"].high, fences["invoice_revenue"].high, cfg))


def rule_alignment(ruled: DataFrame) -> DataFrame:
    """How often the prediction agrees with the rules where a rule applies (one row, zeros if none does)."""
    counts = ruled.agg(F.count("rule_class").alias("Total_Rule_Applicable"),
                       F.count_if(F.col("rule_class") == F.col("pred_class")).alias("Aligned_Cases"))
    return counts.withColumn("Alignment_Rate_%", ratio(F.col("Aligned_Cases"),
                                                       F.col("Total_Rule_Applicable")) * 100.0)


def rule_alignment_breakdown(ruled: DataFrame) -> DataFrame:
    return (ruled.where(F.col("rule_class").isNotNull()).groupBy("rule_class", F.col("pred_class").alias("model_pred"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "rule_class", "model_pred"))
