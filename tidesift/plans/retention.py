"""Blanket removal of statistical outliers against removal of harmful lines only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RULES, RuleConfig
from ..functions import calendar, rules
from ..functions.measures import exact_sum, or_zero, ratio
from ..operators.ranks import iqr_bounds
from ..operators.sampling import sample_rows
from ..operators.staging import stage
from ..operators.trimmed import trim_limits, trim_parts, trimmed_mean_of
from ..schemas import INVOICE_KEYS
from .distortion import invoiced
from .lines import is_harmful_line


def flag_lines(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    """Lines with ``is_outlier``, ``is_harmful`` and ``is_strategic``; both fences come from the same passes."""
    fences = iqr_bounds(lines, ["quantity", "line_total"], cfg.fence_k)
    harmful = is_harmful_line(cfg)
    total = F.col("line_total").cast("double")
    return lines.withColumns({
        "is_outlier": rules.outside(total, fences["line_total"]),
        "is_harmful": harmful,
        "is_strategic": rules.strategic(F.col("customer_type"), F.col("quantity"), total, harmful,
                                        fences["quantity"].high, fences["line_total"].high, cfg),
    })


def invoice_level(lines: DataFrame) -> DataFrame:
    return (invoiced(lines).groupBy(*INVOICE_KEYS)
            .agg(exact_sum(lines, "line_total").cast("double").alias("revenue")))


def invoices_by_treatment(flagged: DataFrame) -> DataFrame:
    """Per invoice the revenue either treatment leaves (NULL when it leaves no line)."""
    return invoiced(flagged).groupBy(*INVOICE_KEYS).agg(
        exact_sum(flagged, "line_total", ~F.col("is_outlier")).alias("blanket_revenue"),
        exact_sum(flagged, "line_total", ~F.col("is_harmful")).alias("context_revenue"),
    )


def _per_invoice_id(invoices: DataFrame, extra: dict) -> DataFrame:
    """Sums per invoice id: an id is counted once even if its lines disagree on the header."""
    return invoices.groupBy("invoice_id").agg(
        exact_sum(invoices, "blanket_revenue").alias("blanket"),
        exact_sum(invoices, "context_revenue").alias("context"),
        *[c.alias(n) for n, c in extra.items()])


def aov_comparison(flagged: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    """Average order value of both treatments against the trimmed mean of the clean invoices (one row).

    The invoice frame is staged once: finding the trim limits takes a few scans of a single column of it.
    """
    invoices = stage(invoices_by_treatment(flagged).select("invoice_id", "blanket_revenue", "context_revenue"),
                     "invoices-by-treatment")
    trim = trim_limits(invoices, "context_revenue", cfg.trim)
    parts = trim_parts(invoices, "context_revenue", trim)
    per_id = _per_invoice_id(invoices, parts)
    totals = per_id.agg(
        exact_sum(per_id, "blanket").alias("blanket"), F.count("blanket").alias("blanket_n"),
        exact_sum(per_id, "context").alias("context"), F.count("context").alias("context_n"),
        *[F.sum(n).alias(n) for n in parts])
    truth = trimmed_mean_of(*[F.col(n) for n in parts], trim)
    b, c, t = F.col("AOV_Blanket"), F.col("AOV_ContextAware"), F.col("AOV_GroundTruth_Trimmed")
    b_err, c_err = F.col("Baseline_Error_Magnitude"), F.col("Context_Error_Magnitude")
    return (
        totals.select(ratio(F.col("blanket"), F.col("blanket_n")).alias("AOV_Blanket"),
                      ratio(F.col("context"), F.col("context_n")).alias("AOV_ContextAware"),
                      F.coalesce(truth, F.lit(0.0)).alias("AOV_GroundTruth_Trimmed"))
        .withColumns({"Baseline_Error_Magnitude": ratio(F.abs(b - t), t),
                      "Context_Error_Magnitude": ratio(F.abs(c - t), t)})
        .withColumns({"Improvement_Rate_%": ratio(b_err - c_err, b_err) * 100.0,
                      "Baseline_Bias_%": ratio(b - t, t) * 100.0,
                      "Context_Bias_%": ratio(c - t, t) * 100.0})
    )


def revenue_bias(flagged: DataFrame) -> DataFrame:
    """Total invoiced revenue of both treatments and how far blanket removal is off the context-aware one."""
    lines = invoiced(flagged)
    totals = lines.agg(
        or_zero(exact_sum(lines, "line_total", ~F.col("is_outlier"))).alias("Revenue_Blanket"),
        or_zero(exact_sum(lines, "line_total", ~F.col("is_harmful"))).alias("Revenue_ContextAware"))
    b, c = F.col("Revenue_Blanket"), F.col("Revenue_ContextAware")
    return totals.withColumns({"Revenue_Difference": b - c, "Revenue_Bias_%": ratio(b - c, c) * 100.0})


def _retained():
    return F.col("is_outlier") & F.col("is_strategic")


def _retention_columns(df: DataFrame) -> list:
    return [or_zero(exact_sum(df, "line_total", F.col("is_outlier"))).alias("Total_Outlier_Revenue"),
            or_zero(exact_sum(df, "line_total", _retained())).alias("Retained_Strategic_Revenue")]


_RATE = "Strategic_Revenue_Retention_Rate_%"


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn(_RATE, ratio(F.col("Retained_Strategic_Revenue"), F.col("Total_Outlier_Revenue")) * 100.0)


def retention_overall(flagged: DataFrame) -> DataFrame:
    return _with_rate(flagged.agg(*_retention_columns(flagged)))


def retention_by_month(flagged: DataFrame) -> DataFrame:
    month = calendar.floor_to("month", F.col("date")).alias("month")
    return _with_rate(flagged.where("is_outlier").groupBy(month).agg(*_retention_columns(flagged))).orderBy("month")


def retention_by_segment(flagged: DataFrame) -> DataFrame:
    """Retained revenue per customer type and its share of the sum over the types (NULL on a zero sum)."""
    return _segments_of(flagged.where(_retained()), "line_total")


def _segments_of(kept: DataFrame, money: str) -> DataFrame:
    kept = kept.dropna(subset=["customer_type"])
    per_type = kept.groupBy("customer_type").agg(exact_sum(kept, money).alias("revenue"))
    # A handful of rows: their sum is taken next to them, so the lines are read once.
    gathered = per_type.agg(F.collect_list(F.struct("customer_type", "revenue")).alias("rows"),
                            exact_sum(per_type, "revenue").cast("double").alias("total"))
    revenue = F.col("revenue").cast("double")
    return (gathered.select(F.inline("rows"), "total")
            .select("customer_type", revenue.alias("retained_strategic_revenue"),
                    (F.try_divide(revenue, F.col("total")) * 100.0).alias("share_%")).orderBy("customer_type"))


def retention_by_category(flagged: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    return _categories_of(flagged.where(_retained()), "line_total", cfg)


def _categories_of(kept: DataFrame, money: str, cfg: RuleConfig) -> DataFrame:
    kept = kept.dropna(subset=["category"])
    return (kept.groupBy("category").agg(exact_sum(kept, money).cast("double").alias("retained_strategic_revenue"))
            .orderBy(F.desc("retained_strategic_revenue"), "category").limit(cfg.top_categories))


def retention_tables(flagged: DataFrame, cfg: RuleConfig = RULES) -> dict[str, DataFrame]:
    """Overall, Segments, Categories and Months from one scan: outlier revenue is summed per month, type and category."""
    cells = stage(
        flagged.where("is_outlier").groupBy(calendar.floor_to("month", F.col("date")).alias("month"), "customer_type", "category")
        .agg(exact_sum(flagged, "line_total").alias("outlier"),
             exact_sum(flagged, "line_total", F.col("is_strategic")).alias("retained")), "retention-cells")
    sums = [or_zero(exact_sum(cells, "outlier")).alias("Total_Outlier_Revenue"),
            or_zero(exact_sum(cells, "retained")).alias("Retained_Strategic_Revenue")]
    kept = cells.where("retained is not null")
    return {"Overall": _with_rate(cells.agg(*sums)), "Segments": _segments_of(kept, "retained"),
            "Categories": _categories_of(kept, "retained", cfg),
            "Months": _with_rate(cells.groupBy("month").agg(*sums)).orderBy("month")}


def top_strategic(flagged: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    columns = ["invoice_id", "date", "customer_id", "customer_type", "product_id", "category", "quantity", "price",
               "product_price", "line_total"]
    rest = [c for c in columns if c != "line_total"]
    return (flagged.where(_retained()).select(*columns)
            .orderBy(F.desc("line_total"), *[F.asc_nulls_last(c) for c in rest]).limit(cfg.top_strategic))


def monthly_comparison(flagged: DataFrame) -> DataFrame:
    """Revenue per month after either treatment; a month that one of them empties shows 0."""
    lines = invoiced(flagged)
    kept_b, kept_c = ~F.col("is_outlier"), ~F.col("is_harmful")
    return (lines.where(kept_b | kept_c).groupBy(calendar.floor_to("month", F.col("date")).alias("month"))
            .agg(or_zero(exact_sum(lines, "line_total", kept_b)).alias("blanket_revenue"),
                 or_zero(exact_sum(lines, "line_total", kept_c)).alias("context_revenue"))
            .orderBy("month"))


def scatter_series(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    """Quantity and price of a seeded sample, by outlier kind; fences are taken from the sample itself.

    A harmful line that is no statistical outlier is in two series.
    """
    sample = stage(sample_rows(lines.select("invoice_id", "customer_type", "product_id", "quantity", "price",
                                            "line_total"), cfg.scatter_rows, cfg.seed), "scatter-sample")
    flagged = flag_lines(sample, cfg)
    out, harm, strat = F.col("is_outlier"), F.col("is_harmful"), F.col("is_strategic")
    series = F.array_compact(F.array(
        F.when(~out, "Normal"),
        F.when(out & ~harm & ~strat, "Outlier (benign)"),
        F.when(out & strat, "Outlier (strategic)"),
        F.when(harm, "Outlier (harmful)")))
    return flagged.select(F.explode(series).alias("series"), "quantity", "price")
