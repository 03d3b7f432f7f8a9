"""How harmful lines distort revenue, average order value and revenue per customer.

Lines with a missing header value (date, customer, customer type) are in no invoice, so they count in no KPI; they
do count among all rows of the meta table, the top list and the histogram.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RULES, WEEKDAYS, RuleConfig
from ..functions import calendar
from ..functions.measures import direction_label, exact_sum, or_zero, ratio, signed_distortion
from ..operators.histogram import histogram
from ..operators.staging import stage
from ..schemas import INVOICE_KEYS
from .lines import is_harmful_line

KPIS = ("Total_Revenue", "AOV", "Revenue_per_Customer")


def invoiced(lines: DataFrame) -> DataFrame:
    return lines.dropna(subset=list(INVOICE_KEYS))


def invoice_level(lines: DataFrame) -> DataFrame:
    """Revenue, distinct products and quantity per invoice."""
    keys = ["invoice_id", "date", "day_name", "customer_id", "customer_type"]
    return (invoiced(lines).withColumn("day_name", calendar.day_name(F.col("date"))).groupBy(*keys)
            .agg(exact_sum(lines, "line_total").cast("double").alias("revenue"),
                 F.count_distinct("product_id").alias("items"), exact_sum(lines, "quantity").cast("double").alias("qty")))


def _kpi_columns(revenue: Column, invoices: Column, customers: Column, suffix: str = "") -> dict[str, Column]:
    return {
        f"Total_Revenue{suffix}": or_zero(revenue),
        f"AOV{suffix}": ratio(revenue, invoices),
        f"Revenue_per_Customer{suffix}": ratio(revenue, customers),
        f"Invoices{suffix}": invoices,
        f"Customers{suffix}": customers,
    }


def kpis_with_and_without(lines: DataFrame, by_segment: bool = False, cfg: RuleConfig = RULES) -> DataFrame:
    """The five KPIs with and without harmful lines: one row, or one per customer type."""
    return _kpis_of(_entity_totals(per_id_sums(invoiced(lines), by_segment, cfg), by_segment), by_segment)


def _kpis_of(totals: DataFrame, by_segment: bool) -> DataFrame:
    columns = {**_kpi_columns(F.col("r"), F.col("i"), F.col("c"), "_with"),
               **_kpi_columns(F.col("cr"), F.col("ci"), F.col("cc"), "_without")}
    keep = ["customer_type"] if by_segment else []
    return totals.select(*keep, *[c.alias(n) for n, c in columns.items()])


def per_id_sums(lines: DataFrame, by_segment: bool = False, cfg: RuleConfig = RULES) -> DataFrame:
    """Revenue and rows per invoice id and per customer id (and customer type), the clean lines apart.

    One scan and one large shuffle: lines are grouped by invoice id and by customer id as two grouping sets. Both
    combine on the map side, so a hot customer or invoice leaves each task as one row. Counting the distinct ids
    with and without harmful lines the plain way would replicate every line five times.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in INVOICE_KEYS])
    rows = lines.select("invoice_id", "customer_id", "customer_type", "line_total", whole.alias("invoiced"),
                        (~is_harmful_line(cfg)).alias("clean"))
    segment = ["customer_type"] if by_segment else []
    sets = [[*segment, "invoiced", "invoice_id"], [*segment, "invoiced", "customer_id"]]
    return rows.groupingSets(sets, *segment, "invoiced", "invoice_id", "customer_id").agg(
        (F.grouping("customer_id") == 1).alias("is_invoice"),
        exact_sum(rows, "line_total").alias("revenue"),
        exact_sum(rows, "line_total", F.col("clean")).alias("clean_revenue"),
        F.bool_or("clean").alias("clean"), F.count(F.lit(1)).alias("rows"), F.count_if("clean").alias("clean_rows"))


def over_types(per_type: DataFrame) -> DataFrame:
    """The sums per id of all customer types together, from those per type."""
    return per_type.groupBy("is_invoice", "invoiced", "invoice_id", "customer_id").agg(
        exact_sum(per_type, "revenue").alias("revenue"), exact_sum(per_type, "clean_revenue").alias("clean_revenue"),
        F.bool_or("clean").alias("clean"), F.sum("rows").alias("rows"), F.sum("clean_rows").alias("clean_rows"))


def _entity_totals(per_id: DataFrame, by_segment: bool) -> DataFrame:
    """Revenue (r), invoices (i) and customers (c) of invoiced lines, the clean ones apart (cr, ci, cc), and rows."""
    segment = ["customer_type"] if by_segment else []
    invoice = F.col("invoiced") & F.col("is_invoice")
    customer = F.col("invoiced") & ~F.col("is_invoice")
    clean = F.col("clean")
    return per_id.groupBy(*segment).agg(
        exact_sum(per_id, "revenue", customer).alias("r"), exact_sum(per_id, "clean_revenue", customer).alias("cr"),
        F.count_if(invoice).alias("i"), F.count_if(invoice & clean).alias("ci"),
        F.count_if(customer).alias("c"), F.count_if(customer & clean).alias("cc"),
        F.coalesce(F.sum(F.when(~F.col("is_invoice"), F.col("rows"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~F.col("is_invoice"), F.col("clean_rows"))), F.lit(0)).alias("clean_rows"))


def kpi_set(lines: DataFrame) -> DataFrame:
    """Revenue, AOV, revenue per customer, invoices and customers of all lines."""
    kpis = kpis_with_and_without(lines)
    return kpis.select(*[F.col(f"{n}_with").alias(n) for n in (*KPIS, "Invoices", "Customers")])


def _distortion_rows(kpis: DataFrame, keep: list[str]) -> DataFrame:
    """One row per KPI with both values and the distortion."""
    rows = F.array(*[F.struct(F.lit(k).alias("KPI"), F.col(f"{k}_with").alias("With_Harmful"),
                              F.col(f"{k}_without").alias("Without_Harmful")) for k in KPIS])
    long = kpis.select(*keep, F.inline(rows))
    direction = signed_distortion(F.col("With_Harmful"), F.col("Without_Harmful"))
    return long.withColumns({"Distortion_Magnitude_%": F.abs(direction), "Distortion_Direction_%": direction})


def _summary_of(kpis: DataFrame) -> DataFrame:
    rows = _distortion_rows(kpis, [])
    return rows.withColumn("Direction_Label", direction_label(F.col("`Distortion_Direction_%`")))


def distortion_summary(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    return _summary_of(kpis_with_and_without(lines, cfg=cfg))


def _segments_of(kpis: DataFrame) -> DataFrame:
    """By customer type, the KPIs in their order."""
    order = F.array_position(F.array(*[F.lit(k) for k in KPIS]), F.col("KPI"))
    return _distortion_rows(kpis, ["customer_type"]).orderBy("customer_type", order)


def distortion_by_segment(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    return _segments_of(kpis_with_and_without(lines, True, cfg))


def meta(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    """Row counts over all lines next to the invoice and customer counts of the KPIs, from one scan."""
    return _meta_of(_entity_totals(per_id_sums(lines, cfg=cfg), False))


def distortion_tables(lines: DataFrame, cfg: RuleConfig = RULES) -> dict[str, DataFrame]:
    """Summary, Meta and Segments from one scan of the lines: their sums per id and customer type are staged."""
    per_type = stage(per_id_sums(lines, True, cfg), "per-id-sums")
    totals = _entity_totals(over_types(per_type), False)
    segments = _entity_totals(per_type.where("invoiced"), True)
    return {"Summary": _summary_of(_kpis_of(totals, False)), "Meta": _meta_of(totals),
            "Segments": _segments_of(_kpis_of(segments, True))}


def _meta_of(totals: DataFrame) -> DataFrame:
    harmful_rows = F.col("rows") - F.col("clean_rows")
    rate = F.try_divide(harmful_rows.cast("double"), F.col("rows").cast("double")) * 100.0
    return totals.select(
        F.col("rows").alias("Rows_total"), harmful_rows.alias("Harmful_rows"), rate.alias("Harmful_rate_%"),
        F.col("i").alias("Invoices_total"), F.col("c").alias("Customers_total"))


def top_harmful(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    """The harmful lines of highest value; ties by the other columns."""
    columns = ["invoice_id", "date", "customer_id", "customer_type", "product_id", "category", "quantity", "price",
               "line_total"]
    rest = [c for c in columns if c != "line_total"]
    return (lines.where(is_harmful_line(cfg)).select(*columns)
            .orderBy(F.desc("line_total"), *[F.asc_nulls_last(c) for c in rest]).limit(cfg.top_harmful))


def day_of_week_profile(lines: DataFrame) -> DataFrame:
    """Invoices and revenue per weekday, Monday first."""
    per_invoice = (invoiced(lines).groupBy(calendar.day_of_week(F.col("date")).alias("weekday"), "invoice_id")
                   .agg(exact_sum(lines, "line_total").alias("revenue")))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return (per_invoice.groupBy("weekday")
            .agg(F.count(F.lit(1)).alias("invoices"), exact_sum(per_invoice, "revenue").cast("double").alias("revenue"))
            .orderBy("weekday").select(F.get(names, F.col("weekday")).alias("day_name"), "invoices", "revenue"))


def revenue_by(lines: DataFrame, unit: str, cfg: RuleConfig = RULES) -> DataFrame:
    """Revenue per day or week with and without harmful lines, where both exist."""
    clean = ~is_harmful_line(cfg)
    return (invoiced(lines).groupBy(calendar.floor_to(unit, F.col("date")).alias("date"))
            .agg(exact_sum(lines, "line_total").cast("double").alias("with_harmful"),
                 exact_sum(lines, "line_total", clean).cast("double").alias("without_harmful"),
                 F.count_if(clean).alias("clean_lines"))
            .where("clean_lines > 0").drop("clean_lines").orderBy("date"))


def daily_revenue(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    return revenue_by(lines, "day", cfg)


def weekly_distortion(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    direction = signed_distortion(F.col("with_harmful"), F.col("without_harmful"))
    return revenue_by(lines, "week", cfg).withColumnRenamed("date", "week").withColumns(
        {"Distortion_Magnitude_%": F.abs(direction), "Distortion_Direction_%": direction})


def line_total_histogram(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    harmful = is_harmful_line(cfg)
    return histogram(lines, "line_total", {"Non-harmful": ~harmful, "Harmful": harmful}, cfg.histogram_bins)
