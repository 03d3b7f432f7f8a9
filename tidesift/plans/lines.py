"""The integrated line table: one row per invoice line with its header, customer and product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RULES, RuleConfig
from ..functions import calendar, rules
from ..functions.values import to_number, to_timestamp
from ..schemas import REQUIRED_LINE_COLUMNS


def prepare_lines(df: DataFrame) -> DataFrame:
    """Type the measures, drop lines that lack a required value, add the weekday columns."""
    typed = df.withColumns({
        "date": to_timestamp(F.col("date"), df.schema["date"].dataType),
        **{c: to_number(F.col(c), df.schema[c].dataType) for c in ("quantity", "price", "line_total")},
    })
    return typed.dropna(subset=list(REQUIRED_LINE_COLUMNS)).withColumns({
        "day_of_week": calendar.day_of_week(F.col("date")),
        "day_name": calendar.day_name(F.col("date")),
    })


def integrate_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """Join headers, customers, line items and products.

    Join order and algorithm are left to the optimizer: it broadcasts a side only when its size is known to be
    small, and adaptive execution splits a hot key of the shuffled joins. It can do so when the tables are stored
    ones, as a load returns them: a table that is still to be aggregated by its join key would not be shuffled again.
    """
    items, products = tables["invoice_items"], tables["products"]
    joined = (
        items.join(tables["purchases"], "invoice_id")
        .join(tables["customers"], "customer_id")
        .join(products.withColumnRenamed("price", "product_price"), "product_id")
    )
    return prepare_lines(joined.select(
        "invoice_id", F.col("purchase_date").alias("date"), "customer_id", "customer_type", "product_id", "item",
        "category", "product_price", "quantity", F.col("unit_price").alias("price"),
        F.coalesce("line_total", F.col("quantity") * F.col("unit_price")).alias("line_total"),
    ))


def add_temporal_features(lines: DataFrame, cfg: RuleConfig = RULES) -> DataFrame:
    return lines.withColumns(calendar.temporal_features(F.col("date"), cfg))


def add_pricing_features(lines: DataFrame) -> DataFrame:
    """Price against list price, and the stored line total against quantity x price."""
    price, listed = F.col("price").cast("double"), F.col("product_price").cast("double")
    calculated = F.col("quantity").cast("double") * price
    return lines.withColumns({
        "price_vs_product_price": price - listed,
        "price_discount_pct": F.try_divide(listed - price, listed) * 100.0,
        "calculated_line_total": calculated,
        "line_total_error": F.col("line_total").cast("double") - calculated,
    })


def is_harmful_line(cfg: RuleConfig = RULES):
    return rules.harmful(F.col("price"), F.col("quantity"), cfg)
