"""Column layouts of the raw files, the stored tables and the derived frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _typed(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TEXT, NUMBER, TIMESTAMP = T.StringType(), T.DoubleType(), T.TimestampNTZType()


# Raw file names and their headers. Raw columns are read as text; cleaning types them.
RAW_FILES = {
    "customers": "customers.csv",
    "products": "products.csv",
    "purchases": "purchases.csv",
    "invoice_items": "invoice_items.csv",
}
RAW_SCHEMAS = {
    "customers": _strings("CustomerID", "customer_type"),
    "products": _strings("product_id", "item", "category", "price"),
    "purchases": _strings("InvoiceID", "date", "CustomerID", "product_id", "quantity"),
    "invoice_items": _strings("InvoiceID", "product_id", "quantity", "price", "line_total"),
}

# Columns of the stored tables, their keys, and the columns and features of the model data.
TABLES = {
    "customers": _typed(customer_id=TEXT, customer_type=TEXT),
    "products": _typed(product_id=TEXT, item=TEXT, category=TEXT, price=NUMBER),
    "purchases": _typed(invoice_id=TEXT, purchase_date=TIMESTAMP, customer_id=TEXT),
    "invoice_items": _typed(invoice_id=TEXT, product_id=TEXT, quantity=NUMBER, unit_price=NUMBER,
                            line_total=NUMBER),
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str


PRIMARY_KEYS = {"customers": "customer_id", "products": "product_id", "purchases": "invoice_id"}
NOT_NULL = {
    "customers": ("customer_id",),
    "products": ("product_id",),
    "purchases": ("invoice_id", "customer_id"),
    "invoice_items": ("invoice_id", "product_id"),
}
FOREIGN_KEYS = (
    ForeignKey("purchases", "customer_id", "customers"),
    ForeignKey("invoice_items", "invoice_id", "purchases"),
    ForeignKey("invoice_items", "product_id", "products"),
)
LOAD_ORDER = ("customers", "products", "purchases", "invoice_items")

REQUIRED_LINE_COLUMNS = ("invoice_id", "date", "customer_id", "product_id", "quantity", "price", "line_total")
INVOICE_KEYS = ("invoice_id", "date", "customer_id", "customer_type")

CATEGORICAL_FEATURES = ("customer_type", "dominant_category")
NUMERIC_FEATURES = ("month", "day_of_week", "is_weekend", "is_peak_season", "is_off_season", "invoice_revenue",
                    "total_qty", "avg_price", "n_items")
MODEL_COLUMNS = ("invoice_id", "date", "customer_id", "customer_type", "invoice_revenue", "total_qty", "avg_price",
                 "n_items", "dominant_category", "month", "day_of_week", "is_weekend", "is_peak_season",
                 "is_off_season", "is_statistical_outlier", "is_harmful", "is_strategic", "is_benign", "outlier_class")
