"""Cleaning of the four raw tables. Every step is a plain projection, filter or combinable aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import clean_text, na_to_null, to_number, to_timestamp
from .staging import with_evaluated

# Columns of the file reader that record where a row stood; see sources.csv_tables.
FILE_ORDER = ("_file", "_block", "_row")


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def rewrite(df: DataFrame, *changes: dict[str, Column]) -> DataFrame:
    """Replace columns, each parsed once however many filters follow."""
    return with_evaluated(df, {name: c for change in changes for name, c in change.items()})


def texts(df: DataFrame, *columns: str) -> dict[str, Column]:
    """Trimmed texts, blank and NA as NULL. Like the other groups: only of the columns ``df`` has."""
    return {c: clean_text(F.col(c)) for c in columns if c in df.columns}


def untrimmed_texts(df: DataFrame, *columns: str) -> dict[str, Column]:
    return {c: na_to_null(F.col(c).cast("string")) for c in columns if c in df.columns}


def numbers(df: DataFrame, *columns: str) -> dict[str, Column]:
    return {c: to_number(F.col(c), df.schema[c].dataType) for c in columns if c in df.columns}


def timestamps(df: DataFrame, *columns: str, formats: Sequence[str] = ()) -> dict[str, Column]:
    return {c: to_timestamp(F.col(c), df.schema[c].dataType, formats) for c in columns if c in df.columns}


def first_per_key(df: DataFrame, key: str, order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``order_by``, ties by the row's own values.

    A minimum over a struct combines before the shuffle, so a key with many rows does not end up in one task the
    way a numbering window would put it.
    """
    kept = [c for c in df.columns if c != key and c not in order_by]
    ranked = F.struct(*order_by, *kept)
    return (df.groupBy(key).agg(F.min(ranked).alias("_first"))
            .select(*[key if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns if c not in order_by]))


def without_file_order(df: DataFrame) -> DataFrame:
    return df.drop(*FILE_ORDER)


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that have a value in every given column."""
    return df.dropna(subset=list(columns))


def in_range(df: DataFrame, positive: Sequence[str] = (), not_negative: Sequence[str] = ()) -> DataFrame:
    """Rows whose measures are above, or not below, zero; columns that ``df`` lacks are not asked for."""
    for c in positive:
        df = df.where(F.col(c) > 0) if c in df.columns else df
    for c in not_negative:
        df = df.where(F.col(c) >= 0) if c in df.columns else df
    return df


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


# The cleaners below rename raw columns to stored ones; both names are fixed values.
def clean_customers(df: DataFrame) -> DataFrame:
    df = without_file_order(df).withColumnsRenamed({"CustomerID": "customer_id"})
    df = rewrite(df, texts(df, "customer_id", "customer_type"))
    return distinct_rows(drop_missing(df, "customer_id"))


def clean_products(df: DataFrame) -> DataFrame:
    df = strip_headers(without_file_order(df))
    df = rewrite(df, texts(df, "product_id"), untrimmed_texts(df, "item", "category"), numbers(df, "price"))
    return distinct_rows(in_range(drop_missing(df, "product_id"), not_negative=["price"]))


def clean_purchases(df: DataFrame, order_by: Sequence[str] = (), formats: Sequence[str] = ()) -> DataFrame:
    """Invoice headers, one per invoice. ``order_by`` names the columns that tell which row came first."""
    df = df.withColumnsRenamed({"InvoiceID": "invoice_id", "CustomerID": "customer_id", "date": "purchase_date"})
    order_by = list(order_by) or [c for c in FILE_ORDER if c in df.columns]
    kept = [c for c in ("invoice_id", "purchase_date", "customer_id") if c in df.columns]
    df = df.select(*kept, *order_by)
    df = rewrite(df, texts(df, "invoice_id", "customer_id"), timestamps(df, "purchase_date", formats=formats))
    return first_per_key(drop_missing(df, *kept), "invoice_id", order_by)


def clean_invoice_items(df: DataFrame) -> DataFrame:
    df = without_file_order(df).withColumnsRenamed({"InvoiceID": "invoice_id", "price": "unit_price"})
    df = rewrite(df, texts(df, "invoice_id", "product_id"), numbers(df, "quantity", "unit_price", "line_total"))
    return distinct_rows(in_range(drop_missing(df, "invoice_id", "product_id"), ["quantity"], ["unit_price"]))


CLEANERS = {
    "customers": clean_customers,
    "products": clean_products,
    "purchases": clean_purchases,
    "invoice_items": clean_invoice_items,
}


def clean_tables(raw: dict[str, DataFrame], order_by: Sequence[str] = (),
                 date_formats: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All tables cleaned; ``date_formats`` are the patterns header dates may have (none: ISO notation)."""
    return {name: clean_purchases(df, order_by, date_formats) if name == "purchases" else CLEANERS[name](df)
            for name, df in raw.items()}


def unparsed_dates(purchases: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """One row: header dates that are there but fit no format, among all rows."""
    raw = F.col("date")
    parsed = to_timestamp(raw, purchases.schema["date"].dataType, formats)
    return purchases.agg(F.count_if(clean_text(raw).isNotNull() & parsed.isNull()).alias("unparsed"),
                         F.count(F.lit(1)).alias("n_rows"))
