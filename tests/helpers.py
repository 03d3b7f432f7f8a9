from __future__ import annotations

import datetime

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = ("invoice_id string, date timestamp_ntz, customer_id string, customer_type string, product_id string, "
          "item string, category string, product_price double, quantity double, price double, line_total double")


def line(invoice="i1", day=0, customer="c1", kind="private", product="p1", category="A", quantity=1.0, price=10.0,
         total=None, listed=10.0):
    return (invoice, DAY + datetime.timedelta(days=day), customer, kind, product, "thing", category, listed, quantity,
            price, quantity * price if total is None else total)


def frame(spark, rows, decimal=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("line_total", df.line_total.cast("decimal(20,6)")) if decimal else df


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
