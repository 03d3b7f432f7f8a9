"""Retail views over the given tables; one text for Spark and for the SQL the results are checked with."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

LINES_BASE = """
SELECT o.o_orderkey AS invoice_id, o.o_orderdate AS date, o.o_custkey AS customer_id,
 CASE WHEN c.c_custkey % 50 = 0 THEN NULL WHEN c.c_mktsegment='MACHINERY' THEN 'Wholesaler' ELSE 'private' END AS customer_type,
 l.l_partkey AS product_id, p.p_name AS item,
 CASE WHEN p.p_partkey % 40 = 0 THEN NULL ELSE p.p_brand END AS category,
 p.p_retailprice AS product_price,
 CAST(l.l_quantity * CASE WHEN l.l_orderkey % 401 = 0 THEN 400 WHEN l.l_orderkey % 23 = 0 THEN 15 ELSE 1 END AS DOUBLE) AS quantity,
 CAST(CASE WHEN l.l_orderkey % 499 = 0 THEN 0.05 WHEN (l.l_partkey + l.l_suppkey) % 89 = 0 THEN 0.0 ELSE p.p_retailprice * (1 - l.l_discount) END AS DOUBLE) AS price,
 l.l_linenumber AS ln
FROM {orders} o JOIN {customer} c ON c.c_custkey=o.o_custkey JOIN {lineitem} l ON l.l_orderkey=o.o_orderkey JOIN {part} p ON p.p_partkey=l.l_partkey
"""

LINES = f"""
SELECT invoice_id,date,customer_id,customer_type,product_id,item,category,product_price,quantity,price,
 CAST(COALESCE(CASE WHEN ln=7 THEN NULL WHEN ln=6 THEN quantity*price+1.0 ELSE quantity*price END, quantity*price) AS DECIMAL(20,6)) AS line_total
FROM ({LINES_BASE}) lines_base
"""

RAW = {
    "customers": """
SELECT CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN concat('  ', CAST(c_custkey AS VARCHAR(20)), ' ') ELSE CAST(c_custkey AS VARCHAR(20)) END AS CustomerID,
 CASE WHEN c_custkey % 50 = 0 THEN 'nan' WHEN c_custkey % 47 = 0 THEN '  ' WHEN c_mktsegment = 'MACHINERY' THEN ' Wholesaler ' ELSE 'private' END AS customer_type
FROM (SELECT c_custkey, c_mktsegment FROM {customer} UNION ALL SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_custkey % 31 = 0) c
""",
    "products": """
SELECT CASE WHEN p_partkey % 89 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR(20)) END AS product_id, p_name AS item,
 CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_brand END AS category,
 CASE WHEN p_partkey % 53 = 0 THEN 'abc' WHEN p_partkey % 59 = 0 THEN '-1.0' WHEN p_partkey % 61 = 0 THEN '' ELSE concat(' ', CAST(p_retailprice AS VARCHAR(30))) END AS price
FROM {part}
""",
    "purchases": """
SELECT src_row, CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR(20)) END AS InvoiceID,
 CASE WHEN o_orderkey % 71 = 0 THEN 'not-a-date' ELSE substr(CAST(o_orderdate + CAST(src_row AS INT) * INTERVAL '1' DAY AS VARCHAR(30)), 1, 10) END AS date,
 CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR(20)) END AS CustomerID
FROM (SELECT 0 AS src_row, o_orderkey, o_orderdate, o_custkey FROM {orders} UNION ALL SELECT 1 AS src_row, o_orderkey, o_orderdate, o_custkey FROM {orders} WHERE o_orderkey % 29 = 0) o
""",
    "invoice_items": """
SELECT CAST(l_orderkey AS VARCHAR(20)) AS InvoiceID, CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE CAST(l_partkey AS VARCHAR(20)) END AS product_id,
 CASE WHEN l_linenumber = 5 AND l_orderkey % 17 = 0 THEN '0' WHEN l_linenumber = 4 AND l_orderkey % 19 = 0 THEN '-3' WHEN l_linenumber = 3 AND l_orderkey % 23 = 0 THEN 'x' ELSE CAST(l_quantity AS VARCHAR(30)) END AS quantity,
 CASE WHEN l_orderkey % 107 = 0 THEN 'n/a' WHEN l_orderkey % 109 = 0 THEN '-5' WHEN l_orderkey % 499 = 0 THEN '0.05' ELSE CAST(l_extendedprice AS VARCHAR(30)) END AS price,
 CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'bad' ELSE CAST(l_quantity * l_extendedprice AS VARCHAR(40)) END AS line_total
FROM (SELECT l_orderkey,l_partkey,l_linenumber,l_quantity,l_extendedprice FROM {lineitem} UNION ALL SELECT l_orderkey,l_partkey,l_linenumber,l_quantity,l_extendedprice FROM {lineitem} WHERE l_orderkey % 37 = 0) l
""",
}

# Products whose item names need quoting in a CSV file: quotes, commas, line breaks, spaces at the ends.
QUOTED = """
SELECT product_id, CASE WHEN length(item) % 5 = 0 THEN concat('Cable 3" black, long ', item) WHEN length(item) % 5 = 1 THEN concat('  ', item, chr(10), 'second, "line"  ')
 WHEN length(item) % 5 = 2 THEN concat('"', item, '"') WHEN length(item) % 5 = 3 THEN concat(item, chr(92), '"') ELSE item END AS item, category, price FROM {products}
"""

# Records of products as they stand in two files of one folder, which order their columns differently; some have fields too many.
CSV_HEADERS = ("product_id,item,category,price", "product_id,category,item,price")
CSV_RECORDS = """
SELECT length(item) % 2 AS file, concat(coalesce(product_id, ''), ',', CASE WHEN length(item) % 2 = 0 THEN concat(item, ',', coalesce(category, '')) ELSE concat(coalesce(category, ''), ',', item) END,
 ',', price, CASE WHEN length(item) % 5 = 0 THEN ',' WHEN length(item) % 7 = 0 THEN ',,7' ELSE '' END) AS record FROM {products}
"""
CSV_EXTRA = "(length(item) % 5 = 0 OR length(item) % 7 = 0)"

# A small forest over six features. A split is (feature, threshold, left, right), a leaf the training rows of each class, whose
# shares are fractions of powers of two, so that votes add up exactly.
FOREST_CLASSES = ("Benign", "Harmful", "Strategic")
FOREST_FEATURES = ("total_qty", "avg_price", "invoice_revenue", "n_items", "month", "customer_type_Wholesaler")
_TREES = (
    (("avg_price", 0.5, 1, 2), ("total_qty", 500.5, 3, 4), ("invoice_revenue", 500000.5, 5, 6), (1, 6, 1), (0, 8, 0), ("month", 6.5, 7, 8),
     (0, 4, 28), (12, 2, 2), (6, 1, 1)),
    (("customer_type_Wholesaler", 0.5, 1, 2), ("invoice_revenue", 300000.5, 3, 4), ("total_qty", 2500.5, 5, 6), ("total_qty", 9000.5, 7, 8),
     (0, 2, 6), (1, 1, 2), (0, 1, 7), ("avg_price", 0.25, 9, 10), (0, 16, 0), (0, 8, 0), (14, 1, 1)),
    (("total_qty", 60.5, 1, 2), ("avg_price", 300.5, 3, 4), ("n_items", 4.5, 5, 6), (0, 4, 0), (15, 1, 0), ("avg_price", 1.5, 7, 8), (0, 2, 14),
     (0, 16, 0), ("total_qty", 1500.5, 9, 10), (2, 2, 4), (0, 1, 7)),
    (("month", 3.5, 1, 2), (4, 2, 2), ("invoice_revenue", 5000.5, 3, 4), ("avg_price", 0.15, 5, 6), ("n_items", 2.5, 7, 8), (0, 8, 0),
     (24, 4, 4), (1, 2, 1), (0, 8, 24)),
)


def forest_nodes() -> list[tuple]:
    """(tree, node, feature name, threshold, left, right, counts)"""
    def counts(tree: tuple, node: int) -> list[float]:
        row = tree[node]
        if len(row) == 3:
            return [float(c) for c in row]
        return [a + b for a, b in zip(counts(tree, row[2]), counts(tree, row[3]), strict=True)]

    return [(t, n, *(row if len(row) == 4 else (None,) * 4), counts(tree, n)) for t, tree in enumerate(_TREES) for n, row in enumerate(tree)]


TABLES = ("orders", "customer", "lineitem", "part")
LARGEST_FIRST = ("lineitem", "orders", "part", "customer")


# Parts the largest table of a view is spread over, for given files of a single row group; 0: as it is read.
SPREAD = int(os.environ.get("TIDESIFT_SPREAD", "0"))


def spark_view(spark: SparkSession, sf_dir: str, text: str, spread: int | None = None) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    if parts := SPREAD if spread is None else spread:
        largest = next(t for t in LARGEST_FIRST if t in used)
        used[largest] = used[largest].repartition(parts)
    return spark.sql(text, **used)


def duck_text(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, LINES)


def raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark_view(spark, sf_dir, text) for name, text in RAW.items()}
