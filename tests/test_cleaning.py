import datetime
import math
import threading

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from helpers import rows_of
from tidesift.operators import cleaning, constraints
from tidesift.functions.dates import readings
from tidesift.functions.values import to_timestamp
from tidesift.operators import files
from tidesift.operators.staging import cleared_after, stage
from tidesift.sources import csv_tables
from tidesift.sources.csv_tables import AmbiguousDate, clean_and_write, extra_records, read_csv, read_processed, read_raw, write_csv
from tidesift.sources.tables import ConstraintError, load_tables, read_rejected, read_tables, save_as_tables


def test_customers(spark):
    df = spark.createDataFrame([(" 1 ", "private"), ("1", "private\t"), (None, "x"), ("  ", "x"), ("2", "nan"),
                                ("007", None)], "CustomerID string, customer_type string")
    assert sorted(rows_of(cleaning.clean_customers(df)), key=str) == [("007", None), ("1", "private"), ("2", None)]
    assert cleaning.clean_customers(df.drop("customer_type")).columns == ["customer_id"]


def test_products(spark):
    df = spark.createDataFrame([("p1", "a", "NA", "1.5"), ("p1", "a", None, " 1.5"), ("p2", "b", "c", "-1"),
                                ("p3", "b", "c", "abc"), (None, "b", "c", "1"), ("p4", "b", "c", "0")],
                               "` product_id ` string, item string, category string, `price ` string")
    got = cleaning.clean_products(df)
    assert got.columns == ["product_id", "item", "category", "price"]
    assert sorted(rows_of(got)) == [("p1", "a", None, 1.5), ("p4", "b", "c", 0.0)]


def test_purchases_keep_the_first_row(spark):
    df = spark.createDataFrame([
        (3, "i1", "2024-01-03", "c1", "p", "1"), (1, "i1", "2024-01-09", "c9", "p", "1"), (2, "i2", "bad", "c1", "p", "1"),
        (4, "i2", "2024-01-02", "c2", "p", "1"), (5, None, "2024-01-02", "c2", "p", "1"), (6, "i3", "2024-01-02", None, "p", "1"),
    ], "n int, InvoiceID string, date string, CustomerID string, product_id string, quantity string")
    got = cleaning.clean_purchases(df, ["n"])
    assert sorted(rows_of(got)) == [("i1", datetime.datetime(2024, 1, 9), "c9"), ("i2", datetime.datetime(2024, 1, 2), "c2")]
    without_order = cleaning.clean_purchases(df.drop("n"))
    assert ("i1", datetime.datetime(2024, 1, 3), "c1") in rows_of(without_order)
    assert sorted(rows_of(cleaning.clean_purchases(df.drop("date"), ["n"]))) == [("i1", "c9"), ("i2", "c1")]


def test_invoice_items(spark):
    df = spark.createDataFrame([("i1", "p1", "2", "3", "6"), ("i1", "p1", "2.0", " 3", "6.0"), ("i1", "p2", "0", "3", "0"),
                                ("i1", "p2", "1", "-1", "0"), ("i1", "p2", "x", "1", "0"), ("i2", "p3", "inf", "1", "bad"),
                                ("i2", None, "1", "1", "1")],
                               "InvoiceID string, product_id string, quantity string, price string, line_total string")
    got = cleaning.clean_invoice_items(df)
    assert got.columns == ["invoice_id", "product_id", "quantity", "unit_price", "line_total"]
    assert sorted(rows_of(got)) == [("i1", "p1", 2.0, 3.0, 6.0), ("i2", "p3", math.inf, 1.0, None)]


def test_file_order_decides_among_duplicates(spark, tmp_path):
    text = "InvoiceID,date,CustomerID,product_id,quantity\n" + "".join(
        f"i{n % 50},2024-01-{1 + n // 50:02d},c{n // 50},p,1\n" for n in range(1000))
    (tmp_path / "purchases.csv").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # many blocks
    try:
        raw = read_raw(spark, str(tmp_path), {"purchases": "purchases.csv"})["purchases"]
        got = rows_of(cleaning.clean_purchases(raw))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 50 and {g[2] for g in got} == {"c0"}


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_csv(spark, str(tmp_path / "none.csv")).collect()


TABLES = {
    "customers": ([("c1", "private"), ("c2", None)], "customer_id string, customer_type string"),
    "products": ([("p1", "x", "A", 1.0)], "product_id string, item string, category string, price double"),
    "purchases": ([("i1", datetime.datetime(2024, 1, 1), "c1")],
                  "invoice_id string, purchase_date timestamp_ntz, customer_id string"),
    "invoice_items": ([("i1", "p1", 1.0, 2.0, None)],
                      "invoice_id string, product_id string, quantity double, unit_price double, line_total double"),
}


def tables(spark, **extra):
    return {n: spark.createDataFrame(rows + extra.get(n, []), schema) for n, (rows, schema) in TABLES.items()}


BROKEN = {
    "customers": [("c2", "x"), (None, "y")],
    "purchases": [("i2", None, "c9"), ("i3", None, None), ("i4", None, "c2")],
    "invoice_items": [("i2", "p1", 1.0, 1.0, 1.0), ("i1", "p9", 1.0, 1.0, 1.0), ("i1", None, 1.0, 1.0, 1.0),
                      ("i4", "p1", 1.0, 1.0, 1.0)],
}


def test_constraint_checks(spark):
    broken = tables(spark, **BROKEN)
    assert rows_of(constraints.violations(tables(spark))) == []
    found = {(r.rule, r.table_name, r.column_name): r.n_rows for r in constraints.violations(broken).collect()}
    assert found == {("primary key", "customers", "customer_id"): 2, ("not null", "customers", "customer_id"): 1,
                     ("not null", "purchases", "customer_id"): 1, ("foreign key", "purchases", "customer_id"): 1,
                     ("not null", "invoice_items", "product_id"): 1, ("foreign key", "invoice_items", "product_id"): 1}
    assert rows_of(constraints.check_orphans(broken).where("child_table = 'invoice_items'")) == [
        ("invoice_items", "products", "p9", 1)]


def test_load_refreshes_and_protects(spark, tmp_path):
    target = str(tmp_path / "store")
    for _ in range(2):
        loaded = load_tables(tables(spark), target)
    assert loaded["customers"].count() == 2 and loaded["invoice_items"].count() == 1
    with pytest.raises(ConstraintError, match="foreign key purchases.customer_id: 1 rows"):
        load_tables(tables(spark, **BROKEN), target)
    assert read_tables(spark, target)["purchases"].count() == 1


def test_quarantine(spark, tmp_path):
    target = str(tmp_path / "store")
    loaded = load_tables(tables(spark, **BROKEN), target, "quarantine")
    assert {n: df.count() for n, df in loaded.items()} == {"customers": 1, "products": 1, "purchases": 1, "invoice_items": 1}
    rules = sorted(r.broken_rule for r in read_rejected(spark, target, "invoice_items").collect())
    assert rules == ["foreign key invoice_id", "foreign key invoice_id", "foreign key product_id", "not null"]
    assert sorted(r.broken_rule for r in read_rejected(spark, target, "customers").collect()) == [
        "not null", "primary key customer_id", "primary key customer_id"]


def test_catalog_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE shop LOCATION '{tmp_path}/shop'")
    try:
        for _ in range(2):
            save_as_tables(tables(spark), "shop")
        assert spark.table("shop.customers").count() == 2
        assert spark.table("shop.invoice_items").columns == ["invoice_id", "product_id", "quantity", "unit_price", "line_total"]
    finally:
        spark.sql("DROP DATABASE shop CASCADE")


def test_csv_keeps_what_quotes_enclose(spark, tmp_path):
    """Doubled quotes, commas, line breaks, spaces and a padded header; written by hand and by us."""
    (tmp_path / "products.csv").write_text(
        'product_id,item," category ", price \n'
        'p1,"Cable 3"" black, long",A,1.5\n'
        'p2,"two\nlines, ""quoted""",B,2\n'
        'p3,"  padded  ","  C ",3\n'
        'p4,back\\slash,"""",4\n'
        'p5,short\n')
    want = {("p1", 'Cable 3" black, long', "A", "1.5"), ("p2", 'two\nlines, "quoted"', "B", "2"), ("p3", "  padded  ", "  C ", "3"),
            ("p4", "back\\slash", '"', "4"), ("p5", "short", None, None)}
    raw = read_csv(spark, str(tmp_path / "products.csv"))
    assert raw.columns == ["product_id", "item", " category ", " price "] and set(rows_of(raw)) == want
    for i in range(2):
        raw = read_csv(spark, write_csv(raw, str(tmp_path / f"again{i}")))
        assert set(rows_of(raw)) == want
    assert set(rows_of(cleaning.clean_products(raw).select("product_id", "item"))) == {w[:2] for w in want if w[3]}


def test_records_with_too_many_fields(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text('a,b\n1,2\n3,4,5\n6\n7,"8,9"\n')
    with pytest.raises(Exception, match="more fields than the header: 3,4,5"):
        read_csv(spark, path).collect()
    for multi_line in (True, False):
        assert sorted(rows_of(read_csv(spark, path, multi_line=multi_line, extra_fields="drop"))) == [("1", "2"), ("6", None), ("7", "8,9")]
        assert extra_records(spark, path, multi_line) == 1
    with pytest.raises(ValueError, match="extra_fields"):
        read_csv(spark, path, extra_fields="keep")


@pytest.mark.parametrize("multi_line", [True, False])
def test_empty_extra_fields_are_seen(spark, tmp_path, multi_line):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text('a,b\n5,6,,7\n3,4,\n1,2\n8\n"x, ""q""","y,"\n"x","y",""\n,\n5" pipe,"3"\n9,"a""b,",\n')
    with pytest.raises(Exception, match="more fields than the header"):
        read_csv(spark, path, multi_line=multi_line).collect()
    got = rows_of(read_csv(spark, path, multi_line=multi_line, extra_fields="drop"))
    assert sorted(got, key=str) == sorted([("1", "2"), ("8", None), ('x, "q"', "y,"), (None, None), ('5" pipe', "3")], key=str)
    assert extra_records(spark, path, multi_line) == 4
    counted = Observation("c")
    read_csv(spark, path, multi_line=multi_line, extra_fields="drop", counted=counted).write.parquet(str(tmp_path / "out"))
    assert counted.get == {"extra": 4}
    assert read_csv(spark, path, multi_line=multi_line, extra_fields="drop").count() == 5
    assert read_csv(spark, path, multi_line=multi_line, extra_fields="drop").select("b").distinct().count() == 4
    typed = read_csv(spark, path, "a string, b string", multi_line=multi_line, extra_fields="drop")
    assert sorted(rows_of(typed), key=str) == sorted(got, key=str)


def test_files_of_one_folder_may_order_their_columns_differently(spark, tmp_path, monkeypatch):
    folder = tmp_path / "products.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("product_id,item,category,price\np1,lamp,home,1\n")
    (folder / "b.csv").write_text("product_id,category,item,price\np2,home,chair,2\np3,x,y,3,\n")
    (folder / "c.csv").write_text("item,product_id\ntable,p4\n")
    (folder / "d.csv").write_text("")
    got = read_csv(spark, str(folder), extra_fields="drop", file_order=True).orderBy("_file", "_block", "_row")
    assert rows_of(got.select("product_id", "item", "category", "price")) == [
        ("p1", "lamp", "home", "1"), ("p2", "chair", "home", "2"), ("p4", "table", None, None)]
    assert extra_records(spark, str(folder)) == 1
    assert {r["product_id"]: r["item"] for r in cleaning.clean_products(got).collect()} == {"p1": "lamp", "p2": "chair"}
    monkeypatch.setattr(csv_tables, "HEADERS_READ", 1)  # too many files to look at: a differing header raises
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(folder)).collect()
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(folder), "product_id string, item string, category string, price string").collect()


def test_fields_of_a_record(spark):
    records = {"a,b": 2, "": 1, ",": 2, '"a,b",c': 2, '"a""b,c"': 1, '5" x,"a,b"': 2, '"",""': 2, '"a\n,b",c,': 3, ' "a,b"': 2, '"""",x': 2,
               "x" * 100_000 + "," + '""' * 50_000: 2}
    df = spark.createDataFrame([(r,) for r in records], "r string").select(csv_tables.n_fields(F.col("r")).alias("n"))
    assert [r["n"] for r in df.collect()] == list(records.values())


@pytest.mark.parametrize(("text", "want"), [
    ("2023-12-31", ["yyyy-M-d"]), ("2023/1/5 07:30", ["yyyy/M/d HH:mm"]), ("12/31/2023", ["M/d/yyyy"]), ("31.12.2023", ["d.M.yyyy"]),
    ("01/02/2023 7:05:09", ["M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss"]), ("2023-01-02T03:04:05.123", ["yyyy-M-d'T'HH:mm:ss.SSS"]),
    ("13/13/2023", []), ("yesterday", []), ("2023-01-02 noon", []), ("1/2/23", [])])
def test_readings_of_a_date(spark, text, want):
    assert readings(text) == want
    for pattern in want:
        df = spark.createDataFrame([(text,)], "d string")
        assert df.select(to_timestamp(F.col("d"), formats=[pattern])).first()[0] is not None


def test_the_first_date_decides_the_format(spark, tmp_path):
    for name, text in (("customers", "CustomerID,customer_type\nc1,private\n"), ("products", "product_id,item,category,price\np,i,c,1\n"),
                       ("invoice_items", "InvoiceID,product_id,quantity,price,line_total\n1,p,1,1,1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    folder = tmp_path / "purchases.csv"
    folder.mkdir()
    (folder / "1.csv").write_text("InvoiceID,date,CustomerID\n0,,c1\n00,nan,c1\n")
    (folder / "2.csv").write_text("InvoiceID,CustomerID,date\n1,c1,25/12/2023\n2,c1,01/02/2023\n3,c1,2023-05-06\n4,c1,\n")
    found = clean_and_write(spark, str(tmp_path), str(tmp_path / "out"), "infer")
    assert found.date_formats == ("d/M/yyyy",) and found.unparsed_dates == 1
    got = {r["invoice_id"]: str(r["purchase_date"])[:10] for r in read_processed(spark, found.paths)["purchases"].collect()}
    assert got == {"1": "2023-12-25", "2": "2023-02-01"}
    (folder / "1.csv").write_text("InvoiceID,date,CustomerID\n0,03/04/2023,c1\n")
    with pytest.warns(AmbiguousDate, match="M/d/yyyy; it can be read as d/M/yyyy"):
        found = clean_and_write(spark, str(tmp_path), str(tmp_path / "out"), "infer")
    assert found.date_formats == ("M/d/yyyy",) and found.unparsed_dates == 2


def test_a_load_that_fails_changes_nothing(spark, tmp_path):
    target = str(tmp_path / "store")
    load_tables(tables(spark), target)
    before = {n: rows_of(df) for n, df in read_tables(spark, target).items()}
    more = tables(spark, customers=[("c9", "private")])
    fails = more["purchases"].withColumn("purchase_date", F.raise_error(F.lit("broken off")).cast("timestamp_ntz"))
    with pytest.raises(Exception, match="broken off"):
        load_tables({**more, "purchases": fails}, target, "quarantine")
    assert {n: rows_of(df) for n, df in read_tables(spark, target).items()} == before
    for _ in range(3):
        load_tables(more, target)
    assert read_tables(spark, target)["customers"].count() == 3
    assert len(files.folders(spark, target)) == 2  # the current load and the one before
    with pytest.raises(FileNotFoundError):
        read_tables(spark, str(tmp_path / "nowhere"))


def test_blocks_of_two_threads_keep_their_tables(spark):
    inside, ended = threading.Event(), threading.Event()

    def short():
        with cleared_after(spark):
            stage(spark.range(3), "short").count()
            inside.wait(60)
        ended.set()

    with cleared_after(spark):
        thread = threading.Thread(target=short)
        thread.start()
        kept = stage(spark.range(5), "kept")
        inside.set()
        ended.wait(60)
        assert kept.count() == 5
        thread.join()
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        kept.collect()


def test_dates_that_fit_no_format_are_counted(spark):
    df = spark.createDataFrame([("12/31/2023",), ("2023-12-31",), ("31.12.2023",), ("",), (None,), ("nan",)], "date string")
    assert tuple(cleaning.unparsed_dates(df).first()) == (2, 6)
    assert tuple(cleaning.unparsed_dates(df, ("MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM-dd")).first()) == (0, 6)
