"""Key, NOT NULL and reference checks. Spark enforces none of them, so they run before a load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, ForeignKey


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def null_counts(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows (column_name, null_rows), one scan for all columns."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rows")) for c in columns])
    return counts.select(F.inline(pairs))


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Keys of the child that no parent row has, with their row counts.

    Counting per key comes first: the join then sees each key once, however many rows share it.
    """
    keys = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return keys.join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([
        duplicate_keys(tables[t], k).select(F.lit(t).alias("table_name"), F.col(k).cast("string").alias("key"),
                                            "n_rows")
        for t, k in PRIMARY_KEYS.items()])


def check_not_null(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([null_counts(tables[t], columns).select(F.lit(t).alias("table_name"), "column_name", "null_rows")
                   for t, columns in NOT_NULL.items()])


def _orphans(tables: dict[str, DataFrame], fk: ForeignKey) -> DataFrame:
    return orphan_keys(tables[fk.child], fk.column, tables[fk.parent], PRIMARY_KEYS[fk.parent])


def check_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([
        _orphans(tables, fk).select(F.lit(fk.child).alias("child_table"), F.lit(fk.parent).alias("parent_table"),
                                    F.col(fk.column).cast("string").alias("key"), "n_rows")
        for fk in FOREIGN_KEYS])


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (rule, table_name, column_name, n_rows) for every broken constraint; empty when all hold."""
    found = [
        duplicate_keys(tables[t], k).agg(F.sum("n_rows").alias("n"))
        .select(F.lit("primary key").alias("rule"), F.lit(t).alias("table_name"), F.lit(k).alias("column_name"), "n")
        for t, k in PRIMARY_KEYS.items()]
    found.append(check_not_null(tables).select(F.lit("not null").alias("rule"), "table_name", "column_name",
                                               F.col("null_rows").alias("n")))
    found += [
        _orphans(tables, fk).agg(F.sum("n_rows").alias("n"))
        .select(F.lit("foreign key").alias("rule"), F.lit(fk.child).alias("table_name"),
                F.lit(fk.column).alias("column_name"), "n")
        for fk in FOREIGN_KEYS]
    return _union(found).where("n > 0").withColumnRenamed("n", "n_rows")


BROKEN = "broken_rule"


def mark_broken(df: DataFrame, name: str, parents: dict[str, DataFrame]) -> DataFrame:
    """``df`` with the first constraint each row breaks in ``broken_rule``, NULL for a valid row.

    ``parents`` holds the tables that references point to. All rows that share a duplicated primary key count as
    broken: which of them is right is not ours to guess.
    """
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in NOT_NULL[name]])
    rule = F.when(~complete, "not null")
    marked = df
    if name in PRIMARY_KEYS:
        key = PRIMARY_KEYS[name]
        marked = marked.join(duplicate_keys(df, key).select(key, F.lit(True).alias("_doubled")), key, "left")
        rule = rule.when(F.col("_doubled"), f"primary key {key}")
    for fk in (fk for fk in FOREIGN_KEYS if fk.child == name):
        known = parents[fk.parent].select(F.col(PRIMARY_KEYS[fk.parent]).alias(fk.column),
                                          F.lit(True).alias(f"_known_{fk.column}"))
        marked = marked.join(known, fk.column, "left")
        rule = rule.when(F.col(f"_known_{fk.column}").isNull(), f"foreign key {fk.column}")
    return marked.select(*df.columns, rule.alias(BROKEN))
