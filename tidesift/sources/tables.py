"""Stored tables: checked full-refresh load and read-back.

A load writes all tables into a new folder and then names it in one small file, which readers look up. Until then they read
the tables of the last complete load; a load that fails on the way changes nothing for them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import files
from ..operators.constraints import BROKEN, mark_broken, violations
from ..operators.staging import stage
from ..schemas import LOAD_ORDER, TABLES


CURRENT = "_current"


class ConstraintError(ValueError):
    """Input breaks a key, NOT NULL or reference rule."""


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the stored table in their order and type; an optional column that is absent is NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in TABLES[name].fields])


def load_tables(tables: dict[str, DataFrame], target: str, on_violation: str = "fail") -> dict[str, DataFrame]:
    """Replace all stored tables under ``target`` by the given ones, parents first; return them as read back.

    A table is written once, in parts by the rule its rows break; the part without one is the table, the others are what
    ``read_rejected`` returns. ``fail`` checks before anything is written, raises and leaves the old tables as they are;
    ``quarantine`` loads the valid rows and sets the others aside. The tables change all at once when the last is written. The load
    before this one is kept for those who are reading it, older ones are deleted.
    """
    if on_violation not in ("fail", "quarantine"):
        raise ValueError(f"on_violation must be 'fail' or 'quarantine', not {on_violation!r}")
    spark = tables["customers"].sparkSession
    ready = {name: conform(tables[name], name) for name in LOAD_ORDER}
    if on_violation == "fail":
        # The checks and the write read each table several times; parsed and conformed once, they read columns.
        ready = {name: stage(df, f"conformed-{name}") for name, df in ready.items()}
        broken = violations(ready).collect()  # one row per rule at most
        if broken:
            raise ConstraintError("; ".join(f"{r.rule} {r.table_name}.{r.column_name}: {r.n_rows} rows"
                                            for r in broken))
    before = files.read_text(spark, f"{target}/{CURRENT}")
    version = f"load-{uuid.uuid4().hex}"
    loaded: dict[str, DataFrame] = {}
    for name in LOAD_ORDER:
        valid = F.lit(None).cast("string").alias(BROKEN)
        marked = ready[name].select("*", valid) if on_violation == "fail" else mark_broken(ready[name], name, loaded)
        marked.write.partitionBy(BROKEN).parquet(f"{target}/{version}/{name}")
        loaded[name] = _valid(_stored(spark, f"{target}/{version}", name))
    files.replace_text(spark, f"{target}/{CURRENT}", version)
    for old in files.folders(spark, target):
        if old.startswith("load-") and old not in (version, before):
            files.delete(spark, f"{target}/{old}")
    return loaded


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = T.StructType([*TABLES[name].fields, T.StructField(BROKEN, T.StringType())])
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def _valid(stored: DataFrame) -> DataFrame:
    return stored.where(F.col(BROKEN).isNull()).drop(BROKEN)


def current_load(spark: SparkSession, target: str) -> str:
    """Folder of the last complete load."""
    version = files.read_text(spark, f"{target}/{CURRENT}")
    if version is None:
        raise FileNotFoundError(f"{target} has no complete load")
    return f"{target}/{version}"


def read_table(spark: SparkSession, target: str, name: str) -> DataFrame:
    return _valid(_stored(spark, current_load(spark, target), name))


def read_tables(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """All tables of one and the same load, the last complete one."""
    return read_load(spark, current_load(spark, target))


def read_load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the load that ``folder`` holds, as ``current_load`` names it."""
    return {name: _valid(_stored(spark, folder, name)) for name in LOAD_ORDER}


def read_rejected(spark: SparkSession, target: str, name: str) -> DataFrame:
    """Rows a quarantining load set aside, with the rule each of them breaks."""
    return _stored(spark, current_load(spark, target), name).where(F.col(BROKEN).isNotNull())


def save_as_tables(tables: dict[str, DataFrame], database: str) -> None:
    """The same full refresh into catalog tables ``database.<name>``."""
    for name in LOAD_ORDER:
        conform(tables[name], name).write.mode("overwrite").saveAsTable(f"{database}.{name}")
