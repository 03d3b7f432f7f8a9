"""Intermediate tables in the shared checkpoint folder.

A staged frame is written as parquet and read back: later passes read only the columns they need, the lineage is
cut, and losing an executor costs no recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import delete


def staging_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="tidesift-")
    spark.sparkContext.setCheckpointDir(root)
    return staging_root(spark)


# What the enclosing blocks of this thread of control have staged; other threads have blocks of their own.
_open_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("open_scopes", default=())


def staging_path(spark: SparkSession, label: str) -> str:
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _open_scopes.get():
        made.append(path)
    return path


@contextmanager
def cleared_after(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged within the block when it ends; what is kept must have been written elsewhere by then.

    A block belongs to the thread that opened it (and to what that hands its context to), so runs side by side keep apart.
    """
    made: list[str] = []
    token = _open_scopes.set((*_open_scopes.get(), made))
    try:
        yield
    finally:
        _open_scopes.reset(token)
        for path in made:
            delete(spark, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def unstage(staged: DataFrame) -> None:
    """Delete the table behind a frame that :func:`stage` returned, once nothing will read it again."""
    delete(staged.sparkSession, staged._staged_path)


def with_evaluated(df: DataFrame, parsed: dict[str, Column]) -> DataFrame:
    """``df`` with columns replaced or added, each of them worked out once per row.

    A later filter on a computed column would otherwise be pushed below the projection together with a copy of the
    expression. Generator output stays where it is; the other columns pass by it, so unused ones are still pruned.
    """
    if not parsed:
        return df
    names = list(parsed)
    packed = F.inline(F.array(F.struct(*[parsed[n].alias(n) for n in names]))).alias(*[f"_parsed_{n}" for n in names])
    order = [*df.columns, *[n for n in names if n not in df.columns]]
    return df.select(*df.columns, packed).select(
        *[F.col(f"`_parsed_{n}`").alias(n) if n in parsed else F.col(f"`{n}`") for n in order])


def evaluated(df: DataFrame, *columns: Column) -> DataFrame:
    """``df.select(columns)`` in the same way, for a handful of columns that are all needed."""
    return df.select(F.inline(F.array(F.struct(*columns))))
