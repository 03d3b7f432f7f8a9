"""Named result tables, one folder each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv_tables import WRITE_OPTIONS


def write_report(sheets: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every frame to ``folder/<name>`` and return the paths. ``fmt`` is ``parquet`` or ``csv``."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown report format {fmt!r}")
    paths = {}
    for name, df in sheets.items():
        paths[name] = f"{folder}/{name}"
        writer = df.write.mode("overwrite")
        if fmt == "parquet":
            writer.parquet(paths[name])
        else:
            nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType))]
            flat = df.withColumns({c: F.to_json(c) for c in nested})
            flat.write.mode("overwrite").options(**WRITE_OPTIONS).csv(paths[name])
    return paths


def read_report(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(path) for name, path in paths.items()}
