"""Run queries next to their SQL and compare rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
              "conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, Decimal):
        return format(v, "f")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def table(columns: list[str], rows: list) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(r[i]) for i in order) for r in rows)


# Names of the same type in both engines.
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "timestamp_ntz": "TIMESTAMP"}


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want_types = {d[0]: str(d[1]) for d in result.description}
    want = table(want_columns, result.fetchall())
    got = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    got_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    typed = [f"{c}: {t} / {want_types[c]}" for c, t in got_types.items()
             if _TYPES.get(t, t.upper()).replace(",", ", ") != want_types[c].replace(",", ", ").replace(",  ", ", ")]
    if got[1] != want[1]:
        extra, missing = list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3]
        return (f"rows {sum(got[1].values())} / {sum(want[1].values())}, differing {sum((got[1] - want[1]).values())}\n"
                f"  columns {got[0]}\n  only spark {extra}\n  only sql   {missing}")
    return f"types {typed}" if typed else None
