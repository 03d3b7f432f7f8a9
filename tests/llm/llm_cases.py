"""Small tables with the awkward rows every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use themselves.
CLASHING = ["digest", "spans", "chunk", "part", "fp", "row_hash", "root", "c0", "c1", "weight", "kept", "copies", "m", "row"]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    words = [f"w{draw.randrange(vocabulary)}x" for _ in range(n)]
    lines = [" ".join(words[i:i + 12]) + "." for i in range(0, n, 12)]
    return "\n".join(lines)


def awkward_rows() -> list[tuple]:
    shared = prose(99, 60)
    texts = [None, "", " \t\n\r\x0b\x0c ", "one", "A b", "x" * 3000, prose(1, 20_000, 5000), prose(2, 120), prose(2, 120),
             f"{prose(3, 50)} {shared}", f"{shared}\n{prose(4, 50)}", "naïve Straße  日本 🙂 <|endoftext|> é", "Ünïcödé ŁÓDŹ " * 30,
             "\x00 nul and \x85 and   and   are no spaces", "same same same same same same same same same same same same"]
    rows = [(i, t, ("en", "de", None)[i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, prose(2, 120), "en", None, None), (None, None, None, None, None), (None, prose(5, 80), "en", "s", 1),
             (3, "another row of an id that is there already, with a text of its own.", "de", "s", 0)]
    return rows


def awkward(spark: SparkSession, parts: int = 3) -> DataFrame:
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(parts)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


def table_of(df: DataFrame) -> list:
    """Rows without order, nulls and floats included."""
    return sorted(map(tuple, df.collect()), key=repr)


def shape(df: DataFrame) -> list:
    return [(f.name, f.dataType) for f in df.schema]
