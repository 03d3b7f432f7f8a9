"""Column expressions that turn raw text into typed values: bad input becomes NULL, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts pandas reads as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The characters Unicode counts as whitespace.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Letters no plain number has: only the JVM parser takes '1d', '1f' or '0x1p3', and NaN is not a value.
_FOREIGN = r"[dDfFxXaA]"
_INFINITY = r"^\s*[+-]?(?i:inf|infinity)\s*$"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only blanks."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def clean_text(c: Column) -> Column:
    return na_to_null(strip(c))


def finite_or_null(c: Column) -> Column:
    """NaN becomes NULL (Spark ranks NaN above every number); infinities stay."""
    return F.when(~F.isnan(c), c)


def to_number(c: Column, source: T.DataType | None = None) -> Column:
    """Double value of ``c`` or NULL. ``source`` is the column's type; text is assumed without it."""
    if isinstance(source, T.DecimalType):
        return c
    if source is not None and not isinstance(source, T.StringType):
        return finite_or_null(c.cast("double"))
    return F.when(~c.rlike(_FOREIGN) | c.rlike(_INFINITY), c.try_cast("double"))


def to_timestamp(c: Column, source: T.DataType | None = None, formats: Sequence[str] = ()) -> Column:
    """Wall-clock timestamp, else NULL: ISO notation, or the first format that matches if formats are given."""
    if not formats or (source is not None and not isinstance(source, T.StringType)):
        return c.try_cast("timestamp_ntz")
    text = strip(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")
