"""Raw and processed CSV tables."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import INFER, readings
from ..functions.values import clean_text, to_timestamp
from ..operators.cleaning import clean_tables
from ..schemas import RAW_FILES, RAW_SCHEMAS, TABLES


# Quotes are escaped by doubling them, and spaces around a value belong to it, in what is read and in what is written.
READ_OPTIONS = {"header": True, "quote": '"', "escape": '"'}
WRITE_OPTIONS = {**READ_OPTIONS, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
RECORD = "_record"
HEADERS_READ = 1000  # files of a folder whose headers are looked at one by one; more must all have the first one's


class AmbiguousDate(UserWarning):
    """The date that decides the format has a second reading."""


def read_csv(spark: SparkSession, path: str, schema=None, file_order: bool = False, multi_line: bool = True,
             extra_fields: str = "fail", counted: Observation | None = None) -> DataFrame:
    """CSV with a header, all columns as text unless a schema is given; a missing path raises.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per file: large inputs should come in many files,
    or, known to have no such breaks, be read with it off. Records with fewer fields than the header are filled with NULL.
    A record with more fields, empty ones included, raises (``fail``) or is left out (``drop``); ``counted`` then gets the number of
    those left out as ``extra`` when the frame is written. Without a schema the headers are read, not the data: the files of a folder may
    order their columns in different ways or lack some (NULL); beyond ``HEADERS_READ`` files, and with a schema, a file whose
    header differs raises when it is read. ``file_order`` adds where each row stood: a row's number within its file block
    grows with its position, so (file, block, row) orders the rows as the files do.
    """
    if extra_fields not in ("fail", "drop"):
        raise ValueError(f"extra_fields must be 'fail' or 'drop', not {extra_fields!r}")
    df = _records(spark, path, schema, multi_line, file_order)
    extra = F.col("_extra")
    if counted is not None:
        df = df.observe(counted, F.count_if(extra).alias("extra"))
    if extra_fields == "fail":
        broken = F.concat(F.lit(f"{path}: record with more fields than the header: "), F.substring(F.col(RECORD), 1, 200))
        df = df.where(F.when(~extra, F.lit(True)).otherwise(F.raise_error(broken).cast("boolean")))
    else:
        df = df.where(~extra)
    return df.drop(RECORD, "_extra")


def n_fields(record: Column) -> Column:
    """Fields of a record: commas outside quotes, and one. A field is quoted if it begins with a quote."""
    unquoted = F.regexp_replace(F.replace(record, F.lit('""'), F.lit("")), '(^|,)"[^"]*"', "$1")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1


def _headers(spark: SparkSession, path: str, multi_line: bool) -> dict[tuple[str, ...], list[str]]:
    """Files by the names in their headers; all under the first one's beyond ``HEADERS_READ`` files."""
    reader = spark.read.options(**READ_OPTIONS, multiLine=multi_line)
    whole = reader.csv(path)
    files = sorted(whole.inputFiles())
    if len(files) < 2 or len(files) > HEADERS_READ:
        return {tuple(whole.columns): [path]}
    with ThreadPoolExecutor(16) as pool:
        names = list(pool.map(lambda f: tuple(spark.read.options(**READ_OPTIONS, multiLine=multi_line).csv(f).columns), files))
    by_names: dict[tuple[str, ...], list[str]] = {}
    for f, n in zip(files, names, strict=True):
        if n:  # an empty file has no header and no rows
            by_names.setdefault(n, []).append(f)
    return {n: [path] for n in by_names} if len(by_names) == 1 else by_names


def _records(spark: SparkSession, path: str, schema: T.StructType | str | None, multi_line: bool, file_order: bool) -> DataFrame:
    """All columns, the text of a record whose number of fields differs from the header's, and whether it has more."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    parts = []
    groups = {tuple(schema.names): [path]} if schema is not None else _headers(spark, path, multi_line)
    for names, files in groups.items():
        fields = [*(schema.fields if schema is not None else [T.StructField(n, T.StringType()) for n in names]),
                  T.StructField(RECORD, T.StringType())]
        df = spark.read.options(**READ_OPTIONS, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD,
                                enforceSchema=False, columnPruning=False).schema(T.StructType(fields)).csv(files)
        # Nothing of the first column is added to the text: Spark refuses to read a record's text alone.
        nothing = F.left(F.coalesce(F.col(f"`{names[0]}`").cast("string"), F.lit("")), F.lit(0))
        extra = F.coalesce(n_fields(F.concat(F.col(RECORD), nothing)) > len(names), F.lit(False)).alias("_extra")
        where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                 F.monotonically_increasing_id().alias("_row")] if file_order else []
        parts.append(df.select("*", extra, *where))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def extra_records(spark: SparkSession, path: str, multi_line: bool = True) -> int:
    """Number of records that have more fields than the header."""
    return _records(spark, path, None, multi_line, False).where("_extra").count()


def read_raw(spark: SparkSession, raw_dir: str, files: Mapping[str, str] = RAW_FILES, fixed_headers: bool = False,
             multi_line: bool = True, extra_fields: str = "fail", counted: Mapping[str, Observation] | None = None) -> dict[str, DataFrame]:
    """The four raw tables. Optional columns may be absent; ``fixed_headers`` insists on the full header."""
    return {name: read_csv(spark, f"{raw_dir}/{file}", RAW_SCHEMAS[name] if fixed_headers else None,
                           name == "purchases", multi_line, extra_fields, (counted or {}).get(name))
            for name, file in files.items()}


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**WRITE_OPTIONS).csv(path)
    return path


@dataclass
class Intake:
    """What one pass over the raw files wrote and counted on the way."""

    paths: dict[str, str]
    extra_records: dict[str, int] = field(default_factory=dict)  # left out: more fields than the header
    unparsed_dates: int = 0  # header dates that are there but fit no format
    date_formats: tuple[str, ...] = ()  # the formats used; none: ISO notation


def first_date(spark: SparkSession, path: str, multi_line: bool = True) -> str | None:
    """The first date of the raw headers that is there, in the order of the files; files after the one that has it are not read."""
    for names, files in sorted(_headers(spark, path, multi_line).items(), key=lambda g: g[1]):
        if "date" not in names:
            continue
        for f in sorted(spark.read.options(**READ_OPTIONS, multiLine=multi_line).csv(files).inputFiles()):
            raw = read_csv(spark, f, file_order=True, multi_line=multi_line, extra_fields="drop")
            text = clean_text(F.col("date"))
            found = raw.where(text.isNotNull()).agg(F.min(F.struct("_block", "_row", text.alias("date"))).alias("first")).first()["first"]
            if found:
                return found["date"]
    return None


def clean_and_write(spark: SparkSession, raw_dir: str, processed_dir: str, date_formats: Sequence[str] | str = (),
                    multi_line: bool = True, extra_fields: str = "fail") -> Intake:
    """Clean all four raw tables and write them as CSV, each in one pass that also counts what was left out.

    ``date_formats``: patterns header dates may have, none for ISO notation, or ``"infer"``: the format of the first date in the files. If that
    one can be read in two ways, the month is taken to come first, and a warning says so before anything is read.
    """
    if date_formats == INFER:
        text = first_date(spark, f"{raw_dir}/{RAW_FILES['purchases']}", multi_line)
        found = readings(text) if text else []
        if len(found) > 1:
            warnings.warn(f"the first date {text!r} is read as {found[0]}; it can be read as {found[1]} too", AmbiguousDate, stacklevel=2)
        date_formats = found[:1]
    date_formats = tuple(date_formats)
    counted = {name: Observation(f"raw {name}") for name in RAW_FILES}
    dates = Observation("raw dates")
    raw = read_raw(spark, raw_dir, multi_line=multi_line, extra_fields=extra_fields, counted=counted)
    has_dates = "date" in raw["purchases"].columns
    if has_dates:
        parsed = to_timestamp(F.col("date"), T.StringType(), date_formats)
        raw["purchases"] = raw["purchases"].observe(
            dates, F.count_if(clean_text(F.col("date")).isNotNull() & parsed.isNull()).alias("unparsed"))
    paths = {name: write_csv(df, f"{processed_dir}/{name}_clean") for name, df in clean_tables(raw, date_formats=date_formats).items()}
    return Intake(paths, {n: o.get["extra"] for n, o in counted.items()}, dates.get["unparsed"] if has_dates else 0, date_formats)


def read_processed(spark: SparkSession, paths: Mapping[str, str], multi_line: bool = True) -> dict[str, DataFrame]:
    return {name: read_csv(spark, path, TABLES[name], multi_line=multi_line) for name, path in paths.items()}
