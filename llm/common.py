"""Helpers the operators share: words, Arrow columns, a session's limits, hashing on numpy arrays."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

# Rows and bytes of one Arrow batch: what a Python worker holds at a time stays bounded for texts of any length but one.
# Shuffle files go when the job that wrote them has ended; every result that is read again is a written table.
SESSION_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Apply the limits above to the session (they stay set) and let its Python workers find this checkout.

    Where executors do not see the checkout, ship it as any package (``--py-files``).
    """
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in [*known, ROOT] if p)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(texts: DataFrame, per_partition: int, bytes_per_bucket: int) -> int:
    """Shares to divide the hashes of a text column by: some for each shuffle partition, more where the texts have more bytes."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(per_partition * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_per_bucket))


def words(text: bytes | None) -> list[bytes]:
    """Runs of anything but \\x20 and \\x09-\\x0D, which is what ``bytes.split`` cuts at; a null text has none."""
    return text.split() if text else []


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return pc.cast(column, pa.large_binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def word_hashes(tokens: Iterable[bytes], n: int, seed: int = 0) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(w, seed) for w in tokens), np.uint64, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fold_of(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(data, kind)


def squeezed(array: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: small numbers take little room."""
    array = np.ascontiguousarray(array)
    planes = array.view(np.uint8).reshape(len(array), array.itemsize).T if len(array) else array.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def joined(pieces: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(pieces), kind)


def arrow_batches(columns: dict[str, list], schema: pa.Schema, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    whole = pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    yield from whole.to_batches(max_chunksize=rows)
