"""Operator 10: SimHash near-duplicates by meeting in the middle of a ball.

Two fingerprints that differ in at most ``2 * HALF`` bits have a common variant within ``HALF`` bits of each. Every distinct
fingerprint's variants (2081 for 2 of 64 bits) meet on the variant: the shuffle is on the variant's first ``prefix_bits``
bits, so a fingerprint travels once to each prefix that one of its variants has, and the variants themselves are made,
sorted and compared in the task of their prefix, a bounded number at a time. All fingerprints at one variant lie within twice
the half radius of each other, so they are linked as a star (verified by counting bits) instead of pair by pair.

Only distinct fingerprints take part, so exact copies cost nothing; documents get their component back by fingerprint.
Null and blank texts have fingerprint 0 and are linked like any other. A null id takes part but is never a component's
name unless all ids of the component are null (then the name is null). Empty tables give empty results. Only the two named
columns are read, so extra columns may have any name. A very long text is hashed shingle by shingle, in time in proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidesift.operators.staging import stage
from xxhash import xxh64_intdigest

from llm.common import byte_texts, column, packed, unpacked, words
from llm.components import components, star_links

BITS, SHINGLE, SEED, MAX_DISTANCE = 64, 4, 42, 4
VARIANTS_AT_ONCE = 6_000_000  # memory of a task; larger prefixes are divided further
LEAST_PREFIX_BITS = 10
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_PLACE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is set where more than half of the shingles' hashes have it."""
    tokens = words(text.lower()) if text else []
    if not tokens:
        return 0
    whole = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    n = len(starts)
    hashes = np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)),
                         "<u8", n)
    counts = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
    set_bits = (counts @ _BIT_OF_BYTE).ravel() * 2 > n
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, text_column: str = "text") -> DataFrame:
    """The given columns with a column ``fp`` (64 bits as a long) in place of the text."""
    kept = [c for c in documents.columns if c != text_column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in kept), "fp bigint"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in byte_texts(column(batch, text_column))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), pa.array(found.view(np.int64))], [*kept, "fp"])

    return documents.withColumn(text_column, F.col(text_column).cast("string")).mapInArrow(add, schema)


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``most`` ones."""
    return np.array([sum(1 << i for i in chosen) for k in range(most + 1) for chosen in combinations(range(bits), k)], np.uint64)


def _meet(fps: np.ndarray, prefix: int, prefix_bits: int, half: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Star links of the fingerprints whose variants with this prefix coincide. ``fps``: those that have such variants."""
    rest = BITS - prefix_bits
    low = np.uint64((1 << rest) - 1)
    away = np.bitwise_count((fps >> np.uint64(rest)) ^ np.uint64(prefix)) if prefix_bits else np.zeros(len(fps), np.uint8)
    groups = [(fps[away == d], half - d) for d in range(half + 1)]
    if sum(len(f) * math.comb(rest, k) for f, left in groups for k in range(left + 1)) > VARIANTS_AT_ONCE and rest > 4:
        found = []
        for more in range(16):
            inner = prefix << 4 | more
            near = np.bitwise_count((fps >> np.uint64(rest - 4)) ^ np.uint64(inner)) <= half
            if near.sum() > 1:
                found += _meet(fps[near], inner, prefix_bits + 4, half)
        return found
    variants, owners = [], []
    for group, left in groups:
        masks = flips(rest, left)
        variants.append(((group & low)[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(group, len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    # Few variants coincide: find their values first, then only sort those rows together with their owners.
    ordered = np.sort(variant)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return []
    places = np.minimum(np.searchsorted(twice, variant), len(twice) - 1)
    hit = twice[places] == variant
    variant, owner = variant[hit], owner[hit]
    order = np.lexsort((owner, variant))
    variant, owner = variant[order], owner[order]
    first = np.concatenate([[True], variant[1:] != variant[:-1]])
    least = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
    real = (least != owner) & (np.bitwise_count(least ^ owner) <= 2 * half)
    return [star_links(least[real], owner[real])] if real.any() else []


def near_links(distinct: DataFrame, n: int, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (low, high) that connect all distinct fingerprints ``fp`` within ``max_distance`` bits of each other.

    ``max_distance`` must be even: both sides emit their ball of half of it. ``n``, their number, only decides how finely the
    prefixes divide the work.
    """
    if max_distance % 2:
        raise ValueError("the distance must be even")
    half = max_distance // 2
    ball = sum(math.comb(BITS, k) for k in range(half + 1))
    prefix_bits = min(32, max(LEAST_PREFIX_BITS, math.ceil(math.log2(max(1, n * ball / (4 * VARIANTS_AT_ONCE))))))
    masks = flips(prefix_bits, half)

    def to_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def grouped() -> pa.RecordBatch:
            fps = np.concatenate(waiting)
            waiting.clear()
            prefix = ((fps >> np.uint64(BITS - prefix_bits))[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(prefix, kind="stable")
            prefix, fps = prefix[order], np.repeat(fps, len(masks))[order]
            starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            return pa.RecordBatch.from_arrays(
                [pa.array(prefix[starts].astype(np.int64)), pa.array([packed(p) for p in np.split(fps, starts[1:])], pa.binary())],
                ["prefix", "fps"])

        for batch in batches:
            waiting.append(column(batch, "fp").to_numpy().view(np.uint64))
            if sum(map(len, waiting)) >= 50_000:
                yield grouped()
        if waiting:
            yield grouped()

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        fps = np.unique(np.concatenate([unpacked(b, np.uint64) for b in rows["fps"].to_pylist()]))
        found = _meet(fps, key[0].as_py(), prefix_bits, half) if len(fps) > 1 else []
        if not found:
            return pa.table({"low": pa.array([], pa.int64()), "high": pa.array([], pa.int64())})
        a, b = star_links(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.table({"low": np.minimum(a, b), "high": np.maximum(a, b)})

    sent = distinct.mapInArrow(to_prefixes, "prefix bigint, fps binary")
    return sent.groupBy("prefix").applyInArrow(meet, "low bigint, high bigint")


def _rooted(marked: DataFrame, max_distance: int) -> DataFrame:
    """(fp, least_id, root) of every fingerprint: those that can be reached from each other have one root, the smallest."""
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    roots = components(near_links(distinct.select("fp"), distinct.count(), max_distance))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    read = documents.select(documents[id_column].alias("doc_id"), documents[text_column].alias("text"))
    marked = stage(fingerprints(read, shingle), "marked")
    rooted = _rooted(marked, max_distance)
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked.join(rooted.join(names, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def keep_one_per_group(documents: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE,
                       id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns as they were, with one row left of each component: that of the smallest id, null ids last.

    Rows alike in all columns are one row; among different rows of one id the smallest hash of the row decides.
    """
    names = [f"c{i}" for i in range(len(documents.columns))]  # whatever the columns are called
    plain = documents.toDF(*names)
    doc_id, text = names[documents.columns.index(id_column)], names[documents.columns.index(text_column)]
    # Maps have no hash, but a text; alike rows have alike texts as long as their maps list the keys in one order.
    row_hash = F.xxhash64(*[F.to_json(F.struct(n)) if _has_map(plain.schema[n].dataType) else F.col(n) for n in names])
    marked = stage(fingerprints(plain.select(F.col(doc_id).alias("doc_id"), row_hash.alias("row_hash"),
                                             F.col(text).alias("text")), shingle), "marked")
    component = _rooted(marked, max_distance).select("fp", "root")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_hash"))
    kept = stage(
        marked.groupBy("fp", "doc_id", "row_hash").agg(F.count("*").alias("copies")).join(component, "fp").groupBy("root")
        .agg(F.min_by(F.struct("doc_id", "row_hash", "copies"), place).alias("kept")).select("kept.*"), "kept")
    found = plain.withColumn("row_hash", row_hash).join(
        kept.withColumnsRenamed({"doc_id": "kept_id", "row_hash": "kept_hash"}),
        (F.col("row_hash") == F.col("kept_hash")) & F.col(doc_id).eqNullSafe(F.col("kept_id")))
    once = found.where("copies = 1").select(*names)
    # Repeated rows go through an aggregation that leaves one of them per task before the shuffle.
    repeated = (found.where("copies > 1").groupBy("kept_id", "kept_hash")
                .agg(F.first(F.struct(*names)).alias("row")).select("row.*"))
    return once.unionByName(repeated).toDF(*documents.columns)
