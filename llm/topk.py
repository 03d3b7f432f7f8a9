"""Operator 5: exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets (each spans a fixed ratio of lengths), a bucket by its vectors' largest coordinate, and what
is left is divided into blocks of at most about ``BLOCK`` rows, sorted by length. Queries, in blocks of their own, first meet a bounded number
of the longest vectors (``k + 1`` blocks at most), which gives every query a lower bound of its k-th best score. With it, whole buckets drop out:
a product is at most the product of the lengths. In a bucket that stays, the bound gives each query a local cosine threshold. A block whose
directions, coordinate by coordinate, lie in ranges that the query cannot meet at that cosine drops out as a whole, which is what
divides vectors of equal length; of the others a low threshold prunes by length (a prefix of the block), a high one by
coordinate (the query's largest coordinate confines that of a vector within the threshold's angle). What remains is verified by exact
integer products. Bounds are loosened by more than the rounding error of the doubles they are worked out in, so pruning never loses a result.

Joins are on the name of a block or of a query block, never on the dimension alone, which all vectors may share: what goes with a dimension
is repeated for a fixed number of shares, and the query blocks are dealt to these.

Components become floor(scale * x). A vector that is null, empty or holds a null or non-finite component takes no part, nor does one with
a null id or with a floored component that does not fit a long; zero vectors do. Products that may not fit a long are worked
out in integers of any size, and the query fails if one of its results does not fit. Only vectors of one dimension are
compared. Equal scores go to the smaller id, then to the earlier row; a row is no candidate of itself, but another row
with the same id or vector is. A query gets fewer rows if there are fewer candidates, none if there are none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tidesift.operators.staging import stage

from llm.common import column, packed, unpacked

K, SCALE, RATIO, BLOCK, QUERY_BLOCK = 5, 256.0, 1.1, 2048, 256
SHARES = 32  # query blocks of one dimension are dealt to so many tasks
HIGH_COSINE = 0.5  # thresholds from here on prune by coordinate
SLACK = 1e-9
LONG = 1 << 63
SAFE = float(1 << 62)  # a product of lengths below this, rounded as it is, leaves a product of the vectors that fits a long


def scaled(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Usable rows of a list column: their places, dimensions, and all their floored components in one array."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(pc.list_flatten(vectors), pa.float64()).to_numpy(zero_copy_only=False)
    floored = np.floor(values * scale)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    fits = (floored >= -float(LONG)) & (floored < float(LONG))  # false for NaN
    usable = (lengths > 0) & (np.bincount(owner, weights=~fits, minlength=len(lengths)) == 0)
    kept = usable[owner]
    return np.flatnonzero(usable), lengths[usable], floored[kept].astype(np.int64)


def _prepared(vectors: DataFrame, is_query: Column, scale: float, ratio: float, id_column: str, vector_column: str) -> DataFrame:
    """Usable vectors: row number, id, dimension, length, bucket of lengths, components."""
    read = vectors.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            places, dims, flat = scaled(column(batch, "vector"), scale)
            parts = np.split(flat, np.cumsum(dims)[:-1]) if len(dims) else []
            length = np.array([math.sqrt(float(np.dot(p.astype(float), p.astype(float)))) for p in parts])
            bucket = np.where(length > 0, np.ceil(np.log(np.maximum(length, 1)) / math.log(ratio)), -1)
            focus = [2 * (i := int(np.abs(p.astype(float)).argmax())) + int(p[i] < 0) for p in parts]
            chosen = pa.array(places)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(places))), column(batch, "vec_id").take(chosen), column(batch, "is_query").take(chosen),
                 pa.array(dims, pa.int64()), pa.array(length, pa.float64()), pa.array(bucket, pa.int64()),
                 pa.array(focus, pa.int64()), pa.array([packed(p) for p in parts], pa.binary())],
                ["row", "vec_id", "is_query", "dim", "length", "bucket", "focus", "components"])
            row += len(places)

    return read.mapInArrow(prepare, "row bigint, vec_id bigint, is_query boolean, dim bigint, length double, bucket bigint, "
                                    "focus bigint, components binary")


_NAME = ["dim", "bucket", "focus", "part"]
_BLOCK_SCHEMA = ("dim bigint, bucket bigint, focus bigint, part bigint, most double, `n` bigint, `rows` binary, ids binary, lengths binary, "
                 "matrix binary")


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of one block in one row, longest first."""
    length = table["length"].to_numpy()
    order = np.lexsort((table["row"].to_numpy(), -length))
    parts = table["components"].to_pylist()
    cells = [*(pa.scalar(int(c), pa.int64()) for c in key[0].as_py().split()), pa.scalar(float(length.max())), pa.scalar(len(length), pa.int64()), *(pa.scalar(packed(v), pa.binary()) for v in (
        table["row"].to_numpy()[order], table["vec_id"].to_numpy()[order], length[order]))]
    cells.append(pa.scalar(b"".join(parts[i] for i in order), pa.binary()))
    return pa.table([pa.array([c.as_py()], c.type) for c in cells], [*_NAME, "most", "n", "rows", "ids", "lengths", "matrix"])


class Block:
    def __init__(self, dim: int, rows: bytes, ids: bytes, lengths: bytes, matrix: bytes):
        self.rows, self.ids, self.lengths = unpacked(rows, np.int64), unpacked(ids, np.int64), unpacked(lengths, np.float64)
        self.matrix = unpacked(matrix, np.int64).reshape(len(self.rows), dim)

    def directions(self) -> np.ndarray:
        return self.matrix / np.maximum(self.lengths, 1e-300)[:, None]


def candidates(block: Block, queries: Block, bounds: np.ndarray) -> np.ndarray:
    """Places of the queries that a vector of the block can still matter to, by lengths and by the ranges of its directions."""
    most = float(block.lengths[0])
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        cosine = np.where(queries.lengths * most > 0, bounds / (queries.lengths * most), np.where(bounds <= 0, -np.inf, np.inf))
    # A bound below 0 says nothing: a short vector's product may be nearer to 0 than the longest one's.
    cosine = np.where(cosine > 0, cosine - SLACK * (1 + np.abs(cosine)), -np.inf)
    ours, theirs = block.directions(), queries.directions()
    highest = np.maximum(theirs, 0) @ ours.max(axis=0) + np.minimum(theirs, 0) @ ours.min(axis=0)
    return np.flatnonzero(np.minimum(highest + SLACK * (1 + np.abs(highest)), 1 + SLACK) >= cosine)


def remaining(block: Block, query: np.ndarray, length: float, bound: float) -> np.ndarray:
    """Places in the block whose product with the query can reach the bound."""
    n = len(block.rows)
    if bound == -math.inf or length == 0:
        return np.arange(n) if bound <= 0 else np.arange(0)
    most = block.lengths[0]
    cosine = bound / (length * most) if most > 0 else (0.0 if bound <= 0 else 2.0)
    cosine -= SLACK * (1 + abs(cosine))
    if cosine > 1:
        return np.arange(0)
    if cosine <= 0:
        return np.arange(n)
    # Products grow with length: only vectors of at least bound / |query| can reach it.
    prefix = int(np.searchsorted(-block.lengths, -(bound / length) * (1 - SLACK), side="right"))
    if cosine < HIGH_COSINE:
        return np.arange(prefix)
    focus = int(np.abs(query).argmax())
    middle, reach = math.acos(max(-1.0, min(1.0, query[focus] / length))), math.acos(min(1.0, cosine)) + SLACK ** 0.5
    low = -1.0 if middle + reach >= math.pi else math.cos(middle + reach)
    high = 1.0 if middle - reach <= 0 else math.cos(middle - reach)
    share = block.matrix[:prefix, focus] / np.maximum(block.lengths[:prefix], 1e-300)
    return np.flatnonzero((share >= low - SLACK) & (share <= high + SLACK))


def products(block: Block, places: np.ndarray, query: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """Products of the block's rows at the places with a query, and 1 or -1 where one is above or below what a long holds (else 0)."""
    scores = block.matrix[places] @ query  # modulo 2^64
    beyond = np.zeros(len(places), np.int64)
    wide = np.flatnonzero(block.lengths[places] * length >= SAFE)
    if len(wide):
        numbers = query.tolist()
        for i in wide.tolist():
            exact = sum(a * b for a, b in zip(block.matrix[places[i]].tolist(), numbers, strict=True))
            beyond[i] = (exact >= LONG) - (exact < -LONG)
    return np.where(beyond == 0, scores, 0), beyond


def best_of_block(block: Block, row: int, query: np.ndarray, length: float, bound: float,
                  k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows, scores, beyond) of the block's k best for a query that can reach the bound."""
    places = remaining(block, query, length, bound)
    places = places[block.rows[places] != row]
    scores, beyond = products(block, places, query, length)
    # ~ turns the order around without overflow.
    order = np.lexsort((block.rows[places], block.ids[places], ~scores, -beyond))[:k]
    return block.ids[places[order]], block.rows[places[order]], scores[order], beyond[order]


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows in blocks of about ``size``; what has many rows gets as many parts as it needs."""
    keys = _NAME[:3]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("parts"))
    divided = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    # One text as the key: the shuffle of the join above must not do for the parts of a bucket as well.
    named = divided.withColumn("name", F.concat_ws(" ", *[F.col(c).cast("string") for c in _NAME]))
    return named.groupBy("name").applyInArrow(_block, _BLOCK_SCHEMA)


_PAIR = ["dim", "q_part", "q_rows", "q_ids", "q_lengths", "q_matrix", "q_bounds", "rows", "ids", "lengths", "matrix"]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block, Block, np.ndarray]]:
    for batch in batches:
        for pair in batch.to_pylist():
            queries = Block(pair["dim"], pair["q_rows"], pair["q_ids"], pair["q_lengths"], pair["q_matrix"])
            block = Block(pair["dim"], pair["rows"], pair["ids"], pair["lengths"], pair["matrix"])
            bounds = unpacked(pair["q_bounds"], np.float64) if pair["q_bounds"] else np.full(len(queries.rows), -math.inf)
            yield pair, queries, block, bounds


def _dealt(queries: DataFrame, by_dimension: DataFrame) -> DataFrame:
    """Query blocks with the rows of their dimension, joined in ``SHARES`` shares of the query blocks."""
    share = F.pmod(F.xxhash64("q_part"), F.lit(SHARES)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    return queries.withColumn("share", share).join(by_dimension.withColumn("share", every), ["dim", "share"]).drop("share")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, ratio: float = RATIO, block: int = BLOCK,
          query_block: int = QUERY_BLOCK, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's ``k`` highest products with all other rows."""
    rows = stage(_prepared(vectors, is_query, scale, ratio, id_column, vector_column), "vectors")
    blocks = stage(_blocks(rows, block), "blocks")
    # Queries are few: their blocks are filled whatever their lengths and directions.
    asked = rows.where("is_query").withColumns({c: F.lit(0).cast("bigint") for c in ("bucket", "focus")})
    queries = stage(_blocks(asked, query_block).select("dim", *[F.col(c).alias(f"q_{c}") for c in ("part", "rows", "ids", "lengths", "matrix")]),
                    "query-blocks")

    # The longest vectors of each dimension: the fewest blocks, from the top, with more than k rows; k + 1 blocks have them.
    names = blocks.select(*_NAME, "most", "n")
    from_top = Window.partitionBy("dim").orderBy(F.desc("bucket"), "focus", "part")
    top = names.withColumn("place", F.row_number().over(from_top)).where(F.col("place") <= k + 1)
    longer = F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = blocks.join(top.withColumn("longer", longer).where(F.col("longer") <= k).select(*_NAME), _NAME)

    def bounds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, q, b, _ in _pairs(batches):
            found = np.full((len(q.rows), k), -math.inf)
            for i, query in enumerate(q.matrix):
                scores, beyond = best_of_block(b, q.rows[i], query, q.lengths[i], -math.inf, k)[2:]
                found[i, :len(scores)] = np.select([beyond > 0, beyond < 0], [float(LONG), -math.inf], scores)
            yield pa.RecordBatch.from_arrays([pa.array([pair["dim"]]), pa.array([pair["q_part"]]), pa.array([packed(found)], pa.binary())],
                                             ["dim", "q_part", "found"])

    def combined(key: tuple, table: pa.Table) -> pa.Table:
        found = np.concatenate([unpacked(b, np.float64).reshape(-1, k) for b in table["found"].to_pylist()], axis=1)
        bounds = np.sort(found, axis=1)[:, -k]
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([packed(bounds)], pa.binary())],
                        ["dim", "q_part", "q_bounds"])

    met = _dealt(queries.withColumn("q_bounds", F.lit(None).cast("binary")), seeds).select(*_PAIR)
    bounds = (met.mapInArrow(bounds_of, "dim bigint, q_part bigint, found binary").groupBy("dim", "q_part")
              .applyInArrow(combined, "dim bigint, q_part bigint, q_bounds binary"))
    bounded = queries.join(bounds, ["dim", "q_part"], "left")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shortest vector that can still matter to any query of the block."""
        for batch in batches:
            least = []
            for lengths, bounds_ in zip(column(batch, "q_lengths").to_pylist(), column(batch, "q_bounds").to_pylist(), strict=True):
                length = unpacked(lengths, np.float64)
                bound = unpacked(bounds_, np.float64) if bounds_ else np.full(len(length), -math.inf)
                need = np.where(bound <= 0, 0.0, bound / np.maximum(length, 1e-300))
                least.append(float(need.min()) * (1 - SLACK))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.float64())], [*batch.schema.names, "least"])

    limited = stage(bounded.mapInArrow(reach, T.StructType([*bounded.schema.fields, T.StructField("least", T.DoubleType())])), "bounded-queries")

    # A query block goes to the candidate blocks whose longest vector it can need. The smaller side, the queries, is what travels with
    # each pair of names; a block travels once.
    needed = _dealt(limited.select("dim", "q_part", "least"), names).where("most >= least").select(*_NAME, "q_part")
    pairs = needed.join(limited.drop("least"), ["dim", "q_part"]).join(blocks, _NAME).select(*_PAIR)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, b, bound in _pairs(batches):
            alive = candidates(b, q, bound)
            if not len(alive):
                continue
            found = [best_of_block(b, q.rows[i], q.matrix[i], q.lengths[i], bound[i], k) for i in alive]
            sizes_ = [len(f[0]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q.rows[alive], sizes_)), pa.array(np.repeat(q.ids[alive], sizes_)),
                 *(pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in range(4))],
                ["query_row", "query_id", "vec_id", "row", "score", "beyond"])

    found = pairs.mapInArrow(best, "query_row bigint, query_id bigint, vec_id bigint, `row` bigint, score bigint, beyond bigint")
    order = Window.partitionBy("query_row").orderBy(F.desc("beyond"), F.desc("score"), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.format_string(
                "the product of vectors %s and %s does not fit a long", "query_id", "vec_id")).cast("bigint")).alias("score")))


# All products in DuckDB.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, b.r AS other,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other))::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
