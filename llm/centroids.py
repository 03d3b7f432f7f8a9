"""Operator 13: exact centroid clustering (Lloyd's rounds) by Shallot search.

Every vector carries its nearest and second-nearest centroid with an upper bound of the distance to the first and a lower bound of the
distance to all others. When the centroids have moved, the bounds are widened by the moves; a vector whose bounds still
part, or whose upper bound is less than half the way to its centroid's neighbour, keeps its centroid unseen. For the others, the
closer one of the two remembered centroids is the middle of a ball whose radius is the vector's distance to it plus that to the second
nearest found so far: by the triangle inequality no centroid beyond can be nearer. The middle's neighbours are looked at in order
of their distance to it, so the ball shrinks while it is searched. Distances of survivors are compared as integers (equal
ones: the smaller number), and bounds are loosened by far more than the rounding of the doubles that they are kept in.

Spark holds the vectors in blocks of about ``BLOCK``, a row each, with their bounds. A round is one pass over the blocks: it writes them with
new bounds, and one row per task with the sums of its vectors, which Spark adds up per centroid and component. What is sent to the
tasks and comes back to the driver are the centroids (``k`` times ``dims`` integers), whatever the number of vectors; a
round's table is deleted when the second one after it has been written.

A vector takes part if it has exactly ``dims`` components, none of them null or non-finite, and each floor(scale * x) fits a long.
A null id is hashed as an empty text; equal ids are vectors of their own, in order of their components where they tie for a start.
With fewer vectors than ``k``, each is a start; without any there are no rows. Equal starts are allowed: the smaller number takes the
vectors, the other stays as it is. A distance or inertia beyond a long fails the query. Columns beside the two named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tidesift.operators.staging import stage, unstage

from llm.common import column, packed, squeezed, unpacked, unsqueezed

K, DIMS, ROUNDS, SCALE, SEED = 40, 64, 5, 256.0, "2"
BLOCK = 4096
SAFE = 1 << 27  # components up to here: differences, squares and their sum over 64 components fit a long
_BLOCKS, _SUMS, _STARTS = range(3)
_STATE = ["kind", "ids", "values", "places", "bounds", "number", "count", "sums", "hash"]


def _schema(id_type: str) -> str:
    return (f"kind int, ids array<{id_type}>, values binary, places binary, bounds binary, number int, count bigint, "
            "sums array<decimal(38,0)>, hash string")


def _row(id_type: pa.DataType, kind: int, ids=None, values=None, places=None, bounds=None, number=None, count=None, sums=None,
         hashed=None) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(),
             pa.list_(pa.decimal128(38, 0)), pa.string())
    cells = (kind, ids, values, places, bounds, number, count, sums, hashed)
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], _STATE)


def stored(x: np.ndarray) -> bytes:
    """Integers in the smallest type that holds them all, compressed."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + squeezed(x.astype(kind).ravel())


def restored(data: bytes, dims: int) -> np.ndarray:
    """int64, or Python integers where squares might not fit."""
    x = unsqueezed(data[1:], np.dtype(f"i{data[0]}")).astype(np.int64).reshape(-1, dims)
    return x if not x.size or (x.max() <= SAFE and x.min() >= -SAFE) else x.astype(object)


def squares(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=1)


def roots(distances: np.ndarray) -> np.ndarray:
    return np.sqrt(distances.astype(np.float64))


class Centroids:
    """Centroids of one round: their neighbours in order of distance, and how far they have moved since the last one."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.rows, self.k = rows, len(rows)
        c = np.array(rows, object).reshape(self.k, -1)
        self.small = all(-SAFE <= v <= SAFE for r in rows for v in r)
        self.exact = c.astype(np.int64) if self.small else c
        self.apart = np.array([roots(squares(self.exact - row)) for row in self.exact]).reshape(self.k, self.k)
        # Each is its own first neighbour, also beside an equal one.
        self.order = np.argsort(self.apart - np.eye(self.k), axis=1, kind="stable")
        self.half = self.apart[np.arange(self.k), self.order[:, 1]] / 2 if self.k > 1 else np.full(1, np.inf)
        moved = roots(squares(c - np.array(before, object).reshape(self.k, -1))) if before else np.zeros(self.k)
        self.moved = moved * (1 + 1e-9)
        largest = np.sort(self.moved)[::-1]
        others = np.full(self.k, largest[0])
        others[np.argmax(self.moved)] = largest[1] if self.k > 1 else 0.0
        self.others_moved = others

    def distances(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return squares(x - self.exact[to])


def _before(d: np.ndarray, i: np.ndarray, than_d: np.ndarray, than_i: np.ndarray) -> np.ndarray:
    return ((d < than_d) | ((d == than_d) & (i < than_i))).astype(bool)


def search(x: np.ndarray, near: np.ndarray, second: np.ndarray, c: Centroids) -> tuple[np.ndarray, ...]:
    """Nearest and second-nearest centroid of each vector with their squared distances, started from the two given ones."""
    d1, d2 = c.distances(x, near), c.distances(x, second)
    swap = _before(d2, second, d1, near)
    i1, i2 = np.where(swap, second, near), np.where(swap, near, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    middle, known, reach = i1.copy(), i2.copy(), roots(d1)
    active = np.arange(len(x))
    for rank in range(1, c.k):
        j = c.order[middle[active], rank]
        ball = (reach[active] + roots(d2[active])) * (1 + 1e-9) + 1e-9
        inside = c.apart[middle[active], j] <= ball
        active, j = active[inside], j[inside]
        if not len(active):
            break
        new = j != known[active]
        at, j = active[new], j[new]
        d = c.distances(x[at], j)
        first = _before(d, j, d1[at], i1[at])
        later = ~first & _before(d, j, d2[at], i2[at])
        a, b = at[first], at[later]
        d2[a], i2[a] = d1[a], i1[a]
        d1[a], i1[a] = d[first], j[first]
        d2[b], i2[b] = d[later], j[later]
    return i1, i2, d1, d2


def assign(x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> int:
    """Brings the four arrays up to date in place; returns how many vectors had to be searched for."""
    upper += c.moved[near]
    lower -= c.others_moved[near]
    least = np.maximum(lower, c.half[near])
    open_ = np.flatnonzero(upper * (1 + 1e-9) + 1e-9 >= least)
    upper[open_] = roots(c.distances(x[open_], near[open_]))
    open_ = open_[upper[open_] * (1 + 1e-9) + 1e-9 >= least[open_]]
    if c.k > 1 and len(open_):
        near[open_], second[open_], d1, d2 = search(x[open_], near[open_], second[open_], c)
        upper[open_], lower[open_] = roots(d1), roots(d2)
    return len(open_)


def _blocks(id_type: pa.DataType, dims: int, scale: float, k: int, seed: str, block: int):
    """Blocks of the vectors that take part, without bounds yet, and each task's ``k`` first starts."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        starts: list[tuple[str, list[int]]] = []

        def row() -> pa.RecordBatch:
            x = np.concatenate(vectors)
            near = np.zeros(len(x), np.int32)
            out = _row(id_type, _BLOCKS, pa.concat_arrays(ids).to_pylist(), stored(x), packed(np.stack([near, near + (k > 1)])),
                       packed(np.stack([np.full(len(x), np.inf), np.zeros(len(x))])))
            ids.clear()
            vectors.clear()
            return out

        for batch in batches:
            lists = column(batch, "v")
            right = pc.equal(pc.list_value_length(lists), dims).fill_null(False)
            kept = lists.filter(right)
            x = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(x * scale)
                whole = (np.abs(x) < 2.0 ** 63).all(axis=1)
            x, own = x[whole].astype(np.int64), column(batch, "id").filter(right).filter(pa.array(whole))
            if len(x):
                ids.append(own)
                vectors.append(x)
                hashes = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in own.to_pylist()]
                limit = starts[-1][0] if len(starts) == k else "~"
                starts = sorted([*starts, *((h, x[i].tolist()) for i, h in enumerate(hashes) if h <= limit)])[:k]
            if sum(map(len, vectors)) >= block:
                yield row()
        if vectors:
            yield row()
        for h, v in starts:
            yield _row(id_type, _STARTS, sums=v, hashed=h)

    return make


def _round(id_type: pa.DataType, dims: int, c: Centroids):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, inertia = [0] * c.k, [np.zeros(dims, object) for _ in range(c.k)], [0] * c.k
        for batch in batches:
            for r in batch.to_pylist():
                x = restored(r["values"], dims)
                near, second = unpacked(r["places"], np.int32).reshape(2, -1).copy()
                upper, lower = unpacked(r["bounds"], np.float64).reshape(2, -1).copy()
                assign(x, near, second, upper, lower, c)
                distance = c.distances(x, near)
                for n in np.unique(near):
                    own = near == n
                    counts[n] += int(own.sum())
                    sums[n] = sums[n] + x[own].sum(axis=0).astype(object)
                    inertia[n] += sum(map(int, distance[own]))
                yield _row(id_type, _BLOCKS, r["ids"], r["values"], packed(np.stack([near, second])), packed(np.stack([upper, lower])))
        for n in range(c.k):
            if counts[n]:
                yield _row(id_type, _SUMS, number=n, count=counts[n], sums=[*map(int, sums[n]), inertia[n]])

    return step


def _added(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(count, sums of the components and of the distances) of each centroid that has vectors: one row each."""
    cells = state.where(F.col("kind") == _SUMS).select("number", "count", F.posexplode("sums").alias("place", "part"))
    found = (cells.groupBy("number", "place").agg(F.sum("count").alias("count"), F.sum("part").alias("part"))
             .groupBy("number").agg(F.max("count").alias("count"), F.sort_array(F.collect_list(F.struct("place", "part"))).alias("sums")))
    return {r["number"]: (r["count"], [int(s["part"]) for s in r["sums"]]) for r in found.collect()}


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: str = SEED,
            id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    read = embeddings.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    id_name = read.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(read.schema["id"].dataType)
    state = stage(read.mapInArrow(_blocks(id_type, dims, scale, k, seed, block), _schema(id_name)), "vectors")
    starts = state.where(F.col("kind") == _STARTS).orderBy("hash", "sums").limit(k).select("sums").collect()
    result = f"vec_id {id_name}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not starts:
        return embeddings.sparkSession.createDataFrame([], result)
    c = Centroids([[int(v) for v in r["sums"]] for r in starts])
    older = None
    for done in range(rounds + 1):
        blocks = state.where(F.col("kind") == _BLOCKS)
        following = stage(blocks.mapInArrow(_round(id_type, dims, c), _schema(id_name)), "vectors")
        if older is not None:
            unstage(older)
        older, state = state, following
        added = _added(state)
        if done < rounds:
            means = [[s // added[n][0] for s in added[n][1][:dims]] if n in added else c.rows[n] for n in range(c.k)]
            c = Centroids(means, c.rows)
    inertia = {n: s[dims] for n, (_, s) in added.items()}
    total = sum(inertia.values())
    if total >= 1 << 63:
        raise ArithmeticError(f"the inertia {total} does not fit a long")
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.rows]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, near = restored(r["values"], dims), unpacked(r["places"], np.int32).reshape(2, -1)[0]
                cells = [pa.array(r["ids"], id_type), pa.array(near), pa.array(c.distances(x, near).tolist(), pa.int64()),
                         pa.array([inertia[n] for n in near.tolist()], pa.int64()), pa.array([total] * len(near), pa.int64()),
                         pa.array([digests[n] for n in near.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(cells, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return state.where(F.col("kind") == _BLOCKS).mapInArrow(rows, result)


def _sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    """The same rounds for DuckDB: all distances of every round."""
    parts = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), cells AS MATERIALIZED (
  SELECT rid, i, v[i] AS x FROM kept, range(1, {dims + 1}) AS r(i)
), c0 AS MATERIALIZED (
  SELECT number, i, v[i] AS x FROM (
    SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS number, v FROM kept), range(1, {dims + 1}) AS r(i)
  WHERE number < {k}
)"""]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (
  SELECT rid, number, sum((a.x - c.x) * (a.x - c.x)) AS d FROM cells a JOIN c{r} c USING (i) GROUP BY rid, number
), n{r} AS MATERIALIZED (
  SELECT rid, min(number) AS number, d FROM d{r} JOIN (SELECT rid, min(d) AS d FROM d{r} GROUP BY rid) USING (rid, d) GROUP BY rid, d
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT number, i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT number, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM cells JOIN n{r} USING (rid) GROUP BY number, i
  ) m USING (number, i)
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, number::INTEGER AS "cluster", d::BIGINT AS distance, (sum(d) OVER (PARTITION BY number))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM n{rounds} JOIN kept USING (rid) JOIN (
  SELECT number, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY number) USING (number)
"""


SQL = _sql()
