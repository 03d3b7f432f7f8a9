"""Operator 12: prefix trie of conversations, by range minima over the common prefixes of the sorted sequences.

A turn is a 128-bit digest of its role and text, a conversation the digests of its turns one after the other. All conversations are sorted by
Spark (ranges of digests, then id, so a group of copies of any size is divided) and gathered into blocks of bounded size. L(i) is
the number of turns that neighbours i - 1 and i have in common. The members of a prefix of row i with d turns are the interval around i
in which no L is below d: two binary searches over a sparse table of minima, to the left and to the right, each on its
own, for all prefixes of a block at once. A prefix is a node where its interval begins.

What a node needs of its subtree are sums over the rows of its interval, so cumulated sums answer it:

* leaves: rows j with L(j + 1) < length of j, the last copy of a sequence that nothing extends;
* saved tokens: of each row but the first the bytes of its first L turns, less those above the node;
* children: nodes whose parent it is, found by the parent's left end.

Only prefixes that two neighbouring blocks have in common reach beyond a block: for each border as many as its L. Their parts (count,
least id, sums, the ids that end there as text) come from all blocks and are added up by Spark; the ids' digest is taken in the order of the blocks,
a part at a time. Blocks then get the least ids of the prefixes at their borders, for the parents of their own nodes.

Turns of a conversation are ordered by turn, nulls first, equal ones by digest; a null role or text is empty. Repeated rows are turns of
their own. Rows without conv_id take no part; a table without any other has no nodes, not even a root. A conversation's digests (16
bytes a turn) and an interval's ids within one block are held by a task; texts are only read once. Columns beside the four named
ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tidesift.operators.staging import stage

from llm.common import column, packed, squeezed, unpacked, unsqueezed

FAMILY, HEADS = 5, 9
TURNS_PER_BLOCK = 100_000
WIDTH = 16  # bytes of a turn's digest
NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
        "saved_tokens bigint, ends_sha256 string")
_NODE = [f.split()[0] for f in NODE.split(", ")]
_HEAD, _TAIL = range(2)
_NOBODY = hashlib.sha256(b"").hexdigest()


# ---- sequences ----------------------------------------------------------------------------------------------------
def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (digest in hex, bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn"), F.substring(F.sha2(whole, 256), 1, 2 * WIDTH).alias("digest"),
                    F.octet_length(text).cast("bigint").alias("size"))
    read = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t")).where("conv_id IS NOT NULL")
    ordered = F.sort_array(F.collect_list("t"))
    return read.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"], t["size"])).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the family's first conversation, then the own ones after the first h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    none = F.array().cast(turns.schema["turns"].dataType)
    heads = turns.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("head"))
    own = turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "family", "left")
    return own.select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def keyed(sequences: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): digests one after the other, and the bytes of each turn's text."""
    def each(name: str) -> Column:
        return F.transform("turns", lambda t: t[name])

    return sequences.select("conv_id", F.unhex(F.array_join(each("digest"), "")).alias("key"), each("size").alias("sizes"))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition as one row."""
    ids, keys, lengths, sizes = [], [], [], []
    for batch in batches:
        ids.append(column(batch, "conv_id").to_numpy())
        keys += column(batch, "key").to_pylist()
        lists = column(batch, "sizes")
        sizes.append(lists.flatten().to_numpy())
        lengths.append(np.array([len(k) // WIDTH for k in keys[len(keys) - len(batch):]], np.int64))
    if keys:
        cells = ([TaskContext.get().partitionId()], [squeezed(np.concatenate(ids))], [b"".join(keys)], [squeezed(np.concatenate(lengths))],
                 [squeezed(np.concatenate(sizes))], [keys[0]], [keys[-1]])
        kinds = (pa.int64(), *[pa.binary()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)],
                                         ["block", "ids", "keys", "lengths", "sizes", "first", "last"])


def common(a: bytes, b: bytes) -> int:
    """Number of turns that two keys begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // WIDTH


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        left = [-1 if r["before"] is None else common(r["before"], r["first"]) for r in rows]
        right = [-1 if r["after"] is None else common(r["last"], r["after"]) for r in rows]
        yield pa.RecordBatch.from_arrays([column(batch, "block"), pa.array(left, pa.int64()), pa.array(right, pa.int64())],
                                         ["block", "left", "right"])


# ---- a block ------------------------------------------------------------------------------------------------------
class RangeMinimum:
    """Sparse table of minima: row k has the minimum of every 2^k neighbours."""

    def __init__(self, values: np.ndarray):
        self.n, self.rows = len(values), [values]
        while 2 << (len(self.rows) - 1) <= self.n:
            half = 1 << (len(self.rows) - 1)
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        k = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for level in np.unique(k):
            own = k == level
            row = self.rows[level]
            out[own] = np.minimum(row[first[own]], row[last[own] - (1 << int(level)) + 1])
        return out

    def right_end(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last place up to which no value after ``start`` is below ``depth``."""
        place = np.array(start)
        for k in range(len(self.rows) - 1, -1, -1):
            inside = place + (1 << k) < self.n
            row = self.rows[k]
            place += (inside & (row[np.minimum(place + 1, len(row) - 1)] >= depth)).astype(place.dtype) << k
        return place

    def left_end(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place after which, up to ``start``, no value is below ``depth``."""
        place = np.array(start)
        for k in range(len(self.rows) - 1, -1, -1):
            inside = place >= 1 << k
            row = self.rows[k]
            place -= (inside & (row[np.clip(place - (1 << k) + 1, 0, len(row) - 1)] >= depth)).astype(place.dtype) << k
        return place


class Block:
    """Sorted conversations ``0 .. n - 1`` between two borders (-1: there is no neighbour)."""

    def __init__(self, row: dict):
        self.left, self.right = row["left"], row["right"]
        self.ids, self.length = unsqueezed(row["ids"], np.int64), unsqueezed(row["lengths"], np.int64)
        self.n = n = len(self.ids)
        self.keys, self.key_at = row["keys"], np.concatenate([[0], np.cumsum(self.length)])
        # Bytes of the first x turns of row i are at bytes_at[i] + x.
        sizes = np.concatenate([[0], np.cumsum(unsqueezed(row["sizes"], np.int64))])
        self.bytes_at = self.key_at[:-1] + np.arange(n)
        owner = np.repeat(np.arange(n), self.length + 1)
        within = np.arange(len(owner)) - self.bytes_at[owner]
        self.bytes_of = sizes[self.key_at[owner] + within] - sizes[self.key_at[owner]]
        self.shared = np.array([self.left, *(common(self.key(i - 1), self.key(i)) for i in range(1, n))], np.int64)
        after = np.append(self.shared[1:], self.right)
        self.minima = RangeMinimum(self.shared)
        self.least_id = RangeMinimum(self.ids)
        self.leaves = np.concatenate([[0], np.cumsum(after < self.length)])
        self.saved = np.concatenate([[0], np.cumsum(self.first_bytes(np.arange(n), self.shared))])
        # The last of each row's copies within the block.
        same = np.append((self.shared[1:] == self.length[1:]) & (self.length[:-1] == self.length[1:]), False)
        ends = np.flatnonzero(~same)
        self.last_copy = ends[np.searchsorted(ends, np.arange(n))]

    def key(self, i: int, depth: int | None = None) -> bytes:
        return self.keys[WIDTH * self.key_at[i]:WIDTH * (self.key_at[i + 1] if depth is None else self.key_at[i] + depth)]

    def first_bytes(self, rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self.bytes_of[self.bytes_at[rows] + np.maximum(depth, 0)]

    def ids_text(self, first: int, last: int) -> bytes:
        return ",".join(map(str, self.ids[first:last + 1].tolist())).encode()

    def shared_prefixes(self) -> list[tuple]:
        """Parts of the prefixes that reach beyond the block, and of the root."""
        found = [(_HEAD, d, 0, int(b)) for d, b in enumerate(self.minima.right_end(
            np.zeros(self.left + 1, np.int64), np.arange(self.left + 1)))]
        found += [(_TAIL, d, int(a), self.n - 1) for d, a in enumerate(self.minima.left_end(
            np.full(self.right + 1, self.n - 1), np.arange(self.right + 1))) if a > 0 or d > self.left]
        out = []
        for side, d, a, b in found or [(_HEAD, 0, 0, self.n - 1)]:
            begins = self.shared[a] < d
            rest = a + begins  # rows but the first of the whole interval
            children = np.count_nonzero((self.shared[rest:b + 1] == d) & (self.length[rest:b + 1] > d)) + (begins and self.length[a] > d)
            above = int(self.first_bytes(np.array([a]), np.array([d - 1]))[0])
            saved = self.saved[b + 1] - self.saved[rest] - (b + 1 - rest) * above
            ended = self.length[a:b + 1] == d
            ids = ",".join(map(str, self.ids[a:b + 1][ended].tolist())).encode() if ended.any() else None
            out.append((side, d, self.name(a, d), self.name(a, d - 1), b + 1 - a, int(self.ids[a:b + 1].min()), int(children),
                        int(self.leaves[b + 1] - self.leaves[a]), int(saved), ids))
        return out

    def name(self, row: int, depth: int) -> bytes | None:
        return None if depth < 0 else hashlib.sha256(self.key(row, depth)).digest()[:WIDTH]

    def nodes(self, least_of: dict[tuple[int, int], int]) -> dict[str, np.ndarray | list]:
        """The nodes of the block alone. ``least_of``: least ids of the prefixes beyond it, by (side, depth)."""
        above = np.maximum(self.shared, 0)
        counts = self.length - above
        begin = np.cumsum(counts) - counts
        row = np.repeat(np.arange(self.n), counts)
        depth = np.arange(len(row)) - begin[row] + above[row] + 1
        last = self.minima.right_end(row, depth)
        own = (last < self.n - 1) | (depth > self.right)
        least = self.least_id.least(row, last)
        # A row's first node hangs on the prefix that it shares with the row before; the others on the one before them.
        parent = np.arange(len(row)) - 1
        first = begin[counts > 0]
        rows = row[first]
        start = self.minima.left_end(rows, above[rows])
        inside = self.shared[start] < above[rows]
        parent[first] = np.where(inside, begin[start] + above[rows] - above[start] - 1, -1)
        parent_least = least[np.maximum(parent, 0)]
        outside = np.flatnonzero((parent < 0) | ~own[np.maximum(parent, 0)])
        parent_least[outside] = [self._beyond(least_of, int(d) - 1, p < 0) for d, p in zip(depth[outside], parent[outside], strict=True)]
        children = np.bincount(parent[parent >= 0], minlength=len(row))
        members = last - row + 1
        saved = self.saved[last + 1] - self.saved[row + 1] - (members - 1) * self.first_bytes(row, depth - 1)
        ends = np.full(len(row), _NOBODY, object)
        for i in np.flatnonzero(own & (depth == self.length[row])):
            ends[i] = hashlib.sha256(self.ids_text(row[i], self.last_copy[row[i]])).hexdigest()
        found = (least, depth, parent_least, members, children, self.leaves[last + 1] - self.leaves[row], saved, ends)
        return {n: v[own] for n, v in zip(_NODE, found, strict=True)}

    @staticmethod
    def _beyond(least_of: dict[tuple[int, int], int], depth: int, at_head: bool) -> int:
        first, other = (_HEAD, _TAIL) if at_head else (_TAIL, _HEAD)
        return least_of.get((first, depth), least_of.get((other, depth)))


_PART = ["block", "side", "depth", "name", "parent", "n_convs", "least", "n_children", "n_leaves", "saved_tokens", "ends"]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.binary())
    for batch in batches:
        for r in batch.to_pylist():
            rows = [(r["block"], *part) for part in Block(r).shared_prefixes()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _PART)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each prefix's ids, whose parts follow each other in order."""
    at, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.binary()),
                                           pa.array([digest.hexdigest()])], ["depth", "name", "ends_sha256"])

    for batch in batches:
        for depth, name, ids in zip(*(column(batch, c).to_pylist() for c in ("depth", "name", "ends")), strict=True):
            if (depth, name) != at:
                if at:
                    yield row()
                at, digest = (depth, name), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids)
    if at:
        yield row()


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.int64()] * 7, pa.string()]
    for batch in batches:
        for r in batch.to_pylist():
            found = Block(r).nodes({(p["side"], p["depth"]): p["least"] for p in r["beyond"]})
            table = pa.table([pa.array(found[n], k) for n, k in zip(_NODE, kinds, strict=True)], _NODE)
            yield from table.to_batches(max_chunksize=20_000)


def trie(sequences: DataFrame, turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """Nodes of (conv_id, turns) sequences, as :func:`turns_of` and :func:`rebuilt` give them; ids must be unique."""
    spark = sequences.sparkSession
    rows = stage(keyed(sequences), "sequences")
    n_turns = rows.agg(F.sum(F.size("sizes"))).first()[0] or 0
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // turns_per_block))
    ordered = rows.repartitionByRange(n_blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = stage(ordered.mapInArrow(_gather, "block bigint, ids binary, keys binary, lengths binary, sizes binary, first binary, "
                                               "last binary"), "blocks")
    order = Window.orderBy("block")  # a row per block
    neighbours = blocks.select("block", "first", "last").select(
        "*", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    borders = stage(neighbours.mapInArrow(_borders, "block bigint, left bigint, right bigint"), "borders")
    bordered = blocks.drop("first", "last").join(borders, "block")

    parts = stage(bordered.mapInArrow(_parts, "block bigint, side int, depth bigint, name binary, parent binary, n_convs bigint, "
                                              "least bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary"), "parts")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    wide = stage(parts.groupBy("depth", "name").agg(F.min("least").alias("conv_id"), F.min("parent").alias("parent"), *sums), "wide")
    ends = (parts.where("ends IS NOT NULL").select("depth", "name", "block", "ends").repartition("depth", "name")
            .sortWithinPartitions("depth", "name", "block").mapInArrow(_ends, "depth bigint, name binary, ends_sha256 string"))
    parents = wide.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    wide_nodes = wide.join(parents, ["depth", "parent"], "left").join(ends, ["depth", "name"], "left").select(
        *[F.coalesce(c, F.lit(_NOBODY)).alias(c) if c == "ends_sha256" else c for c in _NODE])

    beyond = parts.select("block", "side", "depth", "name").join(wide.select("depth", "name", F.col("conv_id").alias("least")), ["depth", "name"])
    beyond = beyond.groupBy("block").agg(F.collect_list(F.struct("side", "depth", "least")).alias("beyond"))
    return bordered.join(beyond, "block").mapInArrow(_nodes, NODE).unionByName(wide_nodes)


def prefix_trie(conversations: DataFrame, turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: the columns of ``NODE``."""
    return trie(rebuilt(turns_of(conversations)), turns_per_block)


# The same nodes for DuckDB, whose prefixes are lists of turns; crc32 is worked out bit by bit.
SQL = """
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS x,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(x ORDER BY turn NULLS FIRST, digest) AS l,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM turns GROUP BY conv_id
), seq AS (
  SELECT a.conv_id, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS l FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), prefixes AS (
  SELECT conv_id, len(l) AS n, d, l[1:d] AS p FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM seq)
), nodes AS MATERIALIZED (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d
), children AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), valued AS MATERIALIZED (
  SELECT p, d, coalesce(n_children, 0) AS n_children,
         CASE WHEN d > 0 THEN (n_convs - 1) * strlen(p[d].text) ELSE 0 END AS saved FROM nodes LEFT JOIN children USING (p)
), below AS (
  SELECT p[1:a] AS p, sum((n_children = 0)::INTEGER) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM valued) GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN valued USING (p, d) JOIN below USING (p) LEFT JOIN nodes up ON n.d > 0 AND up.p = n.p[1:n.d - 1] AND up.d = n.d - 1
"""
