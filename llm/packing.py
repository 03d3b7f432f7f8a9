"""Operator 8: bounded-space online packing of token sequences.

Every partition keeps ``open_windows`` windows of ``capacity`` tokens. Whole windows are cut off a document first; its rest goes to
the open window it fits best. When it fits none, a new window opens if there is room for one; else the fullest window is
topped up from the rest and emitted. What is open at the end of a partition is merged afterwards: neighbouring
partitions' windows pass through the same packer, in rounds of ``FAN_IN`` partitions to a task, so no task sees more than
``FAN_IN * open_windows`` windows. The last round closes: its remaining pieces fill windows in order, and the tail is cut
into powers of two, which need no padding. All padding of a run is therefore zero.

A null text counts as empty: its only token is the end id. Ids of any type, null or repeated are carried along, each row
packed on its own. A very long text is encoded as a whole and cut into whole windows. An empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tidesift.operators.staging import stage

from llm import bpe
from llm.common import byte_texts, column

CAPACITY, OPEN_WINDOWS, FAN_IN, END_ID = 1024, 16, 64, 0
_PER_LEVEL, _PER_TASK = 1 << 58, 1 << 32


def encode(vocabulary: bpe.ByteBpe, text: str, end_id: int | None = END_ID) -> np.ndarray:
    """Ids of a text as the library gives them, then the end id."""
    ids = vocabulary.fast_ids(text) if bpe.is_settled(text) else None
    if ids is None:
        ids = np.array(vocabulary.library.encode(text, add_special_tokens=False).ids, "<u4")
    return ids if end_id is None else np.append(ids, np.uint32(end_id)).astype("<u4")


class Packer:
    """Places pieces ``(document, start, ids, doc_tokens)``; ``rows`` gathers those of emitted sequences."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS):
        self.capacity, self.limit = capacity, open_windows
        self.windows: list[list] = []  # [free, pieces]
        self.next_id = first_id
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for document, start, ids, total in pieces:
            self.rows.append((document, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, document, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.capacity:
            self.emit([(document, start, ids[:self.capacity], total)])
            start, ids = start + self.capacity, ids[self.capacity:]
        while len(ids):
            n = len(ids)
            fitting = [w for w in self.windows if w[0] >= n]
            if fitting:
                best = min(fitting, key=lambda w: w[0])
                best[0] -= n
                best[1].append((document, start, ids, total))
                if not best[0]:
                    self.windows.remove(best)
                    self.emit(best[1])
                return
            if len(self.windows) < self.limit:
                self.windows.append([self.capacity - n, [(document, start, ids, total)]])
                return
            fullest = min(self.windows, key=lambda w: w[0])
            self.windows.remove(fullest)
            cut = fullest[0]
            self.emit([*fullest[1], (document, start, ids[:cut], total)])
            start, ids = start + cut, ids[cut:]

    def close(self) -> None:
        """Emit what is open: full windows, then powers of two."""
        pieces = [p for w in sorted(self.windows, key=lambda w: w[0]) for p in w[1]]
        left = sum(len(p[2]) for p in pieces)
        self.windows = []
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                document, start, ids, total = pieces[0]
                taken.append((document, start, ids[:room], total))
                if len(ids) > room:
                    pieces[0] = (document, start + room, ids[room:], total)
                else:
                    pieces.pop(0)
                room -= len(taken[-1][2])
            self.emit(taken)


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                      ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                      ("part", pa.int64()), ("ids", pa.binary())])


def _emitted(packer: Packer, schema: pa.Schema) -> pa.RecordBatch:
    cells = list(zip(*packer.rows, strict=True)) or [()] * 7
    n = len(packer.rows)
    packer.rows = []
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, f.type) for c, f in zip(cells, schema, strict=False)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
        schema=schema)


def _open(packer: Packer, part: int, schema: pa.Schema) -> pa.RecordBatch:
    pieces = [p for w in packer.windows for p in w[1]]
    columns = [[p[0] for p in pieces], [p[1] for p in pieces], [len(p[2]) for p in pieces], [None] * len(pieces),
               [p[3] for p in pieces], [None] * len(pieces), [None] * len(pieces), [part] * len(pieces),
               [p[2].tobytes() for p in pieces]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    read = documents.select(documents[id_column].alias("doc_id"), documents[text_column].cast("string").alias("text"))
    id_type = read.schema["doc_id"].dataType.simpleString()
    ddl = (f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
           "offset bigint, part bigint, ids binary")

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, part, schema = bpe.load(path), TaskContext.get().partitionId(), None
        packer = Packer(part * _PER_TASK, capacity, open_windows)
        for batch in batches:
            schema = schema or _schema(column(batch, "doc_id").type)
            for document, data in zip(column(batch, "doc_id").to_pylist(), byte_texts(column(batch, "text")), strict=True):
                ids = encode(vocabulary, (data or b"").decode("utf-8", "replace"))
                packer.add(document, 0, ids, len(ids))
            yield _emitted(packer, schema)
        if packer.windows:
            yield _open(packer, part, schema)

    done, level = [], 0
    placed = stage(read.mapInArrow(pack_partition, ddl), "packed")
    while True:
        done.append(placed.where("ids is null"))
        level += 1
        left = placed.where("ids is not null")
        last = left.agg(F.max("part")).first()[0]
        if last is None:
            break
        closing = last < FAN_IN
        merge = _merger(level, closing, capacity, open_windows)
        placed = stage(left.groupBy(F.expr(f"part div {FAN_IN}").alias("task")).applyInArrow(merge, ddl), "packed")
    return reduce(DataFrame.unionByName, done).drop("part", "ids")


def _merger(level: int, closing: bool, capacity: int, open_windows: int):
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        task = key[0].as_py()
        # Rows come in any order after a shuffle; sorted, a retried task repeats its result.
        keys = sorted(zip(rows["part"].to_pylist(), map(str, rows["doc_id"].to_pylist()), rows["start"].to_pylist(),
                          rows["ids"].to_pylist(), range(rows.num_rows), strict=True))
        documents, totals = rows["doc_id"].to_pylist(), rows["doc_tokens"].to_pylist()
        packer = Packer(level * _PER_LEVEL + task * _PER_TASK, capacity, open_windows)
        for _, _, start, ids, i in keys:
            packer.add(documents[i], start, np.frombuffer(ids, "<u4"), totals[i])
        if closing:
            packer.close()
        schema = _schema(rows.schema.field("doc_id").type)
        batches = [_emitted(packer, schema)]
        if packer.windows:
            batches.append(_open(packer, task, schema))
        return pa.Table.from_batches(batches, schema)

    return merge
