"""Operator 1: removal of passages that occur more than once, by Rabin-Karp hashes of all word windows.

A window is ``WINDOW`` consecutive words of one document; its hash is the rolling polynomial of its words' 64-bit hashes. Every
window of every text is counted:

1. A task gathers documents into chunks of bounded size. A hash that occurs twice within a chunk is known to be repeated there
   and leaves the chunk once; every other hash leaves with its place. Hashes travel in arrays, a row for each chunk and hash bucket.
2. A bucket's task compares the chunks' hashes and answers each chunk with the places whose window is repeated.
3. A chunk's places become maximal removal intervals of words, per document.

Intervals are keyed by the SHA-256 of the whole text: copies share them, and no row number has to be stable. Because a
chunk sends each hash once, a window that a third of all documents share costs one entry per chunk.
Windows are told apart by 64 bits, so of n windows one is taken for repeated by chance with probability n / 2^64.

Null, empty and short texts have no window and lose nothing. Windows are judged on the input; the first of equal windows
goes like the others. An exact copy of a document of ``WINDOW`` words or more therefore leaves none of both. Repeated rows
count as copies. Ids may be null or repeated; columns beside the named ones pass through, whatever their names. An empty table gives no
rows. A very long text is one chunk, worked on in time in proportion to its length. The number of buckets follows the bytes of the texts, so
that a bucket's task holds as much of a large corpus as of a small one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidesift.operators.staging import stage

from llm.common import buckets_for, byte_texts, column, joined, mixed, packed, unpacked, word_hashes, words

WINDOW = 35
CHUNK_WORDS = 3_000_000
BUCKETS_PER_PARTITION, BYTES_PER_BUCKET = 2, 8 << 20  # a bucket's hashes take about twice the room of its share of the texts
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SINGLE, _SEVERAL, _DIRECTORY, _ANSWER = range(4)
_SENT = "bucket bigint, chunk bigint, kind int, a binary, b binary"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Rolling:
    """Hashes of all windows of ``size`` words, by prefix sums modulo 2^64: sum of word * base^-place, scaled back."""

    def __init__(self, size: int):
        self.size = size
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            ones = np.ones(n, np.uint64)
            ones[1:] = _BASE
            self.up = np.multiply.accumulate(ones)
            ones[1:] = self.inverse
            self.down = np.multiply.accumulate(ones)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        if n < self.size:
            return np.empty(0, np.uint64)
        self._powers(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * self.down[:n])])
        return mixed((sums[self.size:] - sums[:-self.size]) * self.up[self.size - 1:n])


def encode_places(places: np.ndarray) -> bytes:
    """Ascending numbers as steps of a byte each, 255 meaning 'and more'."""
    steps = np.diff(places, prepend=0)
    ends = np.cumsum(steps // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = steps % 255
    return out.tobytes()


def decode_places(data: bytes) -> np.ndarray:
    steps = unpacked(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _chunks(window: int, buckets: int, chunk_words: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, part = Rolling(window), TaskContext.get().partitionId()
        hashes: list[np.ndarray] = []
        digests: list[bytes] = []
        gathered = number = 0

        def rows() -> pa.RecordBatch:
            chunk = part << 32 | number
            found, ends = np.concatenate(hashes), np.cumsum([len(h) for h in hashes])
            order = np.argsort(found, kind="stable")
            ordered = found[order]
            equal = ordered[1:] == ordered[:-1]
            repeated = np.zeros(len(found), bool)
            repeated[order[1:][equal]] = repeated[order[:-1][equal]] = True
            several = np.unique(found[repeated])
            out = [(chunk % buckets, chunk, _DIRECTORY, packed(ends.astype(np.int64)) + b"".join(digests),
                    encode_places(np.flatnonzero(repeated)))]
            places = np.flatnonzero(~repeated)
            single = found[places]
            bucket = _bucket(single, buckets)
            order = np.argsort(bucket, kind="stable")  # places stay ascending within a bucket
            cuts = np.searchsorted(bucket[order], np.arange(1, buckets))
            several_cuts = np.searchsorted(_bucket(several, buckets), np.arange(1, buckets))
            for b, (chosen, more) in enumerate(zip(np.split(order, cuts), np.split(several, several_cuts), strict=True)):
                if len(chosen):
                    out.append((b, chunk, _SINGLE, packed(single[chosen]), encode_places(places[chosen])))
                if len(more):
                    out.append((b, chunk, _SEVERAL, packed(more), b""))
            hashes.clear()
            digests.clear()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                              ["bucket", "chunk", "kind", "a", "b"])

        for batch in batches:
            for text in byte_texts(column(batch, "text")):
                tokens = words(text)
                if len(tokens) >= window:
                    hashes.append(rolling(word_hashes(tokens, len(tokens))))
                    digests.append(hashlib.sha256(text).digest())
                    gathered += len(tokens)
                if gathered >= chunk_words:
                    yield rows()
                    gathered, number = 0, number + 1
        if hashes:
            yield rows()

    return send


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)


def _compare(key: tuple, rows: pa.Table) -> pa.Table:
    """What a bucket's chunks have in common: places of repeated windows by chunk; directories pass."""
    del key
    kinds, chunks = np.array(rows["kind"].to_pylist()), rows["chunk"].to_pylist()
    a, b = rows["a"].to_pylist(), rows["b"].to_pylist()
    out = [(chunks[i], _DIRECTORY, a[i], b[i]) for i in np.flatnonzero(kinds == _DIRECTORY)]
    single = np.flatnonzero(kinds == _SINGLE)
    if len(single):
        found = joined([a[i] for i in single], np.uint64)
        several = np.unique(joined([a[i] for i in np.flatnonzero(kinds == _SEVERAL)], np.uint64))
        ordered = np.sort(found)
        known = np.union1d(ordered[1:][ordered[1:] == ordered[:-1]], several)
        if len(known):
            hit = known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found
            ends = np.cumsum([len(a[i]) // 8 for i in single])
            for i, mask in zip(single, np.split(hit, ends[:-1]), strict=True):
                if mask.any():
                    out.append((chunks[i], _ANSWER, encode_places(decode_places(b[i])[mask]), b""))
    kinds_of = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    cells = list(zip(*out, strict=True)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cells, kinds_of, strict=True)], ["chunk", "kind", "a", "b"])


def _merge(window: int):
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        """A chunk's repeated windows as intervals of words: (digest, [start, end, start, end, ...])."""
        del key
        kinds, a, b = rows["kind"].to_pylist(), rows["a"].to_pylist(), rows["b"].to_pylist()
        directory = kinds.index(_DIRECTORY)
        n = len(a[directory]) // 40  # 8 bytes of an end, 32 of a digest
        ends = unpacked(a[directory][:8 * n], np.int64)
        repeated = np.zeros(ends[-1], bool)
        repeated[decode_places(b[directory])] = True
        for i, kind in enumerate(kinds):
            if kind == _ANSWER:
                repeated[decode_places(a[i])] = True
        places = np.flatnonzero(repeated)
        owner = np.searchsorted(ends, places, side="right")
        start = places - np.concatenate([[0], ends])[owner]
        digests, spans = [], []
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for who, own in zip(owner[np.concatenate([[0], cuts])] if len(owner) else (), np.split(start, cuts), strict=False):
            opens = np.concatenate([[True], np.diff(own) > window])
            closes = np.concatenate([opens[1:], [True]])
            digests.append(a[directory][8 * n + 32 * who:8 * n + 32 * who + 32])
            spans.append(np.column_stack([own[opens], own[closes] + window]).ravel())
        return pa.table({"digest": pa.array(digests, pa.binary()), "spans": pa.array(spans, pa.list_(pa.int64()))})

    return merge


def repeated_spans(documents: DataFrame, window: int = WINDOW, text_column: str = "text",
                   chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(digest, spans): for each text with repeated windows, by SHA-256, its maximal removal intervals of word places."""
    texts = documents.select(F.col(text_column).cast("string").alias("text"))
    buckets = buckets_for(texts, BUCKETS_PER_PARTITION, BYTES_PER_BUCKET)
    sent = texts.mapInArrow(_chunks(window, buckets, chunk_words), _SENT)
    answered = sent.groupBy("bucket").applyInArrow(_compare, "chunk bigint, kind int, a binary, b binary")
    spans = answered.groupBy("chunk").applyInArrow(_merge(window), "digest binary, spans array<bigint>")
    return stage(spans.groupBy("digest").agg(F.first("spans").alias("spans")), "spans")


def _with_spans(documents: DataFrame, text_column: str, window: int) -> DataFrame:
    spans = repeated_spans(documents, window, text_column)
    digest = F.unhex(F.sha2(F.col(text_column).cast("string").cast("binary"), 256))
    return documents.withColumn("digest", digest).join(spans, "digest", "left").drop("digest")


def kept_words(tokens: list[bytes], spans: list[int] | None) -> list[bytes]:
    if not spans:
        return tokens
    kept, at = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        kept += tokens[at:start]
        at = end
    return kept + tokens[at:]


def removal_digest(documents: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    read = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    id_type = read.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(byte_texts(column(batch, "text")), column(batch, "spans").to_pylist(), strict=True):
                tokens = words(text)
                kept = kept_words(tokens, spans)
                out.append((len(tokens), len(tokens) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cells = list(zip(*out, strict=True)) or [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(read, "text", window).mapInArrow(
        digest, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string")


def without_spans(text: bytes, spans: list[int] | None) -> bytes:
    """The text without the words of the intervals and the space between them; what stays is as it was."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        kept.append(text[at:places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]]).strip()


def remove_repeats(documents: DataFrame, window: int = WINDOW, text_column: str = "text",
                   length_column: str | None = "n_chars") -> DataFrame:
    """All documents and columns, texts without repeated passages (empty where nothing else was in them).

    ``length_column``, if the table has it, becomes the length of the new text in code points where the text has changed.
    """
    names = [f"c{i}" for i in range(len(documents.columns))]
    text = names[documents.columns.index(text_column)]
    length = names[documents.columns.index(length_column)] if length_column in documents.columns else None
    plain = documents.toDF(*names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = byte_texts(column(batch, text)), column(batch, "spans").to_pylist()
            new = [t if t is None else without_spans(t, s).decode("utf-8", "replace") for t, s in zip(texts, spans, strict=True)]
            columns = [column(batch, n) for n in names]
            columns[names.index(text)] = pa.array(new, pa.string())
            lengths = pa.array([len(n) if s else None for n, s in zip(new, spans, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, lengths], [*names, "new_length"])

    typed = plain.withColumn(text, F.col(text).cast("string"))
    kept = _with_spans(typed, text, window).mapInArrow(cut, T.StructType([*typed.schema.fields, T.StructField("new_length", T.LongType())]))
    if length is not None:
        kept = kept.withColumn(length, F.coalesce(F.col("new_length").cast(typed.schema[length].dataType), F.col(length)))
    return kept.drop("new_length").toDF(*documents.columns)


# The same for DuckDB: windows as texts, counted over the table.
SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT d, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
), gone AS MATERIALIZED (
  SELECT DISTINCT d, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1) USING (g)
), kept AS (
  SELECT d, string_agg(word, ' ' ORDER BY p) AS words, count(*) AS n
  FROM (SELECT d, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs) ANTI JOIN gone USING (d, p) GROUP BY d
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (d)
"""
