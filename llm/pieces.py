"""Operator 2: SentencePiece models on the ``tokenizers`` library.

The model file's protobuf is read field by field; from it come the normaliser, the meta-space marker, the scores (unigram) or
merges (BPE) and the byte fallback, rebuilt as a ``tokenizers`` pipeline. Where no piece continues past a white-space marker,
texts fall into independent segments; a worker keeps the ids of frequent segments and hands new ones to the library in
multithreaded batches. With ``verify`` every new segment's ids and decoded text are held against the ``sentencepiece`` library;
a text of verified segments is verified, since no piece crosses their borders (other models are compared text by text). A unigram
model's best two ways can differ by less than the other library's single-precision sums tell apart; such texts are not verified.

Null and empty texts have no ids and decode to the empty text. Models with user-defined pieces, suffix markers or case
encoding are refused with an error instead of being encoded differently. Repeated rows and null ids are passed
through; columns beside the named ones are not read. An empty table gives no rows. A very long text is encoded segment by segment; one long
segment is handed to the library as it is.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from llm.common import byte_texts, column

MARK = "▁"
# Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2
KEPT_SEGMENTS = 700_000  # per generation of the cache; results do not depend on it
LONGEST_KEPT = 64
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and raw value of each field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size, at = _varint(data, at)
            if size is None or at + size > len(data):
                raise ValueError("not a protobuf message")
            value, at = data[at:at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What the encoder needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece[1].decode("utf-8"), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            if trainer.get(24, 0):
                raise ValueError("white space as a suffix is not supported")
        elif number == 3:
            rules = dict(fields(value))
            model.charsmap = rules.get(2, b"")
            model.dummy_prefix, model.trim_spaces, model.escape_spaces = (bool(rules.get(k, 1)) for k in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE) or any(kind == USER_DEFINED for *_, kind in model.pieces):
        raise ValueError("only unigram and BPE models without user-defined pieces are supported")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Merges by falling score of what they make: every way to make a piece of two others."""
    rank = {piece: (-score, i) for i, (piece, score, kind) in enumerate(model.pieces) if kind == NORMAL}
    found = []
    for piece, place in rank.items():
        parts = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in rank and piece[k:] in rank]
        found += [(place, rank[a], rank[b], (a, b)) for a, b in parts]
    return [pair for *_, pair in sorted(found)]


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, threads: int = THREADS, kept: int = KEPT_SEGMENTS, verify: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.path, self.kept = path, kept
        unknown = next(i for i, (*_, kind) in enumerate(self.model.pieces) if kind == UNKNOWN)
        vocab = {piece: i for i, (piece, *_) in enumerate(self.model.pieces)}
        if self.model.kind == BPE:
            core = models.BPE(vocab=vocab, merges=_merges(self.model), unk_token=self.model.pieces[unknown][0], fuse_unk=True,
                              byte_fallback=self.model.byte_fallback)
        else:
            core = models.Unigram([(p, s) for p, s, _ in self.model.pieces], unknown, self.model.byte_fallback)
        self.library = Tokenizer(core)
        steps = [normalizers.Precompiled(self.model.charsmap)] if self.model.charsmap else []
        if self.model.trim_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.model.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.model.escape_spaces else " "))
        if self.model.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        self.normalizer = normalizers.Sequence(steps)
        texts = [p for p, _, kind in self.model.pieces if kind == NORMAL]
        self.independent = all(MARK not in p.lstrip(MARK) for p in texts)
        if self.independent:
            self.library.pre_tokenizer = pre_tokenizers.Split(Regex(_SEGMENT.pattern), "isolated")
        rest = [decoders.Strip(" ", 1, 0)] if self.model.dummy_prefix else []
        self.library.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *rest])
        self.segments: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.failed: set[str] = set()  # segments, or whole texts of one call, on which the libraries differ
        # Texts come back as they were: nothing is trimmed or mapped, every character has a piece or bytes.
        self.lossless = not (self.model.charsmap or self.model.trim_spaces) and self.model.dummy_prefix and self.model.byte_fallback
        self.original = sentencepiece.SentencePieceProcessor(model_file=path) if verify else None

    def normalise(self, text: str) -> str:
        if self.model.charsmap or self.model.trim_spaces or not self.model.escape_spaces:
            return self.normalizer.normalize_str(text)
        return (MARK if self.model.dummy_prefix and text else "") + text.replace(" ", MARK)

    def _ids(self, normalised: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(normalised, add_special_tokens=False)]

    def _compare(self, names: list[str], texts: list[str], ids: list[list[int]], lead: list[int] = ()) -> None:
        """Note the names for which the other library gives other ids (after ``lead``), or whose ids do not decode to the text."""
        want = self.original.encode(texts, num_threads=1)
        for name, ours, theirs, decoded, text in zip(names, ids, want, self._decoded(want), texts, strict=True):
            if [*lead, *ours] != theirs or decoded != (text if self.lossless else self.original.decode(theirs)):
                self.failed.add(name)

    def _verify(self, segments: list[str], ids: list[list[int]]) -> None:
        """Compare segments: one that begins with markers as it stands after another word, one without by itself."""
        lead = self.original.encode("a")
        for marked in (True, False):
            some = [i for i, s in enumerate(segments) if s.startswith(MARK) == marked]
            if some:
                texts = ["a" * marked + segments[i].replace(MARK, " ") for i in some]
                self._compare([segments[i] for i in some], texts, [ids[i] for i in some], lead * marked)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        whole = [self.normalise(t) for t in texts]
        if not self.independent:
            ids = self._ids(whole)
            self.failed.clear()
            if self.original:
                self._compare(texts, texts, ids)
            return [np.array(i, "<u4") for i in ids]
        if len(self.segments) > self.kept:
            self.older, self.segments = self.segments, {}
        split = [_SEGMENT.findall(t) for t in whole]
        known, older, new = self.segments, self.older, []
        for s in set().union(*split):
            if s not in known:
                if s in older:
                    known[s] = older[s]
                else:
                    new.append(s)
        ids = self._ids(new)
        if self.original:
            self._verify(new, ids)
        self.segments.update(zip(new, (array("I", i).tobytes() for i in ids), strict=True))
        found = [np.frombuffer(b"".join(map(self.segments.__getitem__, segments)), "<u4") for segments in split]
        for s in new:
            if len(s) > LONGEST_KEPT:
                del self.segments[s]
        return found

    def agrees(self, text: str) -> bool:
        """Whether all of a text that ``encode`` has just seen was encoded and decoded as by the other library."""
        return not self.failed or (
            self.failed.isdisjoint(_SEGMENT.findall(self.normalise(text))) if self.independent else text not in self.failed)

    def _decoded(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode_batch(ids, skip_special_tokens=False)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self._decoded([i.tolist() for i in ids])


_encoders: dict[tuple[str, bool], Pieces] = {}


def encoder(path: str, verify: bool = False) -> Pieces:
    """The worker's encoder of one file, kept between tasks."""
    if (path, verify) not in _encoders:
        _encoders[path, verify] = Pieces(path, verify=verify)
    return _encoders[path, verify]


def _batches(batch: pa.RecordBatch, name: str, step: int = 128) -> Iterator[list[str]]:
    texts = byte_texts(column(batch, name))
    for at in range(0, len(texts), step):
        yield [(t or b"").decode("utf-8", "replace") for t in texts[at:at + step]]


def encode_table(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids) of every text."""
    read = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        for batch in batches:
            ids = [i.astype(np.int32) for texts in _batches(batch, "text") for i in pieces.encode(texts)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return read.mapInArrow(encode, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_table(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        for batch in batches:
            texts = pieces.decode([np.array(i or (), np.uint32) for i in column(batch, "ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    read = encoded.select("doc_id", "ids")
    return read.mapInArrow(decode, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, text string")


def encoding_digest(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pieces, n_byte_pieces, ids_crc32 (of little-endian 32-bit ids), verified."""
    read = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path, verify=True)
        byte_ids = np.array([kind == BYTE for *_, kind in pieces.model.pieces])
        for batch in batches:
            out = []
            for texts in _batches(batch, "text"):
                for text, ids in zip(texts, pieces.encode(texts), strict=True):
                    out.append((len(ids), int(byte_ids[ids].sum()), zlib.crc32(ids.tobytes()), pieces.agrees(text)))
            cells = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))],
                                             ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "verified"])

    id_type = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(digest, f"doc_id {id_type}, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, verified boolean")
