"""Operator 9: Katz backoff bigram model with Good-Turing discounts, counted and evaluated over the whole corpus.

A token is a word or the end of a text; its context is the word before it or the start. With c counts of the training texts:

* P(v) = d1(c(v)) c(v) / N for known words; what the discounts leave is the probability of an unknown word.
* P(v | u) = d2(c(u, v)) c(u, v) / c(u) where the pair is known, else alpha(u) P(v); alpha(u) is what the discounts leave of u's pairs,
  divided by what P leaves of the words not seen after u, so every context sums to 1. An unknown context has alpha 1.
* d(r) is Katz's Good-Turing discount for r up to ``CUTOFF`` from the counts of counts, 1 above it and where those are unusable.
  Should nothing be left to the unseen (no discounted pair in a context), one count is added to the context's total for them.

Nothing is broadcast that grows with the corpus. A task turns its documents into chunks: a dictionary of word hashes, and the texts
as places in it. Chunks ask for the counts of their words, and then of their pairs: requests are shuffled to a table part by
hash (of the word; of the context), where all chunks' training counts are added up and each chunk is answered. The answers are
written as tables, partitioned by chunk and part, and joined to the chunks, which score their texts token by token.
Contexts that hold more than their share of all tokens are divided by the following word, and their sums combined.

Words are 64-bit hashes (48 bits for a pair's second word, beside the 64 of its first). Null and empty texts have one token, the end.
A row with a null id is neither held out nor learned from. Repeated rows count as often as they occur. Without any training
text every count is 0, base_score is that of 0 counts and score that of an unknown word throughout. Columns beside the
named ones are not read; an empty table gives no rows. A very long text is one chunk. The number of table parts follows the bytes of the
texts, so that a part's task holds as much of a large corpus as of a small one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tidesift.operators.staging import stage

from llm.common import buckets_for, byte_texts, column, fold_of, mixed, packed, squeezed, unpacked, unsqueezed, word_hashes, words

END, START = np.uint64(0x0E6D0E6D0E6D0E6D), np.uint64(0x57A7057A7057A705)
CHUNK_WORDS = 2_000_000  # what a task holds of its texts at a time
ROUNDS = 2  # shares of the table parts asked one after the other, so that only one share of the requests is on disk
PARTS_PER_PARTITION, BYTES_PER_PART = 2, 8 << 20  # table parts by shuffle partitions, and by bytes of the texts
CUTOFF = 5
FOLDS = 10
HOT_PER_PART = 64
_ANSWERS = "chunk bigint, kind int, part bigint, a binary, b binary, c binary, d binary"
_FIELDS = ["chunk", "kind", "part", "a", "b", "c", "d"]
_WORDS, _PAIRS, _STATISTICS, _HOT = range(4)
HELD_OUT, LEARNED, UNNAMED = range(3)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Table part of a hash, ascending with it."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def short(hashes: np.ndarray) -> bytes:
    """48 bits of each hash."""
    return packed(hashes.view(np.uint8).reshape(-1, 8)[:, :6])


def unshort(data: bytes) -> np.ndarray:
    raw = unpacked(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


def discounts(of_counts: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    """d(0..cutoff) from the numbers of items that occur 1, 2, ... cutoff + 1 times; d(0) is unused."""
    n = np.concatenate([[0.0], np.asarray(of_counts, np.float64)])
    found = np.ones(cutoff + 1)
    if n[1] == 0 or (above := (cutoff + 1) * n[cutoff + 1] / n[1]) >= 1:
        return found
    for r in range(1, cutoff + 1):
        if n[r] > 0:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - above) / (1 - above)
            if 0 < d < 1:
                found[r] = d
    return found


class Unigrams:
    """P of words from the counts of counts; a context's total is its count, or one more if discounts leave nothing."""

    def __init__(self, n_tokens: int, n_words: int, of_counts: np.ndarray):
        self.n_tokens, self.n_words = n_tokens, n_words
        self.discount = discounts(of_counts)
        kept = n_tokens - sum((1 - self.discount[r]) * r * of_counts[r - 1] for r in range(1, CUTOFF + 1))
        self.total = float(n_tokens) if kept < n_tokens - 1e-9 else n_tokens + 1.0
        self.unknown = 1 - kept / self.total

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        d = self.discount[np.minimum(counts, CUTOFF)]
        d = np.where(counts > CUTOFF, 1.0, d)
        return np.where(counts > 0, d * counts / self.total, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n_tokens + 0.1 * (self.n_words + 1)))


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    cells = list(zip(*rows, strict=True)) or [()] * 7
    return pa.table([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], _FIELDS)


def _chunked(documents: DataFrame, id_column: str, text_column: str, chunk_words: int) -> DataFrame:
    """One row per chunk: its documents, their numbers of tokens, the dictionary with training counts, the texts as places in it."""
    fold = fold_of(id_column, FOLDS)
    role = F.when(fold.isNull(), UNNAMED).when(fold == 0, HELD_OUT).otherwise(LEARNED)
    read = documents.select(F.col(id_column).alias("doc_id"), role.cast("int").alias("role"), F.col(text_column).cast("string").alias("text"))
    id_type = read.schema["doc_id"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        roles: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        part, number, gathered = TaskContext.get().partitionId(), 0, 0

        def row() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            dictionary, places = np.unique(np.concatenate(texts), return_inverse=True)
            role_of = np.concatenate(roles)
            learned = np.repeat(role_of == LEARNED, lengths)
            counts = np.bincount(places[learned], minlength=len(dictionary)).astype(np.uint64)
            names = pa.concat_arrays(ids)
            cells = [pa.array([part << 32 | number]), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                     *(pa.array([b], pa.binary()) for b in (packed(role_of.astype(np.uint8)), packed(lengths), packed(dictionary),
                                                            squeezed(counts), squeezed(places.astype(np.uint32))))]
            for kept in (ids, roles, texts):
                kept.clear()
            return pa.RecordBatch.from_arrays(cells, ["chunk", "ids", "roles", "lengths", "dictionary", "counts", "places"])

        for batch in batches:
            data = byte_texts(column(batch, "text"))
            at = 0
            for i, text in enumerate(data):
                tokens = words(text.lower()) if text else []
                texts.append(np.concatenate([[START], word_hashes(tokens, len(tokens)), [END]]))
                gathered += len(tokens) + 2
                if gathered >= chunk_words:
                    ids.append(column(batch, "doc_id").slice(at, i + 1 - at))
                    roles.append(column(batch, "role").to_numpy()[at:i + 1])
                    yield row()
                    at, gathered, number = i + 1, 0, number + 1
            if at < len(data):
                ids.append(column(batch, "doc_id").slice(at))
                roles.append(column(batch, "role").to_numpy()[at:])
        if texts:
            yield row()

    return read.mapInArrow(chunks, f"chunk bigint, ids array<{id_type}>, roles binary, lengths binary, dictionary binary, "
                                   "counts binary, places binary")


# ---- words --------------------------------------------------------------------------------------------------------
def _ask_words(parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dictionary, counts = unpacked(row["dictionary"], np.uint64), unsqueezed(row["counts"], np.uint64)
                cuts = np.searchsorted(part_of(dictionary, parts), np.arange(1, parts))
                asked = [(row["chunk"], _WORDS, p, packed(d), squeezed(c), None, None)
                         for p, (d, c) in enumerate(zip(np.split(dictionary, cuts), np.split(counts, cuts), strict=True)) if len(d)]
                yield from _table(asked).to_batches()

    return ask


def _answer_words(key: tuple, rows: pa.Table) -> pa.Table:
    part, chunks = key[0].as_py(), rows["chunk"].to_pylist()
    asked = [unpacked(b, np.uint64) for b in rows["a"].to_pylist()]
    counts = np.concatenate([unsqueezed(b, np.uint64) for b in rows["b"].to_pylist()])
    distinct, index = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(index, weights=counts.astype(np.float64), minlength=len(distinct)).astype(np.uint64)
    answers = np.split(total[index], np.cumsum([len(a) for a in asked])[:-1])
    out = [(chunk, _WORDS, part, squeezed(a), None, None, None) for chunk, a in zip(chunks, answers, strict=True)]
    hot = np.argsort(total)[::-1][:HOT_PER_PART]
    out.append((-1, _HOT, part, packed(distinct[hot]), packed(total[hot]), None, None))
    tokens = np.where(distinct == START, np.uint64(0), total)  # the start is a context only
    of_counts = np.bincount(np.minimum(tokens, CUTOFF + 2).astype(np.int64), minlength=CUTOFF + 3)[1:CUTOFF + 2]
    statistics = np.array([tokens.sum(), (tokens > 0).sum(), *of_counts], np.int64)
    out.append((-1, _STATISTICS, part, packed(statistics), None, None, None))
    return _table(out)


# ---- pairs --------------------------------------------------------------------------------------------------------
class Pairs:
    """The different pairs of a chunk in the order in which it asks for them: by table part, context, word."""

    def __init__(self, row: dict, hot: dict[int, int], parts: int):
        self.dictionary = unpacked(row["dictionary"], np.uint64)
        places = unsqueezed(row["places"], np.uint32)
        self.lengths = unpacked(row["lengths"], np.int64)
        self.roles = unpacked(row["roles"], np.uint8)
        # Every place but an end is the context of the next.
        joined = places[:-1].astype(np.uint64) << np.uint64(32)
        joined |= places[1:]
        ends = np.cumsum(self.lengths)[:-1] - 1
        del places
        pairs, index = np.unique(np.delete(joined, ends), return_inverse=True)
        del joined
        first = (pairs >> np.uint64(32)).astype(np.int64)
        second = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del pairs
        part = part_of(self.dictionary, parts)[first]
        for word, shares in hot.items():
            at = np.searchsorted(self.dictionary, np.uint64(word))
            if at < len(self.dictionary) and self.dictionary[at] == np.uint64(word):
                own = slice(*np.searchsorted(first, [at, at + 1]))
                part[own] = (part[own] + (mixed(self.dictionary[second[own]]) % np.uint64(shares)).astype(np.int64)) % parts
        order = np.argsort(part, kind="stable")
        self.first, self.second, self.part = first[order], second[order], part[order]
        place_of = np.empty(len(order), np.int32)
        place_of[order] = np.arange(len(order), dtype=np.int32)
        self.index = place_of[index]  # of each token
        # Runs of one context within one part.
        starts = np.ones(len(order), bool)
        starts[1:] = (self.first[1:] != self.first[:-1]) | (self.part[1:] != self.part[:-1])
        self.run = np.cumsum(starts) - 1
        self.run_first = self.first[starts]
        self.run_part = self.part[starts]

    def learned(self) -> np.ndarray:
        """Training count of each pair in this chunk."""
        taught = np.repeat(self.roles == LEARNED, self.lengths - 1)
        return np.bincount(self.index[taught], minlength=len(self.first)).astype(np.uint64)


def _totals(answers: list[dict]) -> np.ndarray:
    """Corpus counts of a chunk's dictionary: the parts' answers one after the other."""
    return np.concatenate([unsqueezed(r["a"], np.uint64) for r in sorted(answers, key=lambda r: r["part"])])


def _ask_pairs(hot: dict[int, int], parts: int, turn: int):
    def ask(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        del key
        out = []
        for row in chunk.to_pylist():
            totals = _totals(answers.to_pylist())
            pairs = Pairs(row, hot, parts)
            learned = pairs.learned()
            cuts, run_cuts = (np.searchsorted(p, np.arange(1, parts)) for p in (pairs.part, pairs.run_part))
            sizes = np.bincount(pairs.run, minlength=len(pairs.run_first)).astype(np.uint32)
            split = zip(np.split(pairs.run_first, run_cuts), np.split(sizes, run_cuts), np.split(pairs.second, cuts),
                        np.split(learned, cuts), strict=True)
            for part, (contexts, size, second, count) in enumerate(split):
                if len(second) and part % ROUNDS == turn:
                    out.append((row["chunk"], _PAIRS, part, packed(pairs.dictionary[contexts]), squeezed(size),
                                short(pairs.dictionary[second]), squeezed(np.concatenate([count, totals[second]]))))
        return _table(out)

    return ask


def _answer_pairs(unigrams: Unigrams, hot: dict[int, int]):
    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        part, chunks = key[0].as_py(), rows["chunk"].to_pylist()
        contexts = [unpacked(b, np.uint64) for b in rows["a"].to_pylist()]
        sizes = [unsqueezed(b, np.uint32) for b in rows["b"].to_pylist()]
        seconds = [unshort(b) for b in rows["c"].to_pylist()]
        numbers = [unsqueezed(b, np.uint64) for b in rows["d"].to_pylist()]
        learned = np.concatenate([n[:len(n) // 2] for n in numbers])
        totals = np.concatenate([n[len(n) // 2:] for n in numbers])
        del numbers
        all_contexts, all_sizes = np.concatenate(contexts), np.concatenate(sizes)
        known, run_context = np.unique(all_contexts, return_inverse=True)
        context = np.repeat(run_context, all_sizes)
        pair, one, index = np.unique(mixed(known[context] ^ mixed(np.concatenate(seconds))), return_index=True, return_inverse=True)
        count = np.bincount(index, weights=learned.astype(np.float64), minlength=len(pair)).astype(np.uint64)
        # Of each context: numbers of pairs that occur once, twice ...; the count of the others; P of all words seen after it.
        owner, seen = context[one], count > 0
        times = np.minimum(count, CUTOFF + 1).astype(np.int64)
        of_counts = np.column_stack([np.bincount(owner[times == r], minlength=len(known)) for r in range(1, CUTOFF + 1)])
        rest = np.bincount(owner, weights=np.where(count > CUTOFF, count, 0).astype(np.float64), minlength=len(known))
        covered = np.bincount(owner, weights=np.where(seen, unigrams(totals[one]), 0.0), minlength=len(known))
        out = []
        pair_cuts = np.cumsum([len(s) for s in seconds])[:-1]
        run_cuts = np.cumsum([len(c) for c in contexts])[:-1]
        for chunk, own_count, own in zip(chunks, np.split(count[index], pair_cuts), np.split(run_context, run_cuts), strict=True):
            out.append((chunk, _PAIRS, part, squeezed(own_count), squeezed(of_counts[own].astype(np.uint32).ravel()),
                        squeezed(rest[own].astype(np.uint64)), packed(covered[own])))
        for word in hot:
            at = np.searchsorted(known, np.uint64(word))
            if at < len(known) and known[at] == np.uint64(word):
                out.append((-1, _HOT, part, packed(known[at:at + 1]), packed(of_counts[at].astype(np.int64)), packed(rest[at:at + 1]),
                            packed(covered[at:at + 1])))
        statistics = np.bincount(np.minimum(count, CUTOFF + 2).astype(np.int64), minlength=CUTOFF + 3)[1:CUTOFF + 2]
        out.append((-1, _STATISTICS, part, packed(statistics.astype(np.int64)), None, None, None))
        return _table(out)

    return answer


# ---- scores -------------------------------------------------------------------------------------------------------
def context_weights(of_counts: np.ndarray, rest: np.ndarray, covered: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, alpha) of contexts from their numbers of pairs by count, the count of the others, and P of the words seen."""
    r = np.arange(1, CUTOFF + 1)
    count = rest + of_counts @ r
    left = of_counts @ (r * (1 - d[1:]))
    total = np.where(left > 1e-9, count, count + 1)
    left = np.where(left > 1e-9, left, 1.0)
    return np.where(count > 0, total, 1.0), np.where(count > 0, left / total / (1 - covered), 1.0)


def _score(unigrams: Unigrams, d: np.ndarray, hot: dict[int, int], hot_weights: dict[int, tuple], parts: int, id_type: pa.DataType):
    def score(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        del key
        row, replies = chunk.to_pylist()[0], answers.to_pylist()
        totals = _totals([r for r in replies if r["kind"] == _WORDS])
        pairs = Pairs(row, hot, parts)
        found = sorted((r for r in replies if r["kind"] == _PAIRS), key=lambda r: r["part"])
        count = np.concatenate([unsqueezed(r["a"], np.uint64) for r in found]).astype(np.float64)
        of_counts = np.concatenate([unsqueezed(r["b"], np.uint32) for r in found]).reshape(-1, CUTOFF).astype(np.float64)
        rest = np.concatenate([unsqueezed(r["c"], np.uint64) for r in found]).astype(np.float64)
        covered = np.concatenate([unpacked(r["d"], np.float64) for r in found])
        total, alpha = context_weights(of_counts, rest, covered, d)
        for word, (hot_total, hot_alpha) in hot_weights.items():
            own = pairs.dictionary[pairs.run_first] == np.uint64(word)
            total[own], alpha[own] = hot_total, hot_alpha
        kept = np.where(count > CUTOFF, 1.0, d[np.minimum(count, CUTOFF).astype(np.int64)])
        below = unigrams(totals[pairs.second])
        p = np.where(count > 0, kept * count / total[pairs.run], alpha[pairs.run] * below)
        by_token = np.log10(p)[pairs.index]
        of_text = pairs.lengths - 1
        starts = np.cumsum(of_text) - of_text
        token_counts = totals[pairs.second][pairs.index].astype(np.float64)
        n = len(of_text)
        roles = pairs.roles
        return pa.table({
            "doc_id": pa.array(row["ids"], id_type), "held_out": pa.array(roles == HELD_OUT),
            "n_tokens": pa.array(of_text, pa.int64()), "n_known": pa.array(np.add.reduceat((token_counts > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(n, unigrams.n_tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(unigrams.base(token_counts), starts)),
            "score": pa.array(np.add.reduceat(by_token, starts))})

    return score


def _added(df: DataFrame, size: int) -> np.ndarray:
    """Sum of the statistics rows, one of each table part."""
    rows = [unpacked(r["a"], np.int64) for r in df.where(F.col("kind") == _STATISTICS).select("a").collect()]
    return np.sum(rows, axis=0) if rows else np.zeros(size, np.int64)


def score_texts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    parts = buckets_for(documents.select(F.col(text_column).cast("string").alias("text")), PARTS_PER_PARTITION, BYTES_PER_PART)
    chunks = stage(_chunked(documents, id_column, text_column, chunk_words), "chunks")
    id_field = chunks.schema["ids"].dataType.elementType

    asked = chunks.select("chunk", "dictionary", "counts").mapInArrow(_ask_words(parts), _ANSWERS)
    word_answers = stage(asked.groupBy("part").applyInArrow(_answer_words, _ANSWERS), "word-counts")
    n_tokens, n_words, *of_counts = _added(word_answers, CUTOFF + 3).tolist()
    unigrams = Unigrams(n_tokens, n_words, np.array(of_counts))
    # Contexts with more than half a part's share of all tokens: at most twice as many as there are parts.
    hot = {}
    for r in word_answers.where(F.col("kind") == _HOT).select("a", "b").collect():
        for word, count in zip(unpacked(r["a"], np.uint64).tolist(), unpacked(r["b"], np.uint64).tolist(), strict=True):
            if 2 * parts * count > n_tokens:
                hot[word] = min(parts, -(-2 * parts * count // n_tokens))

    by_chunk = chunks.groupBy("chunk")
    known = word_answers.where("chunk >= 0").groupBy("chunk")
    turns = []
    for turn in range(ROUNDS):
        requests = by_chunk.cogroup(known).applyInArrow(_ask_pairs(hot, parts, turn), _ANSWERS)
        turns.append(stage(requests.groupBy("part").applyInArrow(_answer_pairs(unigrams, hot), _ANSWERS), "pair-counts"))
    pair_answers = reduce(DataFrame.unionByName, turns)
    d = discounts(_added(pair_answers, CUTOFF + 1))
    sums: dict[int, list] = {}
    for r in pair_answers.where(F.col("kind") == _HOT).select("a", "b", "c", "d").collect():
        word = int(unpacked(r["a"], np.uint64)[0])
        part = [unpacked(r["b"], np.int64).astype(np.float64), unpacked(r["c"], np.float64)[0], unpacked(r["d"], np.float64)[0]]
        sums[word] = [x + y for x, y in zip(sums[word], part, strict=True)] if word in sums else part
    hot_weights = {}
    for word, (of, rest, covered) in sums.items():
        total, alpha = context_weights(of[None, :], np.array([rest]), np.array([covered]), d)
        hot_weights[word] = (float(total[0]), float(alpha[0]))

    answers = word_answers.unionByName(pair_answers).where("chunk >= 0")
    scored = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(unigrams, d, hot, hot_weights, parts, to_arrow_type(id_field)),
        f"doc_id {id_field.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double")
    return scored
