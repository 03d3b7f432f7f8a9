"""Operator 6: language identification by interpolated Kneser-Ney character models, one for each language.

A model predicts each letter of a word, and its end, from up to ``ORDER - 1`` letters before it in the word. Sorted arrays of n-gram hashes
hold, for a block of languages, the discounted probabilities, and others each context's weight for the shorter context; their
size grows with the number of languages, not with its square. A text's cross-entropy under a language is the mean over its letters; the lowest
wins. Its probability comes from a softmax whose scale is fitted on documents kept back from the counts. A text is marked as rejected if its
cross-entropy lies above its language's threshold, the one that best parts the kept-back documents of the language from those of other
languages that would be taken for it if their own were not known.

Fitted on a bounded sample of each language, whatever the table's size: ``SAMPLE_PER_LANGUAGE`` documents, chosen by a hash of the id,
and of these whole ones until they have ``SAMPLE_CHARACTERS`` characters; copies count once. Every language that occurs is learned; one in
``KEPT_BACK`` documents is kept back from the counts where a language has at least ``LEAST_TO_KEEP_BACK``. All rows are predicted.

Null texts and texts without a letter are ``und`` with score 0. Rows with a null language or id are not learned from. If no language
can be learned, every text is ``und``. Repeated rows each get their row; an empty table gives no rows; columns beside the named ones are not
read. A very long text is split into words once, and costs of words are looked up, so it takes time in proportion to its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tidesift.operators.staging import stage

from llm.common import byte_texts, column, fold_of, mixed

ORDER = 5
SAMPLE_PER_LANGUAGE, SAMPLE_CHARACTERS = 300, 4_000_000
KEPT_BACK, LEAST_TO_KEEP_BACK = 5, 10  # one document of so many calibrates, in languages with so many
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
BLOCK_OF_LANGUAGES = 8
KNOWN_COSTS = 4_000_000  # numbers a worker keeps: costs of words times languages
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = re.compile(r"[^\W\d_]+")
_ORDER_SALT, _LANGUAGE_SALT = 0xD1B54A32D192ED03, np.uint64(0x8CB92BA72F3D8DD7)
_EDGE = 1  # code point that stands for a word's edge


class Padded:
    """Code points of words, each after ``ORDER - 1`` opening edges and before a closing one."""

    def __init__(self, words: list[str]):
        edge = chr(_EDGE)
        text = "".join(edge * (ORDER - 1) + w + edge for w in words)
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        # Places that are predicted: the letters and the closing edge.
        self.places = np.arange(len(self.word)) + (ORDER - 1) * (self.word + 1)

    def keys(self, n: int) -> np.ndarray:
        """Hash of the n codes up to each place, different for each n."""
        out = np.zeros(len(self.codes), np.uint64)
        for back in range(n - 1, -1, -1):
            out[back:] = out[back:] * _BASE + self.codes[:len(self.codes) - back]
        return mixed(out + np.uint64(n * _ORDER_SALT % (1 << 64))) if n else np.zeros(len(self.codes), np.uint64)


@dataclass(frozen=True)
class HashTable:
    """Sorted hashes and, for each, a row of values of a block of languages."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], block: range, missing: float) -> HashTable:
        """From (hashes, languages, values), each pair of hash and language once."""
        keys, languages, values = (np.concatenate(c) for c in zip(*parts, strict=True))
        own = (languages >= block.start) & (languages < block.stop)
        distinct, index = np.unique(keys[own], return_inverse=True)
        table = np.full((len(distinct), len(block)), missing, np.float32)
        table[index, languages[own] - block.start] = values[own]
        return HashTable(distinct, table)

    def rows(self, wanted: np.ndarray, missing: float) -> np.ndarray:
        found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        rows = self.values[found]
        rows[self.keys[found] != wanted] = missing
        return rows


@dataclass(frozen=True)
class Models:
    languages: tuple[str, ...]
    # For each block of languages the discounted probabilities of n-grams, and contexts' weights of the shorter context.
    blocks: tuple[tuple[range, HashTable, HashTable], ...]
    uniform: float
    scale: float = 1.0
    highest: np.ndarray | None = None  # accepted cross-entropy by language

    def probabilities(self, text: Padded) -> np.ndarray:
        """Of each predicted letter under each language."""
        p = np.full((len(text.places), len(self.languages)), self.uniform)
        for n in range(1, ORDER + 1):
            contexts, grams = text.keys(n - 1)[text.places - 1], text.keys(n)[text.places]
            for block, probability, weight in self.blocks:
                own = p[:, block.start:block.stop]
                own *= weight.rows(contexts, 1.0)
                own += probability.rows(grams, 0.0)
        return p

    def costs(self, words: list[str]) -> np.ndarray:
        """Bits of each word under each language, and in the last column its number of predicted letters."""
        text = Padded(words)
        bits = np.add.reduceat(-np.log2(self.probabilities(text)), np.cumsum(text.lengths) - text.lengths, axis=0)
        return np.column_stack([bits, text.lengths])


def build(counts: pd.DataFrame) -> Models:
    """Interpolated Kneser-Ney models from word counts: columns lang, word, n."""
    languages = tuple(sorted(counts["lang"].unique()))
    width = len(languages)
    text = Padded(counts["word"].tolist())
    language = np.searchsorted(np.array(languages), counts["lang"].to_numpy(str))[text.word].astype(np.uint64)
    times = counts["n"].to_numpy(np.float64)[text.word]
    own = [mixed(text.keys(n)[text.places] + (language + np.uint64(1)) * _LANGUAGE_SALT) for n in range(ORDER + 1)]
    grams, contexts = [], []
    longer = None
    for n in range(ORDER, 0, -1):
        key, first, index = np.unique(own[n], return_index=True, return_inverse=True)
        if longer is None:
            count = np.bincount(index, weights=times, minlength=len(key))
        else:  # the number of different grams, one longer, that end in this one
            count = np.bincount(np.searchsorted(key, own[n][longer]), minlength=len(key)).astype(np.float64)
        longer, lang = first, language[first].astype(np.int64)
        ones, twos = (np.bincount(lang[count == c], minlength=width) for c in (1, 2))
        discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)[lang]
        context = text.keys(n - 1)[text.places[first] - 1]
        whose = mixed(context + (lang.astype(np.uint64) + np.uint64(1)) * _LANGUAGE_SALT)
        distinct, one, group = np.unique(whose, return_index=True, return_inverse=True)
        total = np.bincount(group, weights=count, minlength=len(distinct))
        grams.append((text.keys(n)[text.places[first]], lang, (count - discount) / total[group]))
        contexts.append((context[one], lang[one], np.bincount(group, weights=discount) / total))
    letters = len(np.unique(text.codes)) + 1
    blocks = [range(i, min(i + BLOCK_OF_LANGUAGES, width)) for i in range(0, width, BLOCK_OF_LANGUAGES)]
    return Models(languages, tuple((b, HashTable.of(grams, b, 0.0), HashTable.of(contexts, b, 1.0)) for b in blocks), 1 / letters)


class Scorer:
    """Cross-entropies of texts. Costs of words are kept, up to a bounded number; results do not depend on it."""

    def __init__(self, models: Models, known: int = KNOWN_COSTS):
        self.models, self.known = models, known // (len(models.languages) + 1)
        self.place: dict[str, int] = {}
        self.costs = np.zeros((1024, len(models.languages) + 1))

    def _learn(self, tokens: list[str]) -> None:
        """Costs of white-space separated tokens: those of the letter runs in them."""
        runs = [_LETTERS.findall(t) for t in tokens]
        flat = [w for r in runs for w in r]
        sums = np.zeros((len(tokens), len(self.models.languages) + 1))
        if flat:
            np.add.at(sums, np.repeat(np.arange(len(tokens)), [len(r) for r in runs]), self.models.costs(flat))
        start = len(self.place)
        self.place.update(zip(tokens, range(start, start + len(tokens)), strict=True))
        if len(self.costs) < len(self.place):
            self.costs = np.concatenate([self.costs[:start], np.zeros((2 * len(self.place) - start, self.costs.shape[1]))])
        self.costs[start:len(self.place)] = sums

    def totals(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language, and its number of predicted letters."""
        split = [t.lower().split() for t in texts]
        if len(self.place) > self.known:
            self.place.clear()
        new = [w for w in set().union(*split) if w not in self.place]
        if new:
            self._learn(new)
        place = self.place.__getitem__
        return np.array([self.costs[np.fromiter(map(place, tokens), np.int64, len(tokens))].sum(axis=0) for tokens in split])


def decide(models: Models, totals: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, probability and acceptance of texts, from what ``Scorer.totals`` gives."""
    letters = totals[:, -1]
    entropy = totals[:, :-1] / np.maximum(letters, 1)[:, None]
    best = entropy.argmin(axis=1)
    lowest = entropy[np.arange(len(entropy)), best]
    probability = 1 / np.exp2(-models.scale * (entropy - lowest[:, None])).sum(axis=1)
    found = [models.languages[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
    accepted = letters > 0 if models.highest is None else (letters > 0) & (lowest <= models.highest[best])
    return found, np.where(letters > 0, probability, 0.0), accepted


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in byte_texts(column(batch, "text"))]


def _some(texts: list, step: int = 64) -> Iterator[slice]:
    return (slice(i, i + step) for i in range(0, len(texts), step))


def fit(documents: DataFrame, learn: Column | None = None, sample_per_language: int = SAMPLE_PER_LANGUAGE,
        sample_characters: int = SAMPLE_CHARACTERS) -> Models | None:
    """Models from ``documents`` (doc_id, text, lang); ``learn`` restricts the rows."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), "lang").where(
        "doc_id is not null and text is not null and lang is not null")
    rows = rows if learn is None else rows.where(learn)
    # The documents first in the order of a hash, of each language; a task passes on no more than these of its own rows. Texts stay
    # where they are until the few are known.
    text_hash = F.xxhash64("text")
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text_hash")
    few = rows.select("doc_id", "lang", text_hash.alias("text_hash"), F.length("text").alias("chars"), F.xxhash64("doc_id").alias("place")).withColumn(
        "number", F.row_number().over(order)).where(F.col("number") <= sample_per_language)
    before = F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = few.withColumn("before", before).where(F.col("before") < sample_characters).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    kept_back = (F.col("n") >= LEAST_TO_KEEP_BACK) & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(KEPT_BACK)) == 0)
    key = ["doc_id", "lang", "text_hash"]
    # Written first: Spark then knows how few they are before it decides how to join them with the texts.
    named = stage(chosen.groupBy(*key).agg(F.max(kept_back).alias("kept_back")), "drawn")
    sample = stage(rows.withColumn("text_hash", text_hash).join(named, key).groupBy(*key, "kept_back").agg(F.first("text").alias("text"))
                   .select("lang", "text", "kept_back"), "languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, lang in zip(_texts(batch), column(batch, "lang").to_pylist(), strict=True):
                seen.update((lang, w) for w in _LETTERS.findall(text.lower()))
            pairs = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()),
                 pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    counts = (sample.where("not kept_back").mapInArrow(count, "lang string, word string, n bigint")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas())
    if counts.empty:
        return None
    models = build(counts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for batch in batches:
            totals = scorer.totals(_texts(batch))
            yield pa.RecordBatch.from_arrays([column(batch, "lang"), pa.array(list(totals), pa.list_(pa.float64()))], ["lang", "totals"])

    known = sample.where("kept_back").mapInArrow(measure, "lang string, totals array<double>").toPandas()
    return _calibrated(models, known)


def _parting(own: np.ndarray, foreign: np.ndarray) -> float:
    """The bound up to which the share of own values less that of foreign ones is highest; in the middle of the gap above it."""
    if not len(own) or not len(foreign):
        return math.inf
    values = np.unique(np.concatenate([own, foreign]))
    gain = (np.searchsorted(np.sort(own), values, side="right") / len(own)
            - np.searchsorted(np.sort(foreign), values, side="right") / len(foreign))
    best = int(np.flatnonzero(gain == gain.max())[-1])
    return float(values[best:best + 2].mean())


def _calibrated(models: Models, known: pd.DataFrame) -> Models:
    """Scale of the softmax and accepted cross-entropies from kept-back documents."""
    totals = np.array(known["totals"].tolist()).reshape(len(known), len(models.languages) + 1)
    index = {lang: i for i, lang in enumerate(models.languages)}
    usable = (totals[:, -1] > 0) & known["lang"].isin(index).to_numpy()
    highest = np.full(len(models.languages), np.inf)
    if not usable.any():
        return Models(**{**models.__dict__, "highest": highest})
    truth = known["lang"][usable].map(index).to_numpy()
    entropy = totals[usable, :-1] / totals[usable, -1:]

    def loss(scale: float) -> float:
        logits = -scale * (entropy - entropy.min(axis=1, keepdims=True))
        return float(np.mean(np.log2(np.exp2(logits).sum(axis=1)) - logits[np.arange(len(truth)), truth]))

    others = entropy.copy()
    others[np.arange(len(truth)), truth] = np.inf
    taken_for = others.argmin(axis=1)  # what a text would be if its own language were not known
    for i in range(len(models.languages)):
        highest[i] = _parting(entropy[truth == i, i], entropy[(truth != i) & (taken_for == i), i])
    return Models(**{**models.__dict__, "scale": min(SCALES, key=loss), "highest": highest})


def predict(documents: DataFrame, models: Models | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted (false where the calibrated rejection applies)."""
    read = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = read.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            texts = _texts(batch)
            langs, scores, accepted = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for some in _some(texts) if scorer else ():
                langs[some], scores[some], accepted[some] = decide(scorer.models, scorer.totals(texts[some]))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    found = read.mapInArrow(label, f"doc_id {id_type}, lang_pred string, score double, accepted boolean")
    return found.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
