"""Operator 7: toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding takes compatibility forms, look-alike letters of other scripts and digit substitutions back to plain lower-case
letters. The lexicon holds whole words and word beginnings, learned from labelled documents as smoothed log-odds with a
significance test, and exception phrases: two-word phrases around an entry that only harmless documents have. One automaton
holds both; of overlapping matches the leftmost longest counts, so an exception phrase hides the entry inside it.
The weights of a text's matches, as a sum and normalised by its length, go through a logistic curve to a score from 0 to 1.

The lexicon is fitted on a bounded sample: at most ``SAMPLE_PER_CLASS`` labelled documents of each label, those with the
smallest hash of their id; classes are weighted back to their real sizes. Everything else covers all rows. The lexicon has no limit of its own:
what comes to the driver are the patterns of ``LEAST_DOCUMENTS`` documents of the sample or more that tell the labels apart, a beginning only
if it occurs in other documents than what it begins. A text is folded and matched in one pass, so a very long one takes time in
proportion to its length.

Null, empty and wordless texts have no match and get the score of a text without matches. Null labels are not learned
from; with one class or none the lexicon is empty and every score 0. An empty table gives no rows. A null id is never held out. Repeated rows each get their row;
columns beside the named ones are not read, so clashing names are harmless.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidesift.operators.staging import stage

from llm.common import byte_texts, column, fold_of

SAMPLE_PER_CLASS = 6000
SHORTEST, LONGEST = 3, 8  # characters of a word beginning
LEAST_DOCUMENTS, LEAST_Z, LEAST_WEIGHT = 3, 2.9, 3.0  # a weight of 3: twenty times as frequent in toxic documents
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, digits that stand for letters, characters without width.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ь": "b", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
WIDTHLESS = ("­", "​", "‌", "‍", "⁠", "﻿")
_TABLE = str.maketrans({**LOOKALIKES, **DIGITS, **dict.fromkeys(WIDTHLESS)} | {"з": "e"})
_SIGNS = re.compile(r"(?<=\w)[@$](?=\w)")
_GAPS = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Words in lower case, substitutions undone, each between spaces of its own: ``" some  words "``."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_TABLE)
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    inner = _GAPS.sub("  ", text).strip()
    return f" {inner} " if inner else ""


@dataclass(frozen=True)
class Lexicon:
    """``entries``: pattern (``" word "`` or ``" beginning"``) to weight; ``exceptions``: ``" two  words "``."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] | None = None  # intercept, sum, sum by length

    def matcher(self) -> ahocorasick.Automaton | None:
        if not self.entries:
            return None
        found = ahocorasick.Automaton()
        for pattern, weight in self.entries.items():
            found.add_word(pattern, (pattern, weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (phrase, 0.0))
        found.make_automaton()
        return found


def features(words: str, matcher: ahocorasick.Automaton | None) -> tuple[float, float]:
    """Weight of the matches, and the same by 100 words, on a logarithmic scale."""
    if matcher is None or not words:
        return 0.0, 0.0
    seen = Counter(match for _, match in matcher.iter_long(words))
    weight = sum(w * (1 + math.log(n)) for (_, w), n in seen.items())  # a repeated match adds less each time
    if weight <= 0:
        return 0.0, 0.0
    n_words = words.count("  ") + 1
    return math.log1p(weight), math.log1p(100 * weight / (n_words + 20))


def score_of(found: tuple[float, float], lexicon: Lexicon) -> float:
    if lexicon.curve is None:
        return 0.0
    a, b, c = lexicon.curve
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * found[0] + c * found[1]))))


def terms(words: str) -> set[str]:
    """Patterns of a folded text: its words and their beginnings."""
    found = set()
    for w in set(words.split()):
        found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return found


def phrases(words: str, matcher: ahocorasick.Automaton) -> set[str]:
    """Two-word phrases with a match in one of the words."""
    found = set()
    for end, (pattern, weight) in matcher.iter_long(words):
        if weight <= 0:
            continue
        start = end - len(pattern) + 1
        stop = words.find(" ", start + 1)
        before = words.rfind(" ", 0, max(start - 1, 0))
        if start > 0 and before >= 0:
            found.add(words[before:stop + 1])
        after = words.find(" ", stop + 2)
        if after > 0:
            found.add(words[start:after + 1])
    return found


def _counted(sample: DataFrame, make) -> DataFrame:
    """(item, toxic, harmless): documents of the sample with each item, added up per task before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for data, toxic in zip(byte_texts(column(batch, "text")), column(batch, "toxic").to_pylist(), strict=True):
                seen[toxic].update(make(folded((data or b"").decode("utf-8", "replace"))))
            items = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array([seen[1][i] for i in items], pa.int64()),
                 pa.array([seen[0][i] for i in items], pa.int64())], ["item", "toxic", "harmless"])

    parts = sample.mapInArrow(count, "item string, toxic bigint, harmless bigint")
    return parts.groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("harmless").alias("harmless"))


def _log_odds(toxic, harmless, n_toxic: int, n_harmless: int, log, sqrt):
    """Smoothed log-odds of an item's documents, and how many standard errors it is from 0; of numbers or columns."""
    toxic, harmless = toxic + 0.5, harmless + 0.5
    weight = log((toxic / (n_toxic + 1)) / (harmless / (n_harmless + 1)))
    return weight, weight / sqrt(1 / toxic + 1 / harmless)


def _beginnings(items: DataFrame) -> DataFrame:
    """The beginnings of items, each with the counts of its item: one that has the same is in the same documents."""
    longest = F.least(F.length("item") - 1, F.lit(1 + LONGEST))
    begun = F.transform(F.sequence(F.lit(1 + SHORTEST), longest), lambda k: F.substring("item", F.lit(1), k))
    return items.where(longest > SHORTEST).select(F.explode(begun).alias("item"), "toxic", "harmless").distinct()


def _choose(candidates: list[tuple[str, int, int]], n_toxic: int, n_harmless: int) -> dict[str, float]:
    """Entries of (pattern, toxic, harmless documents): the surest first and of equally sure ones the longest.

    A continuation of an entry is left out unless it says clearly more, a beginning unless it says more than what it begins. A
    beginning must also stand without the documents of its chosen continuations: what "lose" has from "loser" alone is
    no reason to keep it.
    """
    def odds(toxic: int, harmless: int) -> tuple[float, float]:
        return _log_odds(max(toxic, 0), max(harmless, 0), n_toxic, n_harmless, math.log, math.sqrt)

    def beginnings(pattern: str) -> list[str]:
        return [pattern[:k] for k in range(1 + SHORTEST, len(pattern))]

    chosen: dict[str, tuple[float, int, int]] = {}
    begun: dict[str, float] = {}
    for pattern, toxic, harmless in sorted(candidates, key=lambda c: (-odds(*c[1:])[1], -len(c[0]), c[0])):
        weight, z = odds(toxic, harmless)
        shorter = max((chosen[p][0] for p in beginnings(pattern) if p in chosen), default=-math.inf)
        if weight >= LEAST_WEIGHT and z >= LEAST_Z and weight > shorter + 1 and weight > begun.get(pattern, -math.inf) + 1e-9:
            chosen[pattern] = weight, toxic, harmless
            for p in beginnings(pattern):
                begun[p] = max(weight, begun.get(p, -math.inf))
    for pattern in sorted(chosen, key=len, reverse=True):
        weight, toxic, harmless = chosen[pattern]
        longer = [chosen[p] for p in chosen if p != pattern and p.startswith(pattern)]
        if longer and odds(toxic - sum(c[1] for c in longer), harmless - sum(c[2] for c in longer))[0] < LEAST_WEIGHT:
            del chosen[pattern]
    return {pattern: weight for pattern, (weight, *_) in chosen.items()}


def _fit_curve(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression with a light ridge, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weights * (y - p)) - ridge @ beta
        hessian = (design * (weights * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(documents: DataFrame, labels: DataFrame, learn: Column | None = None, sample_per_class: int = SAMPLE_PER_CLASS) -> Lexicon:
    """Lexicon from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1). ``learn`` restricts the label rows."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    rows = rows if learn is None else rows.where(learn)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon()
    drawn = [rows.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class) for t in (0, 1)]
    sample = stage(documents.select("doc_id", F.col("text").cast("string").alias("text"))
                   .join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("text", "toxic"), "labelled")
    drawn_sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(drawn_sizes) < 2:
        return Lexicon()
    n_toxic, n_harmless = drawn_sizes[1], drawn_sizes[0]
    weight, z = _log_odds(F.col("toxic"), F.col("harmless"), n_toxic, n_harmless, F.log, F.sqrt)
    telling = stage(_counted(sample, terms).where(F.col("toxic") >= LEAST_DOCUMENTS).where((z >= LEAST_Z) & (weight >= LEAST_WEIGHT)), "telling")
    best = telling.join(_beginnings(telling), ["item", "toxic", "harmless"], "left_anti").collect()
    lexicon = Lexicon(_choose([(r["item"], r["toxic"], r["harmless"]) for r in best], n_toxic, n_harmless))
    matcher = lexicon.matcher()
    if matcher is None:
        return Lexicon()
    matched = _counted(sample, lambda words: phrases(words, matcher))
    harmless = matched.where((F.col("harmless") >= LEAST_DOCUMENTS) & (F.col("toxic") == 0)).select("item").collect()
    lexicon = Lexicon(lexicon.entries, tuple(sorted(r["item"] for r in harmless)))
    known = _features(sample, lexicon, ["toxic"]).toPandas()
    y = known["toxic"].to_numpy(float)
    weights = np.array([sizes[int(t)] / drawn_sizes[int(t)] for t in y])
    return Lexicon(lexicon.entries, lexicon.exceptions, _fit_curve(known[["total", "dense"]].to_numpy(float), y, weights))


def _features(documents: DataFrame, lexicon: Lexicon, kept: list[str]) -> DataFrame:
    types = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            found = [features(folded((t or b"").decode("utf-8", "replace")), matcher) for t in byte_texts(column(batch, "text"))]
            score = [score_of(f, lexicon) for f in found]
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in kept), *(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)),
                 pa.array(score, pa.float64())], [*kept, "total", "dense", "score"])

    return documents.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(
        add, f"{types}, total double, dense double, score double")


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    found = _features(documents, lexicon, ["doc_id"])
    return found.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(documents: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, all columns as they were."""
    place = documents.columns.index(text_column)
    plain = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            texts = byte_texts(batch.column(place))
            mild = [score_of(features(folded((t or b"").decode("utf-8", "replace")), matcher), lexicon) < threshold for t in texts]
            yield batch.filter(pa.array(mild, pa.bool_()))

    return plain.mapInArrow(keep, plain.schema).toDF(*documents.columns)
