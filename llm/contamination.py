"""Operator 11: benchmark decontamination by a positional inverted index, in DataFrame functions only.

1. The words of the test items make a vocabulary. A document's words are stored as postings (term, document, position), written by
   the tasks that read the texts, without a shuffle. Given a vocabulary and the length of the shortest phrase, only words in a run of that
   many words of the vocabulary are stored; no other can take part in a phrase. The vocabulary is looked up in a bitmap of fixed size: a
   word that shares another's bit costs a posting, never a result.
2. Every window's terms are ordered by their number of postings. The rarest one's postings, moved back by its place in the item, are candidate
   places of the item; the lists of the next rarest, moved back likewise, are intersected with them one after the other.
3. Of the places that are left, all the item's terms are looked up; runs of neighbours as long as the window are exact matches.

Joins on a term have the tests' few rows on one side, which Spark broadcasts if they are small and otherwise divides (skew joins split the
postings of a hot term); later joins are on (document, position, term), of which there is one row. Equal items are searched for once.

``phrase_matches`` and ``proximity_matches`` are the general searches on an index; ``contamination`` makes the verdict per document.

A null text has no words, like an empty one; an item without words is never found. Repeated rows of documents are documents of their own, with
any id or none. Items of one id count as one; an item without id marks words, but is neither counted nor listed. An empty test table
leaves all documents clean, an empty document table gives no rows. Columns beside the named ones are not read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tidesift.operators.staging import stage

WINDOW = 10
LISTS = 3  # postings lists intersected before all terms of an item are looked up
BITMAP_LONGS = 1 << 14  # a million bits
# Fixed value: what is no part of a lower-cased word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Index:
    """``documents``: doc, id, n_words; ``postings``: term, doc, pos (from 0)."""

    documents: DataFrame
    postings: DataFrame


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text whose letters A to Z are lower-cased; other letters stay as they are."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


# ---- the index ----------------------------------------------------------------------------------------------------
def _place(term: Column) -> tuple[Column, Column]:
    """A term's long in the bitmap and its bit there."""
    h = F.xxhash64(term)
    return F.shiftrightunsigned(h, 64 - (BITMAP_LONGS.bit_length() - 1)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def bitmap(terms: DataFrame) -> DataFrame:
    """One row: the terms' bits as an array of ``BITMAP_LONGS`` longs."""
    slot, bit = _place(F.col("term"))
    used = terms.select(slot.cast("bigint").alias("slot"), bit.alias("bit")).groupBy("slot").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    every = terms.sparkSession.range(0, BITMAP_LONGS, 1, 1).select(F.col("id").alias("slot")).join(used, "slot", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("bits", F.lit(0)).alias("bits")))),
                                 lambda s: s["bits"]).alias("bitmap"))


def _runs(words: Column, bits: Column, least: int) -> Column:
    """Runs of at least ``least`` words that are in the bitmap, as (first, words)."""
    def unknown(word: Column, i: Column) -> Column:
        slot, bit = _place(word)
        return F.when(F.getbit(F.get(bits, slot), bit) == 0, i)

    def between(w: Column) -> Column:
        gaps = F.concat(F.array(F.lit(-1)), F.array_compact(F.transform(w, unknown)), F.array(F.size(w)))
        spans = let(gaps, lambda g: F.filter(F.transform(g, lambda x, k: F.struct(
            (x + 1).alias("first"), (F.get(g, k + 1) - x - 1).alias("n"))), lambda s: s["n"] >= least))
        return F.transform(spans, lambda s: F.struct(s["first"].alias("first"), F.slice(w, s["first"] + 1, s["n"]).alias("words")))

    return let(words, between)


def build_index(documents: DataFrame, terms: DataFrame | None = None, least_run: int = 1, id_column: str = "doc_id",
                text_column: str = "text") -> Index:
    """Index of all words, or of those that a phrase of ``least_run`` words or more, all among ``terms`` (term), can have."""
    words = words_of(F.col(text_column))
    read = documents.select(F.col(id_column).alias("id"), F.explode(F.array(F.struct(words.alias("words")))).alias("t"))
    words = F.col("t.words")
    if terms is None:
        runs = F.array(F.struct(F.lit(0).alias("first"), words.alias("words")))
    else:
        read = read.withColumn("bits", bitmap(terms).scalar())
        runs = let(F.col("bits"), lambda bits: _runs(words, bits, least_run))
    texts = stage(read.select(F.monotonically_increasing_id().alias("doc"), "id", F.size(words).cast("bigint").alias("n_words"),
                              runs.alias("runs")), "indexed-texts")
    postings = texts.select("doc", F.explode("runs").alias("run")).select(
        "doc", "run.first", F.posexplode("run.words").alias("place", "term")).select(
        "term", "doc", (F.col("first") + F.col("place")).alias("pos"))
    return Index(texts.select("doc", "id", "n_words"), stage(postings, "postings"))


# ---- phrases ------------------------------------------------------------------------------------------------------
def phrases_of(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Different word sequences as (phrase, words), and the items that have them as (phrase, item)."""
    read = items.select(F.col(id_column).cast("string").alias("item"), words_of(F.col(text_column)).alias("words")).where(F.size("words") > 0)
    phrases = stage(read.select("words").distinct().select(F.monotonically_increasing_id().alias("phrase"), "words"), "phrases")
    return phrases, phrases.join(read, "words").select("phrase", "item").distinct()


def tokens_of(phrases: DataFrame) -> DataFrame:
    """(phrase, n, off, term)"""
    return phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))


def _windows(index: Index, tokens: DataFrame, window: int) -> DataFrame:
    """(phrase, start, terms): each window's terms as (count, off, term) from the rarest on; none of them without a posting."""
    counts = index.postings.join(tokens.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    length = F.least(F.col("n"), F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), F.col("off") - length + 1), F.least(F.col("off"), F.col("n") - length))
    spread = tokens.join(counts, "term").select("phrase", length.alias("length"), F.explode(starts).alias("start"),
                                                F.struct("count", "off", "term").alias("t"))
    whole = spread.groupBy("phrase", "start", "length").agg(F.sort_array(F.collect_list("t")).alias("terms"))
    return whole.where(F.size("terms") == F.col("length")).select("phrase", "start", "terms")


def phrase_matches(index: Index, phrases: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """(doc, phrase, first, last): places of ``window`` or more consecutive words of a phrase (of all of a shorter one)."""
    tokens = stage(tokens_of(phrases), "tokens")
    places = index.postings.select("doc", "pos", "term")

    def rare(k: int) -> Column:
        """The window's k-th term from the rarest on; a window of fewer has its rarest again."""
        return F.coalesce(F.get("terms", F.lit(k)), F.get("terms", F.lit(0)))

    wanted = _windows(index, tokens, window).select("phrase", *[rare(k).alias(f"t{k}") for k in range(lists)]).distinct()
    found = wanted.withColumn("term", F.col("t0.term")).join(places, "term").withColumn("at", F.col("pos") - F.col("t0.off"))
    for k in range(1, lists):
        found = found.select("doc", "phrase", "at", *[f"t{i}" for i in range(k, lists)],
                             F.col(f"t{k}.term").alias("term"), (F.col("at") + F.col(f"t{k}.off")).alias("pos"))
        found = found.join(places, ["doc", "pos", "term"], "left_semi")
    whole = found.select("doc", "phrase", "at").distinct().join(tokens, "phrase").select(
        "doc", "phrase", "at", "n", "off", "term", (F.col("at") + F.col("off")).alias("pos")).join(places, ["doc", "pos", "term"], "left_semi")
    order = Window.partitionBy("doc", "phrase", "at").orderBy("off")
    runs = whole.withColumn("run", F.col("off") - F.row_number().over(order)).groupBy("doc", "phrase", "at", "run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("n").alias("n"))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.col("n"), F.lit(window))).select("doc", "phrase", "first", "last")


def proximity_matches(index: Index, phrases: DataFrame, window: int = WINDOW, slop: int = 5) -> DataFrame:
    """(doc, phrase, start, first, last): spans that hold all words of a window, in any order, among at most ``slop`` more words.

    ``start`` is the window's place in the phrase; of the spans that begin at ``first``, the shortest is given. The index must hold all words
    (``least_run`` of 1).
    """
    windows = _windows(index, tokens_of(phrases), window).select(
        "phrase", "start", F.size("terms").alias("length"), F.get("terms", F.lit(0))["term"].alias("rarest"),
        F.array_distinct(F.transform("terms", lambda t: t["term"])).alias("all"))
    reach = window + slop  # at least the length of any span
    cell = F.floor(F.col("pos") / reach)
    held = windows.join(index.postings.withColumnRenamed("term", "rarest"), "rarest").select(
        "doc", "phrase", "start", "length", F.col("pos").alias("held"), F.size("all").alias("different"), F.explode("all").alias("term"),
        F.array(cell - 1, cell, cell + 1).alias("cells"))
    near = held.withColumn("cell", F.explode("cells")).drop("cells").join(
        index.postings.withColumn("cell", cell), ["doc", "cell", "term"]).where(F.abs(F.col("pos") - F.col("held")) < reach)
    group = ["doc", "phrase", "start", "length", "held", "different"]
    begun = near.select(*group, F.col("pos").alias("first")).distinct().join(near.select(*group, "term", "pos"), group).where(
        (F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + F.col("length") + slop))
    nearest = begun.groupBy(*group, "first", "term").agg(F.min("pos").alias("pos"))
    spans = nearest.groupBy(*group, "first").agg(F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))
    inside = (F.col("n") == F.col("different")) & F.col("held").between(F.col("first"), F.col("last"))
    return spans.where(inside).select("doc", "phrase", "start", "first", "last").distinct()


# ---- documents ----------------------------------------------------------------------------------------------------
def covered(matches: DataFrame) -> DataFrame:
    """(doc, n_hit): words inside any match."""
    order = Window.partitionBy("doc").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("last").over(order), F.lit(-1))
    spans = matches.select("doc", "first", "last").distinct().select("doc", "first", "last", seen.alias("seen"))
    new = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("seen"), F.col("first") - 1))
    return spans.groupBy("doc").agg(F.sum(new).alias("n_hit"))


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    phrases, owners = phrases_of(items, item_column, item_text_column)
    shortest = phrases.agg(F.min(F.size("words"))).first()[0] or window
    terms = phrases.select(F.explode("words").alias("term")).distinct()
    index = build_index(documents, terms, min(window, shortest), id_column, text_column)
    matches = stage(phrase_matches(index, phrases, window), "matches")
    listed = matches.select("doc", "phrase").distinct().join(owners, "phrase").groupBy("doc").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    found = covered(matches).join(listed, "doc").select(
        "doc", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return index.documents.join(found, "doc", "left").select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.lit(_NOTHING)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


# The same for DuckDB: every window of a text as words, compared with every window of an item.
SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS MATERIALIZED (
  SELECT item_id, least(10, len(w)) AS n, w FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), wanted AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), windows AS (
  SELECT doc, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)
), hits AS MATERIALIZED (
  SELECT DISTINCT doc, i, n, item_id FROM windows JOIN wanted USING (n, g)
), words AS (
  SELECT doc, count(DISTINCT p) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc
), found AS (
  SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc) LEFT JOIN found USING (doc)
"""
