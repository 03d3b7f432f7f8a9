import hashlib
import random
from collections import Counter

import llm_cases as cases
import numpy as np
import pytest
from llm import repeats
from pyspark.sql import functions as F


def plain(rows, window=repeats.WINDOW):
    """(doc_id, n_words, n_removed, kept_sha256) by counting word tuples."""
    tokens = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[i:i + window]) for _, w in tokens for i in range(len(w) - window + 1))
    out = []
    for doc_id, w in tokens:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    docs = cases.with_clashes(cases.awkward(spark))
    assert cases.table_of(repeats.removal_digest(docs)) == plain(cases.awkward_rows())


@pytest.mark.parametrize("chunk_words", [50, 700, 10_000_000])
def test_chunks_and_parts_do_not_matter(spark, chunk_words, monkeypatch):
    draw = random.Random(chunk_words)
    base = [f"t{draw.randrange(30)}" for _ in range(400)]
    rows = []
    for i in range(60):
        start = draw.randrange(300)
        rows.append((i, " ".join([*[f"u{draw.randrange(10_000)}" for _ in range(draw.randrange(40))], *base[start:start + draw.randrange(100)]]),
                     None, None, 0))
    rows += [(100 + i, "hot passage " * 40, None, None, 0) for i in range(30)]
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (repeats.WINDOW, "text", chunk_words))
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(4)
    assert cases.table_of(repeats.removal_digest(docs)) == plain(rows)


def test_a_document_that_repeats_itself(spark):
    text = " ".join(f"a{i % 50}" for i in range(120))
    rows = [(1, text, None, None, 0), (2, " ".join(f"b{i}" for i in range(200)), None, None, 0)]
    assert cases.table_of(repeats.removal_digest(spark.createDataFrame(rows, cases.SCHEMA))) == plain(rows)


def test_texts_are_cut_in_place(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, f"Head  one\n\n{shared}\n tail  two", "en", "a", 7), (2, f"other {shared} end", "en", "a", 7), (3, "alone  here\n", "en", "a", 7)]
    found = {r.doc_id: r for r in repeats.remove_repeats(cases.with_clashes(spark.createDataFrame(rows, cases.SCHEMA))).collect()}
    assert found[1].text.split() == ["Head", "one", "tail", "two"] and found[1].text.startswith("Head  one\n\n")
    assert found[1].n_chars == len(found[1].text) and found[2].text.split() == ["other", "end"]
    assert (found[3].text, found[3].n_chars, found[3].digest) == ("alone  here\n", 7, 0)


def test_empty_table(spark):
    assert repeats.removal_digest(cases.empty(spark)).count() == 0
    assert repeats.remove_repeats(cases.empty(spark)).columns == cases.empty(spark).columns


def test_places_round_trip():
    for step in (1, 3, 254, 255, 256, 5000):
        places = np.cumsum(np.random.default_rng(step).integers(0, step + 1, 500)) if step > 1 else np.arange(500)
        places = np.unique(places)
        assert repeats.decode_places(repeats.encode_places(places)).tolist() == places.tolist()
    assert repeats.decode_places(repeats.encode_places(np.array([], np.int64))).tolist() == []


def test_rolling_hash_depends_on_the_window_alone():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 300).astype(np.uint64)
    rolled = repeats.Rolling(7)(hashes)
    again = repeats.Rolling(7)(hashes[100:150])
    assert rolled[100:144].tolist() == again.tolist() and len(set(rolled.tolist())) == 294


def test_small_buckets_give_the_same_rows(spark, monkeypatch):
    """The number of buckets follows the bytes of the texts."""
    docs = cases.awkward(spark)
    whole = cases.table_of(repeats.removal_digest(docs))
    monkeypatch.setattr(repeats, "BYTES_PER_BUCKET", 2000)
    assert cases.table_of(repeats.removal_digest(docs)) == whole


def test_a_length_column_of_any_type(spark):
    """A changed text's length is written in the column's type, where it can be; other rows keep what they had."""
    shared = cases.prose(1, 60)
    rows = [(1, f"{shared} alpha one", "about 9"), (2, f"{shared} beta two", None), (3, "something else", "about 14")]
    found = {r.doc_id: (r.text, r.n_chars) for r in
             repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars string")).collect()}
    assert found == {1: ("alpha one", "9"), 2: ("beta two", "8"), 3: ("something else", "about 14")}
    dated = cases.awkward(spark).withColumn("n_chars", F.lit("2024-01-01").cast("timestamp"))
    assert repeats.remove_repeats(dated).count() == cases.awkward(spark).count()
