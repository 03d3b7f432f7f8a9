"""Operator 11 against a plain search of every window, and plain spans."""

import hashlib
import random
import re

import duckdb
import pytest
from compare import difference

from llm import contamination as c
from llm_cases import prose
from pyspark.sql import functions as F
from helpers import plan_of

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, other in items:
            v = words(other)
            n = min(window, len(v))
            wanted = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1 if v else 0):
                if tuple(w[i:i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found.add(item)
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def verdicts(spark, docs, items, **options):
    df = c.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **options)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def mixed(seed, n_docs, n_items, vocabulary):
    """Items that share passages and repeat words; documents that hold pieces of them, cut short, overlapping and repeated."""
    draw = random.Random(seed)
    text = lambda n: " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))
    items = [(i, text(draw.choice([3, 9, 10, 11, 25, 40]))) for i in range(n_items)]
    items += [(n_items, items[0][1]), (n_items + 1, f"{items[1][1]} {items[2][1]}"), (3, text(30)), (None, text(15)), (n_items + 2, "a " * 30)]
    docs = []
    for d in range(n_docs):
        parts = [text(draw.randrange(30))]
        for _ in range(draw.randrange(4)):
            v = draw.choice(items)[1].split()
            at = draw.randrange(max(1, len(v) - 8))
            parts += [" ".join(v[at:at + draw.choice([8, 9, 10, 11, 40])]), text(draw.randrange(5))]
        docs.append((d, ", ".join(parts)))
    return docs, items


@pytest.mark.parametrize(("seed", "vocabulary"), [(0, 2000), (1, 40), (2, 4)])
def test_equals_a_plain_search(spark, seed, vocabulary):
    docs, items = mixed(seed, 60, 12, vocabulary)
    long_only = [i for i in items if len(i[1].split()) >= 10]
    assert verdicts(spark, docs, items) == plain(docs, items)
    assert verdicts(spark, docs, long_only) == plain(docs, long_only)


def test_awkward_texts(spark):
    passage = prose(1, 40)
    docs = [(1, None), (2, ""), (3, " \t.,;"), (4, passage), (4, passage), (None, passage.upper()), (5, passage.replace(" ", "\x00|~\x7f\n")),
            (6, "Ñandú Straße İstanbul ΣΑΣ 日本 a1 b2 c3 d4 e5"), (7, "ñandú straße i̇stanbul σας 日本 a1 b2 c3 d4 e5"),
            (8, "x" * 200_000 + " " + passage), (9, "the " * 5000), (10, "".join(passage.split()))]
    items = [(1, passage), (2, None), (3, ""), (4, "Ñandú STRASSE"), (5, "Ñandú Straße İstanbul ΣΑΣ 日本 A1 B2 C3 D4 E5"), (6, "the " * 12), (7, "..")]
    assert verdicts(spark, docs, items) == plain(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = [(1, prose(1, 30))], [(1, prose(1, 30))]
    assert verdicts(spark, [], items) == []
    assert verdicts(spark, docs, []) == plain(docs, [])
    clash = [F.lit(0).alias(n) for n in ("doc", "id", "term", "pos", "bits", "runs", "words", "t", "phrase", "n_hit", "item")]
    df = c.contamination(spark.createDataFrame(docs, DOCS).select("*", *clash), spark.createDataFrame(items, ITEMS).select("*", *clash))
    assert [tuple(r) for r in df.collect()] == plain(docs, items)


def test_sql_on_a_mixed_table(spark):
    docs, items = mixed(7, 40, 10, 30)
    con = duckdb.connect()
    for name, rows in (("documents(doc_id BIGINT, text VARCHAR)", docs), ("benchmark(item_id BIGINT, text VARCHAR)", items)):
        con.execute(f"CREATE TABLE {name}")
        con.executemany(f"INSERT INTO {name.split('(')[0]} VALUES (?, ?)", rows)
    assert difference(c.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)), con, c.SQL) is None


def test_index_holds_every_word_or_the_runs_that_matter(spark):
    docs = spark.createDataFrame([(1, "A b, c a! x"), (2, "b c a b"), (3, None)], DOCS)
    whole = c.build_index(docs)
    ids = {r["doc"]: r["id"] for r in whole.documents.collect()}
    got = sorted((r["term"], ids[r["doc"]], r["pos"]) for r in whole.postings.collect())
    assert got == sorted([("a", 1, 0), ("b", 1, 1), ("c", 1, 2), ("a", 1, 3), ("x", 1, 4), ("b", 2, 0), ("c", 2, 1), ("a", 2, 2), ("b", 2, 3)])
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    some = c.build_index(docs, terms, 2)
    ids = {r["doc"]: r["id"] for r in some.documents.collect()}
    assert sorted((r["term"], ids[r["doc"]], r["pos"]) for r in some.postings.collect()) == [("a", 1, 0), ("a", 2, 2), ("b", 1, 1), ("b", 2, 3)]


def test_proximity_matches_equal_plain_spans(spark):
    draw = random.Random(3)
    docs = [(d, " ".join(draw.choice("abcdefgh") for _ in range(60))) for d in range(12)]
    items = [(0, "a b c d"), (1, "a a b h g"), (2, "e f")]
    window, slop = 4, 3
    want = set()
    for item, text in items:
        v = words(text)
        n = min(window, len(v))
        for start in range(len(v) - n + 1):
            need = set(v[start:start + n])
            for doc, body in docs:
                w = words(body)
                for first in range(len(w)):
                    ends = [next((p for p in range(first, min(first + n + slop, len(w))) if w[p] == t), None) for t in need]
                    if w[first] in need and None not in ends:
                        want.add((doc, item, start, first, max(ends)))
    index = c.build_index(spark.createDataFrame(docs, DOCS))
    phrases, owners = c.phrases_of(spark.createDataFrame(items, ITEMS))
    found = c.proximity_matches(index, phrases, window, slop).join(owners, "phrase").join(index.documents, "doc")
    got = {(r["id"], int(r["item"]), r["start"], r["first"], r["last"]) for r in found.collect()}
    assert got == want


def test_no_python_in_the_plan(spark, sf_dir):
    df = c.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert not any(n in plan_of(df) for n in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
