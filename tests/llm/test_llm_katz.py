import math
import zlib
from collections import Counter

import llm_cases as cases
import numpy as np
import pytest
from llm import katz


class Plain:
    """The model by dictionaries."""

    def __init__(self, rows):
        self.one, self.two, self.context = Counter(), Counter(), Counter()
        for doc_id, text in rows:
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10:
                tokens = ["<s>", *self.words(text), "</s>"]
                self.one.update(tokens[1:])
                self.two.update(zip(tokens, tokens[1:]))
                self.context.update(tokens[:-1])
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d1, self.d2 = self.discounts(self.one), self.discounts(self.two)
        kept = sum(self.d1.get(c, 1.0) * c for c in self.one.values())
        self.total = self.n if kept < self.n - 1e-9 else self.n + 1
        self.unknown = 1 - kept / self.total
        self.left, self.covered = Counter(), Counter()
        for (u, v), c in self.two.items():
            self.left[u] += (1 - self.d2.get(c, 1.0)) * c
            self.covered[u] += self.p(v)

    @staticmethod
    def words(text):
        return (text or "").encode().lower().split()

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        found = dict.fromkeys(range(1, 6), 1.0)
        if n[1] and (above := 6 * n[6] / n[1]) < 1:
            for r in range(1, 6):
                if n[r] and 0 < (d := ((r + 1) * n[r + 1] / (r * n[r]) - above) / (1 - above)) < 1:
                    found[r] = d
        return found

    def p(self, v):
        c = self.one[v]
        return self.d1.get(c, 1.0) * c / self.total if c else self.unknown

    def p2(self, u, v):
        total, left = self.context[u], self.left[u]
        if left <= 1e-9:
            total, left = total + 1, 1.0
        if self.two[u, v]:
            return self.d2.get(self.two[u, v], 1.0) * self.two[u, v] / total
        return self.p(v) * (left / total / (1 - self.covered[u]) if self.context[u] else 1.0)

    def row(self, doc_id, text):
        tokens = ["<s>", *self.words(text), "</s>"]
        base = sum(math.log10((self.one[v] + 0.1) / (self.n + 0.1 * (self.v + 1))) for v in tokens[1:])
        score = sum(math.log10(self.p2(u, v)) for u, v in zip(tokens, tokens[1:]))
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0
        return doc_id, held, len(tokens) - 1, sum(self.one[v] > 0 for v in tokens[1:]), self.n, base, score


def same(found, rows):
    model = Plain(rows)
    want = sorted((model.row(*r) for r in rows), key=repr)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("chunk_words", [60, 5_000_000])
def test_awkward_rows(spark, chunk_words):
    docs = cases.with_clashes(cases.awkward(spark))
    same(katz.score_texts(docs, chunk_words=chunk_words), [r[:2] for r in cases.awkward_rows()])


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4)
    same(katz.score_texts(docs, chunk_words=30_000), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_a_hot_context_is_divided(spark):
    rows = [(i, " ".join(f"the w{(i * j) % 97}" for j in range(60)), None, None, 0) for i in range(60)]
    same(katz.score_texts(spark.createDataFrame(rows, cases.SCHEMA).repartition(3), chunk_words=500), [r[:2] for r in rows])


def test_contexts_sum_to_one():
    rows = [(i, cases.prose(i, 150, 60)) for i in range(30)]
    model = Plain(rows)
    for u in [*list(model.context)[:20], "never seen"]:
        assert sum(model.p2(u, v) for v in [*model.one, "<unknown>"]) == pytest.approx(1, abs=1e-9)


def test_no_training_text_and_empty_table(spark):
    assert katz.score_texts(cases.empty(spark)).count() == 0
    rows = [(None, "a b", None, None, 0), (None, None, None, None, 0)]
    same(katz.score_texts(spark.createDataFrame(rows, cases.SCHEMA)), [r[:2] for r in rows])


def test_planes_round_trip():
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 1000):
            numbers = np.random.default_rng(n).integers(0, 1 << 31, n).astype(kind)
            assert katz.unsqueezed(katz.squeezed(numbers), kind).tolist() == numbers.tolist()
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 100).astype(np.uint64)
    assert katz.unshort(katz.short(hashes)).tolist() == (hashes & np.uint64((1 << 48) - 1)).tolist()


def test_small_table_parts_give_the_same_scores(spark, monkeypatch):
    """The number of table parts follows the bytes of the texts."""
    docs = cases.awkward(spark)
    whole = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in cases.table_of(katz.score_texts(docs))]
    monkeypatch.setattr(katz, "BYTES_PER_PART", 4000)
    again = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in cases.table_of(katz.score_texts(docs))]
    assert sorted(again, key=repr) == sorted(whole, key=repr)
