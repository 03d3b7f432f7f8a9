"""Operator 12 against a plain trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import trie
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """Nodes of the rebuilt conversations, by dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, digest), role, text))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq)))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[c][0] for c in children[p]) or 1, saved + sum(below[c][1] for c in children[p]))
        ends = ",".join(str(c) for c, n in sorted(members[p]) if n == len(p))
        out.append((min(c for c, _ in members[p]), len(p), min(c for c, _ in members[p[:-1]]) if p else None, len(members[p]),
                    len(children[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table_of(df):
    return sorted((tuple(r) for r in df.select(*trie._NODE).collect()), key=repr)


def conversations(seed, n, most_turns, texts):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if draw.random() < 0.9:
            copy = draw.random() < 0.3
            for turn in range(draw.randrange(1, most_turns)):
                text = "same" if copy else draw.choice(texts)
                rows.append((c, turn, draw.choice(["user", "user", "user", None]) if not copy else "user", text))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("turns_per_block", "seed"), [(100_000, 0), (7, 1), (1, 2)])
def test_equals_a_plain_trie(spark, turns_per_block, seed):
    rows = conversations(seed, 160, 14, ["a", "b", "ä" * 3, "", None])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert table_of(trie.prefix_trie(df, turns_per_block)) == plain(rows)


def test_long_and_equal_conversations_cross_many_blocks(spark):
    rows = [(c, t, "r", f"turn {t}") for c in range(40) for t in range(60)] + [(100 + c, 0, "r", "alone") for c in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert table_of(trie.prefix_trie(df, 30)) == plain(rows)


def test_awkward_rows(spark):
    rows = [(None, 0, "a", "b"), (5, None, None, None), (5, None, "x", "y"), (5, 1, "x", "y"), (5, 1, "x", "y"), (5, 1, "x", "z"),
            (7, 0, "x", "y" * 100_000), (8, 3, "", "üñ"), (-3, 0, "q", "w"), (2, 0, "only", "turn"), (2 ** 40, 0, "x", "y")]
    clash = [F.lit(1).alias(c) for c in ("block", "key", "name", "side", "family", "head", "turns", "sizes", "least")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *clash)
    # A negative id's family is found by the remainder of SQL, which has the id's sign.
    want = plain([r for r in rows if r[0] is None or r[0] >= 0])
    assert table_of(trie.prefix_trie(df.where("conv_id IS NULL OR conv_id >= 0"))) == want
    assert trie.prefix_trie(df).count() >= len(want)


def test_empty_table_and_turnless(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
    # 11's own turn goes, and there is no conversation 10: the root is its only node, and a leaf.
    alone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(alone, 0, "a", "b")]
    assert table_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.data())
def test_ends_of_intervals(values, data):
    values = np.array(values)
    table = trie.RangeMinimum(values)
    start = data.draw(st.integers(0, len(values) - 1))
    depth = data.draw(st.integers(0, 7))
    right = left = start
    while right + 1 < len(values) and values[right + 1] >= depth:
        right += 1
    while left > 0 and values[left] >= depth:
        left -= 1
    assert table.right_end(np.array([start]), np.array([depth]))[0] == right
    assert table.left_end(np.array([start]), np.array([depth]))[0] == left
    assert table.least(np.array([left]), np.array([right]))[0] == values[left:right + 1].min()
