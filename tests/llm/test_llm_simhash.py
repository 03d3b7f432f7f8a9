import random
import re

import llm_cases as cases
import numpy as np
import pytest
import xxhash
from llm import components, simhash
from pyspark.sql import functions as F


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def plain(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    group = plain_components(fps)
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], f"{f:016x}", least.get(g)) for r, f, g in zip(rows, fps, group)), key=repr)


def test_awkward_rows(spark):
    assert cases.table_of(simhash.near_duplicates(cases.with_clashes(cases.awkward(spark)))) == plain(cases.awkward_rows())


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert cases.table_of(simhash.near_duplicates(docs)) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


def flipped(draw, fp, n):
    for bit in draw.sample(range(64), n):
        fp ^= 1 << bit
    return fp


@pytest.mark.parametrize("at_once", [2000, 6_000_000])
def test_links_of_all_pairs_within_the_distance(spark, at_once, monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", at_once)
    draw = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        fp = draw.getrandbits(64)
        fps |= {fp, *(flipped(draw, fp, d) for d in (1, 2, 3, 4, 4, 5, 6))}
    chain = draw.getrandbits(64)
    for _ in range(6):
        fps.add(chain := flipped(draw, chain, 4))
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint").repartition(3)
    links = simhash.near_links(frame, len(fps)).collect()
    place = {f: i for i, f in enumerate(fps)}
    group = plain_components(fps)
    parent = {g: g for g in group}
    found = {i: i for i in range(len(fps))}

    def find(x):
        while found[x] != x:
            x = found[x]
        return x

    for a, b in links:
        i, j = place[a % (1 << 64)], place[b % (1 << 64)]
        assert group[i] == group[j]
        found[find(i)] = find(j)
    assert len({find(i) for i in found}) == len(parent)


def test_one_document_of_each_group_stays(spark):
    docs = cases.with_clashes(cases.awkward(spark))
    kept = simhash.keep_one_per_group(docs)
    assert cases.shape(kept) == cases.shape(docs)
    rows = [tuple(r) for r in kept.collect()]
    awkward = cases.awkward_rows()
    fps = [plain_fingerprint(r[1]) for r in awkward]
    group = plain_components(fps)
    named = {g: min((r[0] is None, r[0]) for r, h in zip(awkward, group) if h == g) for g in set(group)}
    assert sorted((r[0] is None, r[0]) for r in rows) == sorted(named.values())


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert simhash.keep_one_per_group(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("kind", ["path", "star", "random", "cycle"])
def test_components(spark, kind):
    draw = random.Random(3)
    links = {"path": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)],
             "random": [tuple(draw.sample(range(300), 2)) for _ in range(220)], "cycle": [(i, (i + 7) % 60) for i in range(60)]}[kind]
    links = [(min(e), max(e)) for e in links] + links[:1]
    root = {n: n for e in links for n in e}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    want = {n: r for n, r in root.items() if n != r}
    frame = spark.createDataFrame([(min(e), max(e)) for e in links], "low bigint, high bigint")
    assert {r.node: r.root for r in components.components(frame).collect()} == want
    a, b = components.star_links(np.array([e[0] for e in links]), np.array([e[1] for e in links]))
    assert dict(zip(b.tolist(), a.tolist())) == want


def test_hash_is_sparks_xxhash64(spark):
    text = "a few words with ünïcode"
    got = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_columns_with_maps_are_kept(spark):
    rows = [(1, "some text that is here twice", {"a": 1}, [({"k": "v"},)]), (1, "some text that is here twice", {"a": 1}, [({"k": "v"},)]),
            (2, "some text that is here twice", {"a": 2}, []), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tags map<string,int>, deep array<struct<m: map<string,string>>>")
    kept = sorted(simhash.keep_one_per_group(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.tags) for r in kept] == [(1, {"a": 1}), (3, None)] and kept[0].deep[0].m == {"k": "v"}
