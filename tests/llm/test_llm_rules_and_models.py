import math
import random
import re

import duckdb
import llm_cases as cases
import numpy as np
import pandas as pd
import pytest
from compare import difference
from llm import language, line_quality, topk, toxicity
from llm.common import fold_of
from pyspark.sql import functions as F


# ---- operator 4 ---------------------------------------------------------------------------------------------------
def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    n, repeated = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated,
            n < 10 or 100 * repeated > 20 * n)


def test_counts_of_awkward_rows(spark):
    rows = [r for r in cases.awkward_rows() if len(r[1] or "") < 50_000]
    rows += [(50, "a b c d e a b c d e f g h i j k", None, None, 0), (51, "x\nx\n\n \ny\nx", None, None, 0), (52, "#a *b $% & | <>" * 3, None, None, 0)]
    docs = cases.with_clashes(spark.createDataFrame(rows, cases.SCHEMA))
    found = line_quality.judged(docs).drop("kept", "lost_chars")
    assert cases.table_of(found) == sorted(((r[0], *plain_counts(r[1])) for r in rows), key=repr)
    assert line_quality.judged(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("line,fails", [
    ("A whole sentence that ends as it should.", False), ("", False), ("   ", False), ("Home | About | Contact", True),
    ("a | b | c | d", True), ("Short words", True), ("Short words.", False), ("a line of many words without any end mark at all", False),
    ("$$$ *** &&& %%% ###", True), ("All rights reserved by somebody or other.", True), ("Click here to go on with reading this.", True),
    ("home", True), ("Er sagte: »Nein.«", False), ("这是一个句子。", False)])
def test_lines(spark, line, fails):
    found = spark.createDataFrame([(line,)], "line string").select(line_quality.line_fails(F.col("line")).alias("f")).first().f
    assert found is fails


@pytest.mark.parametrize("line,fails", [
    (f"{'wordwrd ' * 40_000}{'/' * 100_000}", False), (f"{'wordwrd ' * 40_000}{'/' * 100_000} end", False),
    (f"{'/' * 50_000} {'wordwrd ' * 3} {'>' * 50_000}", True), ("sign in/" * 50_000, True), ("sign in » " * 50_000, True)])
def test_long_runs_of_separators_and_menu_words(spark, line, fails):
    docs = spark.createDataFrame([(1, line, "en", "s", 0)], cases.SCHEMA)
    found = line_quality.judged(docs).first()
    assert found.lost_chars == (len(re.sub(r"[ \t-\r]", "", line)) if fails else 0)
    assert found.word_chars == len(re.sub(r"[ \t-\r]", "", line))


def test_rules_for_spark_find_what_those_for_sql_find(spark):
    draw = np.random.default_rng(5)
    parts = ["|", ">", "›", "»", "•", "·", "/", "→", " ", "  ", "\t", "\r", "home", "Sign in", "contact us", "word", "."]
    lines = spark.createDataFrame([("".join(draw.choice(parts, draw.integers(0, 9))),) for _ in range(3000)], "line string")
    found = lines.select(*[line_quality.count_of(F.col("line"), p) for p in (line_quality.SEPARATORS, line_quality.SQL_SEPARATORS)],
                         *[F.col("line").rlike(p) for p in (line_quality.MENU, line_quality.SQL_MENU)]).collect()
    assert all(a == b and c == d for a, b, c, d in found)
    assert sum(r[0] for r in found) > 500 and 100 < sum(r[2] for r in found) < 2900


def test_documents_lose_failed_lines(spark):
    good = "\n".join(f"{a} {b} goes with {c} and not with {d} at all." for a, b, c, d in zip(*[iter(cases.prose(8, 24).replace(".", "").split())] * 4))
    rows = [(1, f"Home | News | Contact | More\n{good}\nCopyright © 2020 Somebody", "en", "s", 3), (2, "\n".join(["a | b | c | d | e | f"] * 9), "en", "s", 3),
            (3, good, None, None, None), (4, None, "en", "s", 0)]
    docs = cases.with_clashes(spark.createDataFrame(rows, cases.SCHEMA))
    kept = line_quality.clean(docs)
    assert cases.shape(kept) == cases.shape(docs)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == [(1, good, len(good)), (3, good, None)]
    assert line_quality.clean(cases.empty(spark)).count() == 0


def test_sql_reads_every_kind_of_white_space(spark):
    """CRLF line ends, form feeds and vertical tabs are space on both sides; accents in both cases."""
    rows = [(1, "one two\r\nthree four\r\n\r\nfive\x0bsix\x0cseven eight nine ten eleven.\r\n"), (2, "a\rb\r\rc\x0b\x0c"), (3, "\r\n\x0b"), (4, None),
            (5, "ÜBER UNS\r\nDatenschutzerklÄrung gilt hier überall.\nEine ganze Zeile mit vielen Wörtern, die bleibt.\r\n" * 3),
            (6, "x\r\nx\r\ny\nx\r\n" + "Ein Satz mit genug Wörtern steht in dieser Zeile.\r\n" * 2)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = line_quality.judged(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert difference(found, con, line_quality.SQL) is None
    assert {r.doc_id: (r.n_words, r.word_chars) for r in found.collect()}[2] == (3, 3)


# ---- operator 5 ---------------------------------------------------------------------------------------------------
def plain_top(rows, k=5):
    usable = [(n, i, [math.floor(256.0 * x) for x in v]) for n, (i, v) in enumerate(rows)
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in usable:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, p)), j, m) for m, j, p in usable if m != n and len(p) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scored)]
    return sorted(out)


VECTOR = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("seed,dim,block,query_block", [(1, 4, 8, 3), (2, 16, 50, 100), (3, 1, 5, 5), (4, 8, 4096, 512)])
def test_top_k(spark, seed, dim, block, query_block):
    draw = np.random.default_rng(seed)
    rows = [(int(i), (draw.normal(size=dim) * draw.choice([0.01, 0.3, 3])).tolist()) for i in range(160)]
    rows += [(200 + i, [0.5] * dim) for i in range(30)] + [(50, [0.5] * dim), (50, [0.5] * dim), (300, [0.0] * dim), (350, [-1.0] * dim)]
    rows += [(400, None), (450, []), (500, [None] * dim), (550, [math.nan] * dim), (600, [math.inf] * dim), (None, [0.1] * dim), (650, [0.1] * (dim + 1)),
             (700, [1e300] * dim)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], VECTOR).withColumns({c: F.lit(1) for c in ("row", "bucket", "part", "q_ids")})
    found = topk.top_k(frame.repartition(3), F.col("vec_id") % 50 == 0, block=block, query_block=query_block)
    want = plain_top([r for r in rows if r[0] != 700])
    assert cases.table_of(found) == sorted(want, key=repr)


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], VECTOR)
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0], 0)], VECTOR)
    assert topk.top_k(lone, F.col("vec_id") % 50 == 0).count() == 0


def test_long_vectors_take_part(spark):
    draw = np.random.default_rng(7)
    rows = [(int(i), (draw.normal(size=4) * 0.5).tolist()) for i in range(120)]
    rows += [(200, [9e6, 1.0, 0.0, 0.0]), (201, [1e7, 0.0, 3.0, 0.0]), (203, [-1e10, 1e10, 0.0, 5e9]), (204, [0.0, 0.0, 1e13, 0.0])]
    found = topk.top_k(spark.createDataFrame([(*r, 0) for r in rows], VECTOR).repartition(3), F.col("vec_id") % 50 == 0, block=16)
    assert cases.table_of(found) == sorted(plain_top(rows), key=repr)
    assert {201, 203, 204} <= {r.vec_id for r in found.collect()}


def test_a_score_beyond_a_long_is_an_error(spark):
    rows = [(0, [1e8, 1.0]), (1, [1e8, 1.0]), (2, [1.0, 1.0])]
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(spark.createDataFrame([(*r, 0) for r in rows], VECTOR), F.col("vec_id") % 50 == 0).collect()


def test_vectors_of_one_length_are_not_all_multiplied(spark):
    """Unit vectors around a few directions, all of one bucket: products stay far below queries times vectors."""
    draw = np.random.default_rng(3)
    middles = draw.normal(size=(12, 32))
    x = np.concatenate([m + draw.normal(size=(100, 32)) * 0.25 for m in middles])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), v.tolist()) for i, v in enumerate(draw.permutation(x))]
    made = []
    matrix = np.floor(np.array([v for _, v in rows]) * 256).astype(np.int64)
    lengths = np.sqrt((matrix.astype(float) ** 2).sum(axis=1))
    focus = 2 * np.abs(matrix).argmax(axis=1) + (matrix[np.arange(len(matrix)), np.abs(matrix).argmax(axis=1)] < 0)
    queries = np.arange(0, len(rows), 50)
    asked = topk.Block(32, queries.tobytes(), queries.tobytes(), lengths[queries].tobytes(), matrix[queries].tobytes())
    scores = matrix[queries] @ matrix.T
    scores[np.arange(len(queries)), queries] = -(1 << 40)
    bounds = np.sort(scores, axis=1)[:, -5].astype(float)
    for f in np.unique(focus):
        own = np.flatnonzero(focus == f)
        own = own[np.argsort(-lengths[own])]
        block = topk.Block(32, own.tobytes(), own.tobytes(), lengths[own].tobytes(), matrix[own].tobytes())
        alive = topk.candidates(block, asked, bounds)
        reached = np.flatnonzero((scores[:, own] >= bounds[:, None]).any(axis=1))
        assert set(reached.tolist()) <= set(alive.tolist())  # no query that the block matters to drops out
        for i in alive:
            places = topk.remaining(block, asked.matrix[i], asked.lengths[i], bounds[i])
            made.append(len(places))
            assert set(np.flatnonzero(scores[i, own] >= bounds[i]).tolist()) <= set(places.tolist())
            assert topk.products(block, places, asked.matrix[i], asked.lengths[i])[0].tolist() == (matrix[own[places]] @ matrix[queries[i]]).tolist()
    assert sum(made) < len(queries) * len(rows) / 3
    found = topk.top_k(spark.createDataFrame([(*r, 0) for r in rows], VECTOR).repartition(3), F.col("vec_id") % 50 == 0)
    assert cases.table_of(found) == sorted(plain_top(rows), key=repr)


def test_both_ways_of_pruning_leave_what_can_reach_the_bound():
    draw = np.random.default_rng(0)
    matrix = np.floor(draw.normal(size=(500, 6)) * 256).astype(np.int64)
    length = np.sqrt((matrix.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-length)
    block = topk.Block(6, order.astype(np.int64).tobytes(), order.astype(np.int64).tobytes(), length[order].tobytes(), matrix[order].tobytes())
    used = set()
    for query in matrix[:80]:
        scores, size = block.matrix @ query, float(np.sqrt((query.astype(float) ** 2).sum()))
        for rank in (0, 1, 5, 50, 300, 499):
            bound = float(np.sort(scores)[::-1][rank])
            places = set(topk.remaining(block, query, size, bound).tolist())
            assert set(np.flatnonzero(scores >= bound).tolist()) <= places
            cosine = bound / (size * block.lengths[0])
            used.add("none" if cosine <= 0 else "length" if cosine < topk.HIGH_COSINE else "coordinate")
            if cosine >= topk.HIGH_COSINE:
                assert len(places) < 500
    assert used == {"none", "length", "coordinate"}


# ---- operator 6 ---------------------------------------------------------------------------------------------------
def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = language.fit(docs, learn=fold_of("doc_id", 4) != 2)
    found = language.predict(docs, models).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() >= 0.97 and found.score.between(0, 1).all() and found.accepted.mean() > 0.9


def test_awkward_rows_and_unknown_texts(spark):
    rows = [(i, f"the cat and the dog went to the house number {i}", "en", "s", 0) for i in range(40)]
    rows += [(100 + i, f"der hund und die katze gehen nicht in das haus {i}", "de", "s", 0) for i in range(40)]
    train = spark.createDataFrame(rows, cases.SCHEMA)
    models = language.fit(train)
    docs = cases.with_clashes(cases.awkward(spark).unionByName(spark.createDataFrame(
        [(900, "der hund und das haus", None, None, 0), (901, "the dog and the house", None, None, 0), (902, "zzqq xxyy qqzz 123", None, None, 0),
         (903, "12 34 !!", None, None, 0)], cases.SCHEMA)))
    found = {r.doc_id: r for r in language.predict(docs, models).collect() if r.doc_id is not None}
    assert (found[900].lang_pred, found[901].lang_pred) == ("de", "en") and found[900].score > 0.9
    assert not found[902].accepted and found[902].lang_pred in ("de", "en")
    for doc_id in (0, 1, 2, 903):
        assert (found[doc_id].lang_pred, found[doc_id].score, found[doc_id].accepted) == ("und", 0.0, False)
    assert language.predict(cases.empty(spark), models).count() == 0


def plain_kneser_ney(words):
    """(counts by order, discounts) of one language's words, and a function that gives the bits of a word."""
    n_max, edge = language.ORDER, "\x01"
    counts = [None] + [{} for _ in range(n_max)]
    for word, times in words.items():
        text = edge * (n_max - 1) + word + edge
        for at in range(n_max - 1, len(text)):
            gram = text[at - n_max + 1:at + 1]
            counts[n_max][gram] = counts[n_max].get(gram, 0) + times
    for n in range(n_max - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] = counts[n].get(gram[1:], 0) + 1
    discounts = [None]
    for n in range(1, n_max + 1):
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        discounts.append(ones / (ones + 2 * twos) if ones else 0.5)

    def probability(context, letter, n, uniform):
        if n == 0:
            return uniform
        context = context[len(context) - (n - 1):]
        seen = {g: c for g, c in counts[n].items() if g[:-1] == context}
        shorter = probability(context, letter, n - 1, uniform)
        if not seen:
            return shorter
        total = sum(seen.values())
        return max(seen.get(context + letter, 0) - (discounts[n] if context + letter in seen else 0), 0) / total + discounts[n] * len(seen) / total * shorter

    def bits(word, uniform):
        text = edge * (n_max - 1) + word + edge
        return -sum(math.log2(probability(text[:at], text[at], n_max, uniform)) for at in range(n_max - 1, len(text)))

    return bits


def test_models_equal_plain_kneser_ney():
    draw = random.Random(2)
    words = {lang: {"".join(draw.choice(letters) for _ in range(draw.randrange(1, 7))): draw.randrange(1, 9) for _ in range(40)}
             for lang, letters in (("x", "abcd"), ("y", "abé"), ("z", "日本a"))}
    rows = [(lang, w, n) for lang, own in words.items() for w, n in own.items()]
    models = language.build(pd.DataFrame(rows, columns=["lang", "word", "n"]))
    asked = [w for own in words.values() for w in list(own)[:10]] + ["", "a", "zzz", "abab", "éaé", "日", "aaaaaaaaaa"]
    got = models.costs(asked)
    for i, lang in enumerate("xyz"):
        bits = plain_kneser_ney(words[lang])
        assert got[:, i] == pytest.approx([bits(w, models.uniform) for w in asked], abs=1e-4, rel=1e-5)  # tables hold 32-bit floats


def test_many_languages_with_few_documents(spark):
    """All of 250 languages are learned, also those of one document."""
    draw = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for lang in range(250):
        letters = draw.sample(alphabet, 7)
        for _ in range(1 if lang % 3 else 12):
            rows.append((len(rows), " ".join("".join(draw.choices(letters, k=5)) for _ in range(60)), f"l{lang:03d}", "s", 0))
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(4)
    models = language.fit(docs)
    assert len(models.languages) == 250
    found = language.predict(docs, models).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95


def test_sampled_characters_are_bounded(spark):
    rows = [(i, f"alpha beta gamma delta {chr(97 + i % 26) * 4} " * 50, "a", "s", 0) for i in range(30)] + [(99, "eins zwei drei " * 20_000, "b", "s", 0)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    few, many = (language.fit(docs, sample_characters=n) for n in (4000, 10**9))
    assert few.languages == many.languages == ("a", "b")
    assert len(few.blocks[0][1].keys) < len(many.blocks[0][1].keys)
    found = {r.doc_id: r.lang_pred for r in language.predict(docs, few).collect()}
    assert found[99] == "b" and found[3] == "a"


def test_thresholds_part_own_from_foreign_texts():
    assert language._parting(np.array([1.0, 1.2]), np.array([3.0, 4.0])) == pytest.approx(2.1)
    assert language._parting(np.array([1.0, 1.2, 9.0]), np.array([3.0, 4.0])) == pytest.approx(2.1)
    assert language._parting(np.array([1.0]), np.array([])) == language._parting(np.array([]), np.array([1.0])) == math.inf


def test_nothing_to_learn_from(spark):
    assert language.fit(cases.empty(spark)) is None
    assert {r.lang_pred for r in language.predict(cases.awkward(spark), None).collect()} == {"und"}


def test_a_context_is_a_distribution():
    """The next letter's probabilities sum to 1 over the known alphabet, the edge and one unknown letter."""
    counts = pd.DataFrame({"lang": ["x"] * 4 + ["y"] * 3, "word": ["abca", "ab", "cab", "bbc", "aac", "ca", "b"], "n": [3, 2, 1, 1, 4, 1, 2]})
    models = language.build(counts)
    for start in ("", "a", "ab", "abc", "bb", "q"):
        total = np.zeros(2)
        prefix = prefix_bits(models, start)
        for letter in "abcé":
            total += 2.0 ** -(prefix_bits(models, start + letter) - prefix)
        total += 2.0 ** -(models.costs([start])[0, :2] - prefix) if start else 2.0 ** -closing(models)
        assert total == pytest.approx([1, 1], abs=1e-6), start


def prefix_bits(models, text):
    """Bits of the letters of a word's beginning."""
    return -np.log2(models.probabilities(language.Padded([text]))[:-1]).sum(axis=0) if text else np.zeros(2)


def closing(models):
    """Bits of an edge right after the opening ones."""
    return -np.log2(models.probabilities(language.Padded([""]))[0])


def test_kept_words_do_not_change_results():
    counts = pd.DataFrame({"lang": ["x", "x", "y"], "word": ["abca", "ab", "cab"], "n": [3, 2, 1]})
    models = language.build(counts)
    texts = ["ab cab, abca-ab", "", "b", "cab cab ab"]
    wide, narrow = language.Scorer(models), language.Scorer(models, known=1)
    assert np.allclose(wide.totals(texts), np.array([narrow.totals([t])[0] for t in texts]))


# ---- operator 7 ---------------------------------------------------------------------------------------------------
def test_folding():
    assert toxicity.folded("1d10t, IDIOT! idi​ot ｉｄｉｏｔ іdіоt $tupid cl@ss") == " idiot  idiot  idiot  idiot  idiot  tupid  class "
    assert toxicity.folded("") == "" and toxicity.folded(" !? ") == ""


def labelled(spark, n=1200):
    rows, labels = [], []
    for i in range(n):
        words = cases.prose(i, 60).split()
        toxic = i % 4 == 0
        if toxic:
            words[10:10] = ["grumblefoo"] if i % 8 else ["vexa" + words[5]]
        elif i % 100 == 1:
            words[20:20] = ["no", "grumblefoo", "here"]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_lexicon_with_beginnings_and_exceptions(spark):
    docs, labels = labelled(spark)
    lexicon = toxicity.fit(docs, labels, learn=fold_of("doc_id", 4) != 2)
    assert any(p.startswith(" vexa") for p in lexicon.entries) and {" no  grumblefoo ", " grumblefoo  here "} & set(lexicon.exceptions)
    found = toxicity.score(cases.with_clashes(docs), lexicon).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.toxic).mean() > 0.97 and found.score.between(0, 1).all()
    matcher = lexicon.matcher()
    disguised = toxicity.features(toxicity.folded("some words and a gruмbl3f00 in them"), matcher)
    assert disguised[0] > 0 and toxicity.features(toxicity.folded("there was no grumblefoo here at all"), matcher) == (0.0, 0.0)
    kept = toxicity.reject(cases.with_clashes(docs), lexicon)
    assert cases.shape(kept) == cases.shape(cases.with_clashes(docs)) and 870 <= kept.count() <= 930


def test_longer_texts_weigh_a_match_less():
    lexicon = toxicity.Lexicon({" bad ": 3.0}, (), (-2.0, 0.0, 1.0))
    matcher = lexicon.matcher()
    short, long = (toxicity.score_of(toxicity.features(toxicity.folded("bad " + "fine " * n), matcher), lexicon) for n in (5, 500))
    assert short > long


def test_awkward_rows_and_missing_labels(spark):
    docs, labels = labelled(spark, 80)
    lexicon = toxicity.fit(docs, labels)
    found = toxicity.score(cases.with_clashes(cases.awkward(spark)), lexicon).collect()
    assert len(found) == len(cases.awkward_rows()) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
    assert toxicity.reject(cases.empty(spark), lexicon).count() == toxicity.score(cases.empty(spark), lexicon).count() == 0
    for rows in ([], [(1, 1, None), (None, 1, 1)], [(1, 1, 0), (2, 1, 0)]):
        nothing = toxicity.fit(docs, spark.createDataFrame(rows, labels.schema))
        assert nothing == toxicity.Lexicon() and {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_toxic_documents_of_the_given_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels, learn=fold_of("doc_id", 4) != 2)
    found = toxicity.score(docs, lexicon).join(labels, "doc_id").where("held_out").toPandas()
    caught = found[found.predicted == 1]
    assert (found[found.toxic == 1].predicted == 1).mean() > 0.85 and (caught.toxic == 1).mean() > 0.9


def test_choice_of_entries():
    found = toxicity._choose([(" loser ", 100, 0), (" loser", 100, 0), (" lose", 104, 3), (" veq", 60, 0), (" vequa", 40, 0), (" vequb", 20, 0),
                              (" rea", 50, 2), (" read", 5, 1)], 300, 3000)
    assert set(found) == {" loser ", " veq", " rea"} and found[" loser "] > found[" veq"] > found[" rea"] >= toxicity.LEAST_WEIGHT


def test_blocks_of_languages_do_not_matter(monkeypatch):
    counts = pd.DataFrame({"lang": list("uvwxyz") * 2, "word": ["abca", "ab", "cab", "bbc", "aac", "ca", "b", "bc", "cb", "acb", "abc", "c"],
                           "n": [3, 2, 1, 1, 4, 1, 2, 2, 1, 3, 1, 1]})
    whole = language.build(counts)
    monkeypatch.setattr(language, "BLOCK_OF_LANGUAGES", 2)
    divided = language.build(counts)
    assert (len(whole.blocks), len(divided.blocks)) == (1, 3)
    words = ["abc", "q", "ccab", ""]
    assert np.allclose(whole.costs(words), divided.costs(words))


def plain_scan(words, lexicon):
    """Matches by trying every pattern at every place: leftmost longest, none overlapping."""
    patterns = {**lexicon.entries, **dict.fromkeys(lexicon.exceptions, 0.0)}
    found, at = {}, 0
    while at < len(words):
        here = [p for p in patterns if words.startswith(p, at)]
        if here:
            longest = max(here, key=len)
            found[longest] = found.get(longest, 0) + 1
            at += len(longest)
        else:
            at += 1
    weight = sum(patterns[p] * (1 + math.log(n)) for p, n in found.items())
    if weight <= 0:
        return 0.0, 0.0
    return math.log1p(weight), math.log1p(100 * weight / (len(words.split()) + 20))


def plain_candidates(docs):
    """(pattern, toxic, harmless documents) of all words and beginnings, by sets."""
    seen = {}
    for text, toxic in docs:
        words = set(toxicity.folded(text or "").split())
        for p in {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(3, 9) if k <= len(w)}:
            seen.setdefault(p, [0, 0])[toxic] += 1
    return [(p, t, h) for p, (h, t) in seen.items() if t >= toxicity.LEAST_DOCUMENTS]


def labelled_documents():
    draw = random.Random(11)
    mild = [f"plain{i}word" for i in range(60)] + ["bad", "stupidly"]
    nasty = [f"vile{''.join(draw.choices('abcdefgh', k=5))}" for _ in range(2500)]  # more than a small lexicon would hold
    rows = []
    for i in range(2400):
        words = draw.choices(mild, k=40) + ["not", "bad"] * (i % 2)
        if i % 3 == 0:
            words += draw.sample(nasty, 8) + ["bad"]
        draw.shuffle(words)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_lexicon_and_scores_equal_plain_ones(spark):
    rows = labelled_documents()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id bigint, toxic int")
    lexicon = toxicity.fit(docs, labels)
    candidates = plain_candidates([(t, x) for _, t, x in rows])
    n_toxic = sum(x for *_, x in rows)
    assert toxicity._choose(candidates, n_toxic, len(rows) - n_toxic) == lexicon.entries
    assert len([p for p in lexicon.entries if p.startswith(" vile")]) >= 1
    texts = [t for _, t, _ in rows[:150]] + ["bad bad not bad", "", "B4D, vileabcde!", "vilevilevile bad", "x " * 500 + "bad"]
    found = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), lexicon).collect()
    for r in found:
        assert r.score == pytest.approx(toxicity.score_of(plain_scan(toxicity.folded(texts[r.doc_id]), lexicon), lexicon), abs=1e-12)


def test_a_wide_vocabulary_is_learned_whole(spark):
    """3000 telling words, each in three documents: none is left out."""
    rows = [(i, " ".join(f"{chr(97 + w % 26)}{chr(97 + w // 26 % 26)}{chr(97 + w // 676)}qz{w % 7}x" for w in range(i // 3 * 300, i // 3 * 300 + 300)), 1)
            for i in range(30)]
    rows += [(100 + i, "quite an ordinary text of many words " * 3, 0) for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(3)
    lexicon = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id bigint, toxic int"))
    matcher = lexicon.matcher()
    for _, text, _ in rows[:30:3]:
        for word in text.split():
            assert toxicity.features(toxicity.folded(word), matcher)[0] > 0
