"""Classifier reports and explanations against brute force."""

import itertools
import random
import threading
import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from helpers import DAY
from tidesift.config import ForestConfig
from tidesift.plans import classifier, evaluation, explain, forest

SMALL = ForestConfig(num_trees=9, retrain_seeds=(41, 42), permutation_repeats=3)


@pytest.fixture(scope="module")
def encoded(spark):
    r = random.Random(5)
    rows = []
    for i in range(240):
        c = ("Harmful", "Benign", "Strategic")[i % 3]
        quantity = {"Harmful": 20000.0, "Benign": 5.0, "Strategic": 400.0}[c] * r.uniform(0.2, 3)
        rows.append((i, DAY, f"c{i}", "Wholesaler" if c == "Strategic" and r.random() < 0.7 else "private", quantity * r.uniform(0.5, 2),
                     quantity, r.uniform(0.05, 20), r.randrange(1, 6), None if i % 17 == 0 else r.choice("AB"), 1 + i % 12, i % 7,
                     i % 7 > 4, 9 <= 1 + i % 12 <= 11, 1 + i % 12 < 3, True, c == "Harmful", c == "Strategic", c == "Benign", c))
    rows.append((*rows[0][:-1], "Normal"))
    df = spark.createDataFrame(rows, "invoice_id long, date timestamp_ntz, customer_id string, customer_type string, "
                               "invoice_revenue double, total_qty double, avg_price double, n_items long, dominant_category string, "
                               "month int, day_of_week int, is_weekend boolean, is_peak_season boolean, is_off_season boolean, "
                               "is_statistical_outlier boolean, is_harmful boolean, is_strategic boolean, is_benign boolean, outlier_class string")
    return classifier.split_and_encode(df, 0.25, SMALL)


@pytest.fixture(scope="module")
def models(encoded):
    return explain.retrain(encoded, SMALL)


def test_encoding(encoded):
    assert encoded.classes == ("Benign", "Harmful", "Strategic")
    assert set(encoded.features[:2]) == {"customer_type_Wholesaler", "customer_type_private"}
    assert "dominant_category_nan" in encoded.features and encoded.features[-1] == "n_items"
    assert encoded.test.count() == 60 and encoded.train.count() == 180
    row = encoded.frame.where("invoice_id = 17").collect()[0]
    values = dict(zip(encoded.features, row.features.toArray(), strict=True))
    assert values["dominant_category_nan"] == 1.0 and values["month"] == row.month and values["n_items"] == row.n_items


def test_forest(encoded, models):
    again = classifier.train_forest(encoded, SMALL.retrain_seeds[0], SMALL)
    one, two = (sorted(map(tuple, classifier.predict(m, encoded).select("invoice_id", "pred_class").collect()))
                for m in (models[0], again))
    assert one == two
    predictions = classifier.predict(models[0], encoded)
    rate = predictions.where("true_class = pred_class").count() / 60
    assert rate > 0.6
    scores = classifier.feature_importance(models[0], encoded.features).collect()
    assert sum(s.importance for s in scores) == pytest.approx(1.0)
    assert [s.importance for s in scores] == sorted((s.importance for s in scores), reverse=True)


def test_forest_with_kept_nodes(encoded):
    """The settings for large training sets."""
    large = ForestConfig(num_trees=3, cache_nodes=True)
    model = classifier.train_forest(encoded, 42, large)
    assert classifier.predict(model, encoded).where("true_class = pred_class").count() > 36


def test_row_numbers(spark, encoded):
    numbered, n = explain.number_rows(encoded.test.select("invoice_id", "features", "label").repartition(7), "invoice_id", 1)
    assert n == 60 and sorted(r.i for r in numbered.collect()) == list(range(60))
    pairs = explain.shuffled_pairs(numbered, n, 3, 7)
    assert pairs.count() == 180
    for rep in range(3):
        rows = pairs.where(pairs.rep == rep).collect()
        assert sorted(r.i for r in rows) == list(range(60))
    assert explain.number_rows(encoded.test.where("false"), "invoice_id", 1)[1] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 12, 97, 360])
def test_shuffles_are_permutations(n):
    for a, b in explain._shuffles(n, 4, 3):
        assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_permutation_importance_equals_brute_force(encoded, models):
    """Every feature, repeat and row scored, without the shortcuts."""
    seed, repeats = 101, SMALL.permutation_repeats
    numbered, n = explain.number_rows(encoded.test.select("invoice_id", "features", "label"), "invoice_id", 42)
    got = {r.feature: (r.importance_mean, r.importance_std) for r in
           explain.permutation_importance(explain.of_model(models[0], len(encoded.features)), encoded.features, numbered, n, seed, repeats).collect()}
    rows = sorted(numbered.collect(), key=lambda r: r.i)
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])

    def accuracy(m):
        return np.mean([models[0].predict(Vectors.dense(v)) == label for v, label in zip(m, y, strict=True)])

    base, order = accuracy(x), [[(a * i + b) % n for i in range(n)] for a, b in explain._shuffles(n, repeats, seed)]
    for k, name in enumerate(encoded.features):
        drops = []
        for p in order:
            shuffled = x.copy()
            shuffled[:, k] = x[p, k]
            drops.append(base - accuracy(shuffled))
        assert got[name] == pytest.approx((np.mean(drops), np.std(drops)), abs=1e-12)


def test_stability_and_top_features(spark, encoded, models):
    runs = explain.retrain_predictions(models, encoded)
    got = explain.prediction_stability(runs).collect()[0]
    by_key = {}
    for r in runs.collect():
        by_key.setdefault(r.invoice_id, set()).add(r.pred_class)
    stable = sum(len(v) == 1 for v in by_key.values())
    assert tuple(got) == pytest.approx((60, stable, stable / 60 * 100))
    scores = explain.permutation_importances(models, encoded, SMALL)
    top = explain.top_features_per_run(scores, 10)
    assert [(r.run, r["rank"]) for r in top.collect()] == [(run, k) for run in (1, 2) for k in range(1, 11)]
    lists = {run: {r.feature for r in top.where("rank <= 3").collect() if r.run == run} for run in (1, 2)}
    value = explain.topk_jaccard(top, 3).collect()[0][0]
    assert value == pytest.approx(len(lists[1] & lists[2]) / len(lists[1] | lists[2]))


def test_jaccard_over_pairs(spark):
    runs = {1: "abc", 2: "abd", 3: "xyz", 4: "cba"}
    df = spark.createDataFrame([(run, k, f) for run, fs in runs.items() for k, f in enumerate(fs + "q", 1)], "run int, rank int, feature string")
    want = np.mean([len(set(a) & set(b)) / len(set(a) | set(b)) for a, b in itertools.combinations(runs.values(), 2)])
    assert explain.topk_jaccard(df, 3).collect()[0][0] == pytest.approx(want)
    assert explain.topk_jaccard(df.where("run = 1"), 3).collect()[0][0] == 0.0


def plain_report(pairs):
    labels = sorted({v for p in pairs for v in p})
    out, sums = {}, []
    for c in labels:
        hit = sum(t == c == p for t, p in pairs)
        guessed, support = sum(p == c for _, p in pairs), sum(t == c for t, _ in pairs)
        pr, re = hit / guessed if guessed else 0.0, hit / support if support else 0.0
        out[c] = (pr, re, 2 * pr * re / (pr + re) if pr + re else 0.0, support)
        sums.append(out[c])
    acc, n = sum(t == p for t, p in pairs) / len(pairs), len(pairs)
    out["accuracy"] = (acc,) * 4
    out["macro avg"] = (*[np.mean([s[i] for s in sums]) for i in range(3)], n)
    out["weighted avg"] = (*[sum(s[i] * s[3] for s in sums) / n for i in range(3)], n)
    return out


@pytest.mark.parametrize("pairs", [
    [("Harmful", "Harmful"), ("Benign", "Harmful"), ("Strategic", "Strategic"), ("Benign", "Benign")],
    [("Harmful", "Benign"), ("Harmful", "Harmful")],  # a class that is never true, one class missing
    [("Benign", "Benign")],
])
def test_classification_report(spark, pairs):
    df = spark.createDataFrame(pairs, "true_class string, pred_class string")
    got = evaluation.classification_report(df).collect()
    want = plain_report(pairs)
    assert [r.label for r in got] == list(want)
    assert all(tuple(r)[1:] == pytest.approx(want[r.label]) for r in got)
    matrix = {r["index"]: tuple(r)[1:] for r in evaluation.confusion_matrix(df).collect()}
    names = ("Harmful", "Benign", "Strategic")
    assert matrix == {f"true_{t}": tuple(sum(q == (t, p) for q in pairs) for p in names) for t in names}


def test_contribution(spark):
    df = spark.createDataFrame([("customer_type_x", 0.2), ("dominant_category_B", 0.1), ("customer_types", 0.3), ("month", 0.4)],
                               "feature string, importance double")
    assert tuple(evaluation.contextual_contribution(df).collect()[0]) == pytest.approx((0.3, 1.0, 30.0))
    assert [(r.bucket, round(r.importance, 9)) for r in evaluation.bucket_breakdown(df).collect()] == [
        ("Numeric/Temporal", 0.7), ("Contextual", 0.3)]
    assert tuple(evaluation.contextual_contribution(df.where("false")).collect()[0]) == (0.0, 0.0, 0.0)


RULED = "invoice_id int, customer_type string, total_qty double, avg_price double, invoice_revenue double, is_peak_season boolean, pred_class string"


def test_rules(spark):
    rows = [(i, "private", 10.0 + i % 3, 5.0, 50.0 + i % 5, False, "Benign") for i in range(40)]
    rows += [(100, "private", 1.0, 0.05, 1.0, True, "Harmful"), (101, "Wholesaler", 99.0, 5.0, 50.0, False, "Strategic"),
             (102, "private", 10.0, 5.0, 9e6, True, "Benign"), (103, "private", 10.0, 5.0, 9e6, False, "Benign"),
             (104, None, 10.0, None, 9e6, None, "Benign")]
    ruled = evaluation.add_rule_class(spark.createDataFrame(rows, RULED))
    found = {r.invoice_id: r.rule_class for r in ruled.where("rule_class is not null").collect()}
    assert found == {100: "Harmful", 101: "Strategic", 102: "Strategic"}
    assert tuple(evaluation.rule_alignment(ruled).collect()[0]) == pytest.approx((3, 2, 200 / 3))
    assert {tuple(r) for r in evaluation.rule_alignment_breakdown(ruled).collect()} == {
        ("Harmful", "Harmful", 1), ("Strategic", "Strategic", 1), ("Strategic", "Benign", 1)}
    none = ruled.where("rule_class is null")
    assert tuple(evaluation.rule_alignment(none).collect()[0]) == (0, 0, 0.0)
    assert evaluation.rule_alignment_breakdown(none).count() == 0


def test_feature_rows_of_many_categories(spark):
    """Names are joined by place: the plan does not grow with the number of categories."""
    n = 50_000
    rows = spark.range(n + 20).select(
        F.col("id").cast("string").alias("invoice_id"), (F.col("id") >= n).alias("is_test"),
        array_to_vector(F.array(F.lit(0.0), F.lit(1.0))).alias("dense"), F.col("id"))
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    wide = OneHotEncoder(inputCol="at", outputCol="hot", dropLast=False).fit(
        rows.select((F.col("id") % n).cast("double").alias("at"))).transform(rows.withColumn("at", (F.col("id") % n).cast("double")))
    frame = VectorAssembler(inputCols=["hot", "dense"], outputCol="features").transform(wide).select("invoice_id", "is_test", "features")
    names = tuple(f"f{i}" for i in range(n + 2))
    got = classifier.sparse_features(classifier.Encoded(frame, names, ("a",)))
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert got.count() == 2 * (n + 20)
    assert {(r.feature, r.value) for r in got.where("invoice_id = '50003'").collect()} == {("f3", 1.0), (f"f{n + 1}", 1.0)}


def test_kept_nodes_give_the_same_trees(encoded):
    """The default keeps the nodes between passes; without that a pass walks down every tree for every row."""
    assert ForestConfig().cache_nodes
    walked, kept = [classifier.train_forest(encoded, 42, ForestConfig(num_trees=5, cache_nodes=c)) for c in (False, True)]
    trees = [m.toDebugString.split("\n", 1)[1] for m in (walked, kept)]  # the first line has the model's own name
    assert trees[0] == trees[1]


def test_parts_of_the_training_rows_do_not_grow_with_the_shuffles(spark, encoded):
    """200 shuffle partitions for 180 rows: the rows are dealt to 24 parts as before with 24, and the trees are the same."""
    shuffles, trees = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (24, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            trees.append(classifier.train_forest(encoded, 42, ForestConfig(num_trees=3)).toDebugString.split("\n", 1)[1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert trees[0] == trees[1]
    assert [classifier._parts(n, most, ForestConfig()) for n, most in ((180, 8), (10**6, 600), (10**9, 600))] == [8, 34, 600]
    assert classifier._parts(10**6, 600, ForestConfig(train_partitions=7)) == 7


@pytest.mark.parametrize(("cells", "most"), [(1, 1), (2 * 180 * 9, 2), (10**9, 3)])
def test_large_fits_run_with_fewer_others(encoded, monkeypatch, cells, most):
    running, seen, lock = [], [], threading.Lock()

    def fit(encoded, seed, cfg):
        with lock:
            running.append(seed)
            seen.append(len(running))
        time.sleep(0.3)
        with lock:
            running.remove(seed)
        return seed

    monkeypatch.setattr(explain, "train_forest", fit)
    seeds = (1, 2, 3)
    assert explain.retrain(encoded, ForestConfig(num_trees=9, retrain_seeds=seeds, cells_at_once=cells)) == list(seeds)
    assert max(seen) == most


def test_a_model_as_arrays_loses_what_scoring_all_rows_loses(spark):
    """Small thresholds, repeated features, NaN and infinite values, ties of votes: against walking down every tree for every case."""
    r = random.Random(8)
    draw = lambda: r.choice([0.0, 0.0, 1.0, -1.0, 0.5, 2.0, float("nan"), float("inf"), float("-inf")])

    def grow(rows, level):
        at = len(rows)
        rows.append(None)
        if level == 0 or r.random() < 0.2:
            rows[at] = (None, None, None, None, [float(r.randrange(4)), 1.0, float(r.randrange(4))])
        else:
            split = (r.choice([0, 2, 3, 5]), r.choice([-0.5, 0.0, 0.5, 1.5]))
            left, right = grow(rows, level - 1), grow(rows, level - 1)
            rows[at] = (*split, left, right, [a + b for a, b in zip(rows[left][4], rows[right][4], strict=True)])
        return at

    for trees in (1, 2, 9):
        grown = [[] for _ in range(trees)]
        for rows in grown:
            grow(rows, 6)
        forest_rows = [(t, n, *row) for t, rows in enumerate(grown) for n, row in enumerate(rows)]
        flat = forest.FlatForest(spark.createDataFrame(forest_rows, forest.NODES).toArrow())
        nodes = {row[:2]: row[2:] for row in forest_rows}

        def best(x):
            votes = [0.0] * 3
            for t in range(trees):
                at = nodes[t, 0]
                while at[0] is not None:
                    at = nodes[t, at[2] if x[at[0]] <= at[1] else at[3]]
                votes = [v + c / sum(at[4]) for v, c in zip(votes, at[4], strict=True)]
            return votes.index(max(votes))

        own, donors = np.array([[draw() for _ in range(6)] for _ in range(30)]), np.array([[[draw() for _ in range(6)] for _ in range(30)] for _ in range(2)])
        label = np.array([float(r.randrange(3)) for _ in range(30)])
        want = np.zeros((2, 6), int)
        for rep, row, k in itertools.product(range(2), range(30), range(6)):
            x = own[row].copy()
            x[k] = donors[rep, row, k]
            want[rep, k] += int(best(own[row]) == label[row]) - int(best(x) == label[row])
        found = np.zeros((2, 6), int)
        found[:, flat.used] = flat.hits_lost(own[:, flat.used], label, donors[:, :, flat.used])
        assert found.tolist() == want.tolist()
