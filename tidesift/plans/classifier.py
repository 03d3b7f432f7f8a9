"""Random-forest outlier classifier on MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FOREST, ForestConfig
from ..operators.sampling import stratified_split
from ..operators.staging import stage
from ..schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from .dataset import outliers_only

KEY, TRUTH, GUESS = "invoice_id", "true_class", "pred_class"


@dataclass(frozen=True)
class Encoded:
    """Split and encoded model data: ``frame`` has the key, the model columns, ``is_test``, ``label``, ``features``."""

    frame: DataFrame
    features: tuple[str, ...]
    classes: tuple[str, ...]

    @property
    def train(self) -> DataFrame:
        return self.frame.where(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.frame.where("is_test")


def _model_columns(dataset: DataFrame) -> DataFrame:
    """A missing category is a category of its own; flags and counts become numbers."""
    return dataset.withColumns({
        **{c: F.coalesce(F.col(c), F.lit("nan")) for c in CATEGORICAL_FEATURES},
        **{f"{c}_number": F.col(c).cast("double") for c in NUMERIC_FEATURES},
    })


def _encoder() -> Pipeline:
    indexed = [f"{c}_index" for c in CATEGORICAL_FEATURES]
    encoded = [f"{c}_one_hot" for c in CATEGORICAL_FEATURES]
    numbers = [f"{c}_number" for c in NUMERIC_FEATURES]
    return Pipeline(stages=[
        # An unseen category gets the extra index, which the encoder drops: an all-zero block.
        StringIndexer(inputCols=list(CATEGORICAL_FEATURES), outputCols=indexed, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=encoded + numbers, outputCol="features"),
        StringIndexer(inputCol="outlier_class", outputCol="label", stringOrderType="alphabetAsc"),
    ])


def _names(encoder: PipelineModel) -> tuple[tuple[str, ...], tuple[str, ...]]:
    categories = encoder.stages[0].labelsArray
    one_hot = [f"{c}_{v}" for c, values in zip(CATEGORICAL_FEATURES, categories, strict=True) for v in values]
    return tuple(one_hot) + NUMERIC_FEATURES, tuple(encoder.stages[3].labels)


def split_and_encode(dataset: DataFrame, test_share: float, cfg: ForestConfig = FOREST) -> Encoded:
    """Stratified split of the three outlier classes, encoder fitted on the training part, result staged once."""
    split = stratified_split(outliers_only(dataset), KEY, "outlier_class", test_share, cfg.seed)
    ready = stage(_model_columns(split), "model-split")
    encoder = _encoder().fit(ready.where(~F.col("is_test")))
    features, classes = _names(encoder)
    encoded = encoder.transform(ready).select(*dataset.columns, "is_test", "features", "label")
    return Encoded(stage(encoded, "model-encoded"), features, classes)


def sparse_features(encoded: Encoded) -> DataFrame:
    """Non-zero feature values as rows (invoice_id, is_test, feature, value)."""
    vector = F.unwrap_udt("features")
    values = vector["values"]
    # A dense vector has no indices: its values stand for 0, 1, ...
    places = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(values) - 1))
    rows = (encoded.frame.select(KEY, "is_test", F.inline(F.arrays_zip(places.alias("place"), values.alias("value"))))
            .where(F.col("value") != 0))
    names = encoded.frame.sparkSession.createDataFrame(list(enumerate(encoded.features)), "place int, feature string")
    return rows.join(names, "place").select(KEY, "is_test", "feature", "value")


def _balanced_weight(counts: dict[float, int]) -> Column:
    """Weight n / (classes * rows of the class): every class counts the same."""
    n, weight = sum(counts.values()), F.lit(None).cast("double")
    for label, rows in counts.items():
        weight = F.when(F.col("label") == label, n / (len(counts) * rows)).otherwise(weight)
    return weight


def _parts(rows: int, most: int, cfg: ForestConfig) -> int:
    """Every part sends a histogram of every open node in every pass, so more parts than the rows need cost time and disk."""
    return cfg.train_partitions or min(most, max(cfg.fewest_partitions, -(-rows // cfg.train_rows_per_partition)))


def train_forest(encoded: Encoded, seed: int, cfg: ForestConfig = FOREST) -> RandomForestClassificationModel:
    """Fit on the training part. Placing and sorting rows by key makes a seed give the same trees again."""
    train = encoded.train.select(KEY, "features", "label")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = _parts(sum(counts.values()), int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), cfg)
    placed = (train.withColumn("weight", _balanced_weight(counts)).repartition(parts, KEY)
              .sortWithinPartitions(KEY).drop(KEY))
    forest = RandomForestClassifier(
        numTrees=cfg.num_trees, minInstancesPerNode=cfg.min_leaf, maxDepth=cfg.max_depth, maxBins=cfg.max_bins,
        featureSubsetStrategy="sqrt", impurity="gini", weightCol="weight", seed=seed,
        maxMemoryInMB=cfg.max_memory_mb, cacheNodeIds=cfg.cache_nodes,
        checkpointInterval=10)
    return forest.fit(placed)


def only_prediction(model: RandomForestClassificationModel) -> RandomForestClassificationModel:
    """The model without its probability outputs, which no report reads."""
    return model.copy().setRawPredictionCol("").setProbabilityCol("")


def predict(model: RandomForestClassificationModel, encoded: Encoded) -> DataFrame:
    """The test part with the true and the predicted class."""
    names = F.array(*[F.lit(c) for c in encoded.classes])
    scored = only_prediction(model).transform(encoded.test)
    return scored.select(*[c for c in encoded.frame.columns if c not in ("is_test", "features", "label")],
                         F.col("outlier_class").alias(TRUTH),
                         F.get(names, F.col("prediction").cast("int")).alias(GUESS))


def feature_importance(model: RandomForestClassificationModel, features: Sequence[str]) -> DataFrame:
    """Impurity importance per encoded feature, highest first."""
    rows = [(name, float(v)) for name, v in zip(features, model.featureImportances.toArray(), strict=True)]
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")
