"""Calibrated random forest over the flow features."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.functions.features import label_id, label_name, learned_severity
from flowwarden.operators.baseline import Baseline, fit_baseline, scale_features
from flowwarden.operators.calibration import Curve, isotonic
from flowwarden.operators.quality import classification_report, shuffled_split
from flowwarden.operators.slices import hash_rank
from flowwarden.operators.trees import RandomForest, grow_forest
from flowwarden.session import stored

TREES = 200
# Trees of unlimited depth grow with the data until the model no longer fits in memory;
# twelve levels bound a forest at 200 x 8191 nodes. Spark ML allows up to 30.
MAX_DEPTH = 12
MIN_LEAF = 2
FOLDS = 3
SEED = 42
MIN_CONFIDENCE = 0.35
MIN_ROWS = 10


@dataclass
class Classifier:
    """One forest per fold with a calibration curve per class, and the feature scaler."""

    scaler: Baseline
    classes: list[int]
    forests: list[RandomForest]
    curves: list[dict[int, Curve]] = field(default_factory=list)

    def curves_frame(self, spark: SparkSession) -> DataFrame:
        """The points of all curves: fold, class, x, y."""
        rows = [
            (i, c, float(x), float(y))
            for i, curves in enumerate(self.curves)
            for c, curve in curves.items()
            for x, y in zip(curve.x, curve.y, strict=True)
        ]
        return spark.createDataFrame(rows, "fold int, class int, x double, y double")

    def save(self, spark: SparkSession, path: str) -> None:
        for i, forest in enumerate(self.forests):
            forest.save(spark, f"{path}/forest-{i}")
        self.curves_frame(spark).write.mode("overwrite").parquet(f"{path}/curves")
        self.scaler.to_frame(spark).write.mode("overwrite").parquet(f"{path}/scaler")
        about = {
            "classes": self.classes,
            "forests": len(self.forests),
        }
        spark.createDataFrame([(json.dumps(about),)], "about string").write.mode(
            "overwrite"
        ).parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        return Classifier(
            Baseline.from_frame(spark.read.parquet(f"{path}/scaler")),
            about["classes"],
            [
                RandomForest.load(spark, f"{path}/forest-{i}")
                for i in range(about["forests"])
            ],
            _curves_of(spark.read.parquet(f"{path}/curves").toPandas(), about["forests"]),
        )


def _curves_of(points: pd.DataFrame, folds: int) -> list[dict[int, Curve]]:
    found: list[dict[int, Curve]] = [{} for _ in range(folds)] if len(points) else []
    for (fold, c), rows in points.groupby(["fold", "class"]):
        ordered = rows.sort_values(["x", "y"])
        found[fold][int(c)] = Curve(ordered["x"].to_numpy(), ordered["y"].to_numpy())
    return found


def class_weights(flows: DataFrame) -> DataFrame:
    """n / (classes x class rows) per label."""
    counts = flows.groupBy("label").agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.select(
        "label", "n", (totals["n"] / (totals["k"] * F.col("n"))).alias("weight")
    )


def stratified_folds(flows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Add `fold`: the classes are dealt out evenly in hash order."""
    ranked = hash_rank(flows, "uid", ["label"], "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def fold_count(flows: DataFrame, wanted: int = FOLDS) -> int:
    """At most one fold per row of the smallest class."""
    smallest = flows.groupBy("label").count().agg(F.min("count")).first()[0]
    return min(wanted, smallest or 1)


def assembled(flows: DataFrame, scaler: Baseline) -> DataFrame:
    scaled = scale_features(flows, scaler)
    return VectorAssembler(inputCols=S.FEATURES, outputCol="features").transform(scaled)


def train_classifier(
    flows: DataFrame,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    folds: int = FOLDS,
    calibrate: bool = True,
) -> Classifier:
    """Fit on all labelled flows.

    With calibration each fold's forest is trained on the other folds and calibrated on
    its own; with fewer than two rows in a class there is one plain forest.
    """
    scaler = fit_baseline(flows, normal_only=False)
    if scaler.count < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} training rows")
    k = fold_count(flows, folds) if calibrate else 1
    weights = class_weights(flows).select("label", "weight")
    folded = stratified_folds(flows, max(k, 1)).join(weights, "label")
    ready = stored(
        assembled(folded, scaler).select(
            "features", label_id(F.col("label")).cast("double").alias("y"), "weight", "fold",
            F.xxhash64("uid").alias("key"),
        ),
        "training",
    )
    kinds = sorted(tuple(r) for r in ready.select("y", "weight").distinct().collect())  # one row a label
    classes = sorted({int(y) for y, _ in kinds})

    def fit(rows: DataFrame) -> RandomForest:
        return grow_forest(rows, kinds, trees, max_depth, MIN_LEAF, SEED)

    if k < 2:
        return Classifier(scaler, classes, [fit(ready)])

    def fit_fold(i: int) -> tuple[RandomForest, dict]:
        forest = fit(ready.where(F.col("fold") != i))
        return forest, _calibrate(forest, ready.where(F.col("fold") == i), classes)

    task = inheritable_thread_target(flows.sparkSession)(fit_fold)
    with ThreadPool(k) as pool:  # the folds are independent jobs
        fitted = pool.map(task, range(k))
    return Classifier(scaler, classes, [f for f, _ in fitted], [c for _, c in fitted])


def _calibrate(
    forest: RandomForest, held_out: DataFrame, classes: list[int]
) -> dict[int, Curve]:
    """Isotonic curve per class, on the exact held-out probabilities."""
    probability = forest.probabilities(vector_to_array("features"))
    each = [
        F.struct(
            F.lit(c).alias("class"), F.col("_p")[c].alias("p"), (F.col("y") == c).cast("int").alias("hit")
        )
        for c in classes
    ]
    pools = isotonic(held_out.select("y", probability.alias("_p")).select(F.inline(F.array(*each))), ["class"])
    steps = pools.toPandas()  # the steps of the curves, part of the model
    return {int(c): Curve.of(rows) for c, rows in steps.groupby("class")}


def _class_probabilities(model: Classifier, features: Column) -> Column:
    """Per class in list order: the forests' raw ones, by curve, normalised and averaged."""
    curves, classes = model.curves, model.classes
    scorers = [forest.scorer() for forest in model.forests]

    def scored(x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), len(classes)))
        for i, score in enumerate(scorers):
            given = score(x)[:, classes]
            if curves:
                fitted = [curves[i][c](given[:, j]) for j, c in enumerate(classes)]
                given = np.clip(np.column_stack(fitted), 0.0, 1.0)
                sums = given.sum(axis=1, keepdims=True)
                even = np.full_like(given, 1.0 / len(classes))
                given = np.divide(given, sums, out=even, where=sums > 0)
            total += given
        return total / len(scorers)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(scored(np.stack(x.to_numpy()))) if len(x) else [], dtype=object)

    return run(features)


def predict(model: Classifier, flows: DataFrame) -> DataFrame:
    """Add predicted class, its confidence, the attack probability and the alert fields.

    ml_attack and ml_severity are null for normal or unsure predictions.
    """
    raw = flows.select("*", F.struct(*S.FEATURES).alias("_keep"))
    ready = assembled(raw, model.scaler)
    found = _class_probabilities(model, vector_to_array("features"))
    scored = ready.withColumn("probabilities", found).drop("features")
    ids = F.array(*[F.lit(c) for c in model.classes])
    best = F.array_max("probabilities")
    attack_free = (
        F.col("probabilities")[model.classes.index(0)] if 0 in model.classes else F.lit(0.0)
    )
    restored = scored.withColumns({f: F.col(f"_keep.{f}") for f in S.FEATURES}).drop("_keep")
    named = restored.withColumns(
        {
            "predicted": label_name(
                F.element_at(ids, F.array_position("probabilities", best).cast("int"))
            ),
            "ml_confidence": best,
            "ml_probability": 1.0 - attack_free,
            "class_probabilities": F.map_from_arrays(
                F.array(*[F.lit(S.LABELS[c]) for c in model.classes]), F.col("probabilities")
            ),
        }
    )
    sure = (F.col("predicted") != S.LABELS[0]) & (F.col("ml_confidence") >= MIN_CONFIDENCE)
    return named.withColumns(
        {
            "ml_attack": F.when(sure, F.col("predicted")),
            "ml_severity": F.when(sure, learned_severity(F.col("ml_confidence"))),
        }
    ).drop("probabilities")


def attack_probability(model: Classifier | None, flows: DataFrame) -> DataFrame:
    """uid and attack probability; zero without a trained model."""
    if model is None:
        return flows.select("uid", F.lit(0.0).alias("ml_probability"))
    return predict(model, flows).select("uid", "ml_probability")


def importances(model: Classifier, spark: SparkSession, top: int | None = None) -> DataFrame:
    """Feature importances of the first fold's forest, highest first."""
    values = model.forests[0].importances.tolist()
    rows = spark.createDataFrame(list(zip(S.FEATURES, values)), "feature string, importance double")
    ordered = rows.orderBy(F.col("importance").desc(), "feature")
    return ordered if top is None else ordered.limit(top)


def evaluate(model: Classifier, flows: DataFrame) -> DataFrame:
    known: Column = label_name(label_id(F.col("label")))
    return classification_report(
        predict(model, flows).select(known.alias("label"), "predicted")
    )


def train_and_evaluate(
    flows: DataFrame, test_share: float = 0.2, trees: int = TREES, max_depth: int = MAX_DEPTH
) -> tuple[Classifier, DataFrame]:
    """A model of a part of the flows, and its report on the others, which it has not seen."""
    split = stored(shuffled_split(flows, test_share), "split")
    model = train_classifier(split.where("part = 'train'").drop("part"), trees, max_depth)
    return model, evaluate(model, split.where("part = 'test'").drop("part"))
