"""Training datasets, alert logs and model artefacts on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.operators.baseline import Baseline
from flowwarden.operators.classifier import Classifier
from flowwarden.operators.isoforest import Forest


def write_dataset(flows: DataFrame, path: str, form: str = "parquet") -> None:
    """The 16 features and the label; Parquet is partitioned by label."""
    rows = flows.select(*[F.col(f).cast("double").alias(f) for f in S.FEATURES], "label")
    if form == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif form == "parquet":
        rows.write.mode("overwrite").partitionBy("label").parquet(path)
    else:
        raise ValueError(f"unknown dataset form: {form}")


def read_dataset(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    reader = spark.read.schema(S.DATASET)
    if form == "csv":
        return reader.option("header", True).csv(path)
    return reader.parquet(path)


def write_alert_log(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines partitioned by the day of the alert."""
    length = 86_400_000_000  # days of UTC, whatever the session time zone
    since_epoch = (F.col("ts_us") - F.pmod("ts_us", F.lit(length))) / length
    day = F.date_from_unix_date(since_epoch.cast("int"))
    alerts.withColumn("day", day).write.mode(mode).partitionBy("day").json(path)


def read_alert_log(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema.add("day", "date")).json(path)


def save_artifacts(
    spark: SparkSession,
    path: str,
    baseline: Baseline,
    forest: Forest | None = None,
    classifier: Classifier | None = None,
) -> None:
    """Everything a detection job needs, the statistical part included."""
    baseline.to_frame(spark).write.mode("overwrite").parquet(f"{path}/baseline")
    if forest is not None:
        forest.to_frame(spark).write.mode("overwrite").parquet(f"{path}/forest")
    if classifier is not None:
        classifier.save(spark, f"{path}/classifier")


def load_baseline(spark: SparkSession, path: str) -> Baseline:
    return Baseline.from_frame(spark.read.parquet(f"{path}/baseline"))


def load_forest(spark: SparkSession, path: str) -> Forest:
    return Forest.from_frame(spark.read.parquet(f"{path}/forest"))


def load_classifier(spark: SparkSession, path: str) -> Classifier:
    return Classifier.load(spark, f"{path}/classifier")
