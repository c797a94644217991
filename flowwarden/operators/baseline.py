"""Statistical baseline: feature moments, z-scores, anomaly score, feature scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.functions.features import is_normal, statistical_severity
from flowwarden.operators.slices import merged, running_moments

MIN_ROWS = 5
EPSILON = 1e-9
STATISTICAL_ALERT = 0.40
FOREST_SHARE = 0.6


@dataclass(frozen=True)
class Baseline:
    """Count and, per feature, mean and population variance of the training flows."""

    count: int
    mean: dict[str, float]
    variance: dict[str, float]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f, self.count, self.mean[f], self.variance[f]) for f in S.FEATURES]
        return spark.createDataFrame(rows, "feature string, n bigint, mean double, variance double")

    @staticmethod
    def from_frame(df: DataFrame) -> Baseline:
        rows = df.collect()  # one row per feature
        return Baseline(
            rows[0]["n"],
            {r["feature"]: r["mean"] for r in rows},
            {r["feature"]: r["variance"] for r in rows},
        )


PRIOR_COLUMNS = [f"prior_{part}_{f}" for f in S.FEATURES for part in ("mean", "std")]
NO_BASELINE = Baseline(0, dict.fromkeys(S.FEATURES, 0.0), dict.fromkeys(S.FEATURES, 0.0))


def moments(flows: DataFrame) -> DataFrame:
    """One row: n, mean_<feature>, var_<feature> (population)."""
    return flows.agg(
        F.count("*").alias("n"),
        *[F.avg(f).alias(f"mean_{f}") for f in S.FEATURES],
        *[F.var_pop(f).alias(f"var_{f}") for f in S.FEATURES],
    )


def fit_baseline(flows: DataFrame, normal_only: bool = True) -> Baseline:
    """Moments of the normal flows; of all flows when none is labelled normal."""
    row = None
    if normal_only:
        row = moments(flows.where(is_normal(F.col("label")))).first()
    if row is None or row["n"] == 0:
        row = moments(flows).first()
    if row["n"] == 0:
        return NO_BASELINE
    return Baseline(
        row["n"],
        {f: row[f"mean_{f}"] for f in S.FEATURES},
        {f: row[f"var_{f}"] for f in S.FEATURES},
    )


def prior_moments(
    flows: DataFrame,
    start: Baseline = NO_BASELINE,
    keys: Sequence[str] = (),
    slice_rows: int | None = None,
) -> DataFrame:
    """Per flow: prior_n, prior_mean_<f>, prior_std_<f> over the baseline and all
    earlier flows (of the same keys, if given) in (ts_us, md5(uid)) order."""
    squares = {f: start.variance[f] * start.count for f in S.FEATURES}
    known = (float(start.count), start.mean, squares)
    seen = running_moments(flows, "ts_us", "uid", S.FEATURES, keys, slice_rows, known)
    return seen.select(
        *flows.columns,
        F.col("_n").alias("prior_n"),
        *[
            c for f in S.FEATURES
            for c in (F.col(f"_mean_{f}").alias(f"prior_mean_{f}"), _deviation(f"_m2_{f}", "_n").alias(f"prior_std_{f}"))
        ],
    )


def _deviation(m2: str, n: str) -> Column:
    return F.when(F.col(n) > 1, F.sqrt(F.try_divide(F.col(m2), F.col(n)))).otherwise(0.0)


def with_priors(seen: DataFrame, start: Baseline) -> DataFrame:
    """Baseline and the moments _n, _mean_<f>, _m2_<f> of what was seen since, together."""
    n0 = F.lit(float(start.count))
    result = {"prior_n": F.col("_n") + n0}
    for f in S.FEATURES:
        m0, m20 = F.lit(float(start.mean[f])), F.lit(float(start.variance[f] * start.count))
        mean, m2 = merged(n0, m0, m20, F.col("_n"), F.col(f"_mean_{f}"), F.col(f"_m2_{f}"))
        n = F.col("_n") + n0
        result[f"prior_mean_{f}"] = mean
        result[f"prior_std_{f}"] = F.when(n > 1, F.sqrt(F.try_divide(m2, n))).otherwise(0.0)
    return seen.withColumns(result)


def frozen_moments(flows: DataFrame, baseline: Baseline) -> DataFrame:
    """The same columns from a fixed baseline: no shuffle, usable on streams."""
    fixed = {"prior_n": F.lit(float(baseline.count))}
    for f in S.FEATURES:
        fixed[f"prior_mean_{f}"] = F.lit(float(baseline.mean[f]))
        fixed[f"prior_std_{f}"] = F.sqrt(F.lit(float(baseline.variance[f])))
    return flows.withColumns(fixed)


def zscore(feature: str) -> Column:
    centred = F.col(feature).cast("double") - F.col(f"prior_mean_{feature}")
    return centred / (F.col(f"prior_std_{feature}") + F.lit(EPSILON))


def with_zscores(df: DataFrame) -> DataFrame:
    """Add z_<feature>; zero while fewer than five earlier flows are known."""
    ready = F.col("prior_n") >= MIN_ROWS
    return df.withColumns(
        {f"z_{f}": F.when(ready, zscore(f)).otherwise(0.0) for f in S.FEATURES}
    )


def outlying(feature: str, limit: float = S.Z_THRESHOLD) -> Column:
    return F.abs(F.col(f"z_{feature}")) > limit


def anomaly_of(z: Sequence[Column], limit: float = S.Z_THRESHOLD) -> Column:
    """Half the share of outlying features plus half the capped largest deviation."""
    count = sum(((F.abs(c) > limit).cast("int") for c in z), F.lit(0))
    largest = F.greatest(*[F.abs(c) for c in z])
    reach = F.least(largest / (2 * limit), F.lit(1.0))
    return F.when(
        largest > limit, F.lit(0.5) * (count / len(S.FEATURES)) + F.lit(0.5) * reach
    ).otherwise(0.0)


def anomaly_score(limit: float = S.Z_THRESHOLD) -> Column:
    return anomaly_of([F.col(f"z_{f}") for f in S.FEATURES], limit)


def frozen_zscores(baseline: Baseline, values: dict[str, Column]) -> list[Column]:
    """Deviations of given feature values from a fixed baseline; zeros while it is too small."""
    if baseline.count < MIN_ROWS:
        return [F.lit(0.0) for _ in S.FEATURES]
    return [
        (values[f].cast("double") - float(baseline.mean[f])) / (float(baseline.variance[f]) ** 0.5 + EPSILON)
        for f in S.FEATURES
    ]


def outlying_features(limit: float = S.Z_THRESHOLD) -> Column:
    return F.array_compact(
        F.array(*[F.when(outlying(f, limit), F.lit(f)) for f in S.FEATURES])
    )


def attack_guess() -> Column:
    """Likely attack class from the outlying features."""
    return (
        F.when(outlying("burst_count"), "flooding")
        .when(outlying("function_code") | outlying("unique_fc_count"), "command_injection")
        .when(outlying("inter_arrival_mean"), "replay")
        .otherwise("scan")
    )


def statistical_scores(df: DataFrame, forest_score: Column | None = None) -> DataFrame:
    """Add z_score, if_score, stat_score, stat_fires, stat_attack, stat_severity.

    With an isolation-forest score the two are mixed 0.4 to 0.6; else z alone.
    """
    scored = with_zscores(df).withColumns(
        {"z_score": anomaly_score(), "if_score": F.lit(0.0) if forest_score is None else forest_score}
    )
    mixed = F.col("z_score")
    if forest_score is not None:
        mixed = (1 - FOREST_SHARE) * F.col("z_score") + FOREST_SHARE * F.col("if_score")
    return (
        scored.withColumn("stat_score", mixed)
        .withColumn("stat_fires", F.col("stat_score") >= STATISTICAL_ALERT)
        .withColumns(
            {
                "stat_attack": F.when(F.col("stat_fires"), attack_guess()),
                "stat_severity": F.when(
                    F.col("stat_fires"), statistical_severity(F.col("stat_score"))
                ),
            }
        )
    )


def statistical_alerts(scored: DataFrame) -> DataFrame:
    return scored.where("stat_fires").select(
        "uid",
        "ts_us",
        "src_ip",
        "dst_ip",
        F.col("stat_attack").alias("attack_type"),
        F.col("stat_severity").alias("severity"),
        F.least("stat_score", F.lit(1.0)).alias("confidence"),
        F.col("stat_score").alias("score"),
        F.lit("statistical").alias("detector"),
        F.create_map(
            F.lit("zscore"), F.col("z_score"), F.lit("iforest"), F.col("if_score"), F.lit("combined"), F.col("stat_score")
        ).alias("raw_scores"),
        outlying_features().alias("features"),
    )


def scale_features(flows: DataFrame, scaler: Baseline | None) -> DataFrame:
    """Standardise with population deviation; constant features are only centred.

    Without a fitted scaler the features pass through unchanged.
    """
    if scaler is None:
        return flows
    spread = {f: scaler.variance[f] ** 0.5 or 1.0 for f in S.FEATURES}
    return flows.withColumns(
        {f: (F.col(f).cast("double") - F.lit(scaler.mean[f])) / F.lit(spread[f]) for f in S.FEATURES}
    )
