"""Rules over connection summaries, their summed score and the anomaly records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.functions.features import link_severity
from flowwarden.operators.connections import link_rate


@dataclass(frozen=True)
class LinkRule:
    name: str
    severity: str
    score: float
    condition: Callable[[], Column]
    description: Callable[[], Column]


def _packets() -> Column:
    return F.col("orig_pkts") + F.col("resp_pkts")


def _error_share() -> Column:
    return F.try_divide(F.col("error_count"), _packets())


def _balance() -> Column:
    return F.try_divide(F.col("request_count"), F.col("response_count"))


# --- fixed values: limits, scores and texts of the link rules ---
LINK_RULES = [
    LinkRule(
        "broadcast_write",
        "critical",
        0.95,
        lambda: F.col("is_broadcast"),
        lambda: F.lit("DNP3 WRITE to broadcast address"),
    ),
    LinkRule(
        "high_fc_diversity",
        "medium",
        0.55,
        lambda: F.col("unique_fc_count") > 6,
        lambda: F.format_string("%d unique function codes (max 6)", "unique_fc_count"),
    ),
    LinkRule(
        "flooding",
        "high",
        0.80,
        lambda: link_rate() > 50.0,
        lambda: F.format_string("%.1f pps exceeds threshold 50.0", F.bround(link_rate(), 1)),
    ),
    LinkRule(
        "error_storm",
        "medium",
        0.60,
        lambda: (_packets() > 10) & (F.col("error_count") > 0) & (_error_share() > 0.10),
        lambda: F.format_string("Error rate %.1f%%", F.bround(_error_share() * 100, 1)),
    ),
    LinkRule(
        "req_resp_imbalance",
        "low",
        0.40,
        lambda: (F.col("response_count") > 0)
        & ((_balance() > 3.0) | (_balance() < 1.0 / 3.0)),
        lambda: F.format_string("Request/response ratio %.2f", F.bround(_balance(), 2)),
    ),
    LinkRule(
        "burst_traffic",
        "medium",
        0.50,
        lambda: F.col("burst_count") > 10,
        lambda: F.format_string("%d burst intervals detected", "burst_count"),
    ),
    LinkRule(
        "machine_speed_pacing",
        "high",
        0.75,
        lambda: (F.col("inter_arrival_mean") > 0) & (F.col("inter_arrival_mean") < 0.001),
        lambda: F.format_string("Inter-arrival mean %.4fms", F.col("inter_arrival_mean") * 1000),
    ),
]


def fires(rule: LinkRule) -> Column:
    return F.coalesce(rule.condition(), F.lit(False))


def link_hits_of(summaries: DataFrame, rule: LinkRule) -> DataFrame:
    return summaries.where(fires(rule)).select(
        "uid",
        F.lit(rule.name).alias("rule_id"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.score).alias("score"),
    )


def with_hits(summaries: DataFrame) -> DataFrame:
    """Add `hits`: an array of (rule_id, severity, description, score) in rule order."""
    parts = [
        F.when(
            fires(r),
            F.struct(
                F.lit(r.name).alias("rule_id"),
                F.lit(r.severity).alias("severity"),
                r.description().alias("description"),
                F.lit(r.score).alias("score"),
            ),
        )
        for r in LINK_RULES
    ]
    return summaries.withColumn("hits", F.array_compact(F.array(*parts)))


def total_score() -> Column:
    parts = [F.when(fires(r), F.lit(r.score)).otherwise(0.0) for r in LINK_RULES]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(total, F.lit(1.0))


def rules_fired() -> Column:
    return F.array_compact(F.array(*[F.when(fires(r), F.lit(r.name)) for r in LINK_RULES]))


def annotate(summaries: DataFrame) -> DataFrame:
    """Every summary with its anomaly score and label; 0.0 and "normal" without hits."""
    return summaries.withColumn("anomaly_score", total_score()).withColumn(
        "anomaly_label", link_severity(F.col("anomaly_score"))
    )


def anomaly_records(summaries: DataFrame) -> DataFrame:
    """Summaries with at least one hit: rules fired, capped score, severity."""
    scored = summaries.select(
        "uid",
        "t_us",
        "orig_h",
        "resp_h",
        rules_fired().alias("rules_fired"),
        total_score().alias("total_score"),
    )
    return scored.where(F.col("total_score") > 0).withColumn(
        "severity", link_severity(F.col("total_score"))
    )


def exploded_hits(summaries: DataFrame) -> DataFrame:
    return with_hits(summaries).select("uid", F.inline("hits"))
