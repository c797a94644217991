"""Scalar functions over flow columns. All are plain Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden import schema as S


def function_code_class(fc: Column) -> Column:
    return (
        F.when(fc.isin(S.FC_DANGEROUS), "dangerous")
        .when(fc.isin(S.FC_CONFIG), "config")
        .when(fc.isin(S.FC_CONTROL), "control")
        .when(fc.between(0, S.FC_SAFE_MAX), "safe")
        .otherwise("unknown")
    )


def safe_ratio(num: Column, den: Column, fallback: float = 0.0) -> Column:
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(fallback))


def protocol_of_port(port: Column) -> Column:
    return F.when(port.isin(S.DNP3_PORTS), S.PROTOCOLS["DNP3"]).otherwise(
        S.PROTOCOLS["UNKNOWN"]
    )


def broadcast_address(ip: Column) -> Column:
    return F.when(ip.endswith(".255"), 1).otherwise(0)


def enrich(flows: DataFrame) -> DataFrame:
    """Fill bytes_per_pkt where it was left at zero."""
    derive = (F.col("pkt_count") > 0) & (F.col("bytes_per_pkt") == 0)
    return flows.withColumn(
        "bytes_per_pkt",
        F.when(derive, F.try_divide(F.col("byte_count"), F.col("pkt_count"))).otherwise(
            F.col("bytes_per_pkt")
        ),
    )


def packet_rate(packets: Column, seconds: Column) -> Column:
    """Packets per second; null unless both are positive."""
    return F.when((packets > 0) & (seconds > 0), F.try_divide(packets, seconds))


def feature_vector() -> Column:
    return F.array(*[F.col(f).cast("double") for f in S.FEATURES])


def constrain(name: str, value: Column) -> Column:
    """Clip one feature to its range; whole-number features round half to even."""
    low, high = S.FEATURE_BOUNDS[name]
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), value.cast("double")))
    return F.bround(clipped, 0) if name in S.INTEGER_FEATURES else clipped


def constrain_all(df: DataFrame) -> DataFrame:
    return df.withColumns({f: constrain(f, F.col(f)) for f in S.FEATURES})


def state_vector() -> Column:
    """Network state scaled to eight numbers of similar size."""
    scales = [
        ("alert_count", 100.0),
        ("avg_severity", 4.0),
        ("avg_confidence", 1.0),
        ("action", 4.0),
        ("latency_ms", 1000.0),
        ("packet_loss_pct", 100.0),
        ("isolated_hosts", 20.0),
        ("qos", 1.0),
    ]
    return F.array(*[F.col(c).cast("double") / s for c, s in scales])


def label_id(label: Column) -> Column:
    """Position in the label list; unknown labels count as normal."""
    known = F.create_map(*[F.lit(x) for i, n in enumerate(S.LABELS) for x in (n, i)])
    return F.coalesce(F.try_element_at(known, label), F.lit(0))


def label_name(id_: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in S.LABELS]), id_.cast("int") + 1)


def graded(score: Column, steps: list[tuple[float, object]], below: object) -> Column:
    """First step whose lower limit the score reaches."""
    chain = reduce(
        lambda c, s: c.when(score >= s[0], F.lit(s[1])),
        steps[1:],
        F.when(score >= steps[0][0], F.lit(steps[0][1])),
    )
    return chain.otherwise(F.lit(below))


# --- fixed values: confidence limits of the severity scales ---
RULE_GRADES = [(0.90, 4), (0.75, 3), (0.60, 2)]
STATISTICAL_GRADES = [(0.75, 3), (0.55, 2)]
LEARNED_GRADES = [(0.90, 4), (0.75, 3), (0.55, 2)]
LINK_GRADES = [(0.80, "critical"), (0.60, "high"), (0.40, "medium"), (0.20, "low")]


def rule_severity(score: Column) -> Column:
    return graded(score, RULE_GRADES, 1)


def statistical_severity(score: Column) -> Column:
    return graded(score, STATISTICAL_GRADES, 1)


def learned_severity(score: Column) -> Column:
    return graded(score, LEARNED_GRADES, 1)


def link_severity(score: Column) -> Column:
    return graded(score, LINK_GRADES, "normal")


def escalation_band(score: Column) -> Column:
    return (
        F.when(score < 0.3, "ignore")
        .when(score < 0.5, "monitor")
        .when(score <= 0.7, "alert")
        .otherwise("high_alert")
    )


def is_normal(label: Column) -> Column:
    return label == S.LABELS[0]
