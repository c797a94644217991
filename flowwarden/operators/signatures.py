"""Signature rules over flows: each rule is a condition, a confidence and a class."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.functions import features as fn


@dataclass(frozen=True)
class Signature:
    """`confidence` gives the rule's confidence, or null where it does not apply.

    Conditions built from `try_*` functions give null on bad input, which counts
    as "no hit", so one faulty rule never stops the others.
    """

    name: str
    attack: str
    confidence: Callable[[], Column]


def when_true(condition: Callable[[], Column], confidence: float) -> Callable[[], Column]:
    return lambda: F.when(condition(), F.lit(confidence))


def _is_dnp3() -> Column:
    return F.col("protocol_id") == S.PROTOCOLS["DNP3"]


def _flood_confidence() -> Column:
    rate = fn.packet_rate(F.col("pkt_count"), F.col("flow_duration"))
    return F.when(F.col("burst_count") > 500, 0.85).when(rate > 1000, 0.80)


SIGNATURES = [
    Signature(
        "broadcast_write",
        "command_injection",
        when_true(
            lambda: (F.col("is_broadcast") != 0)
            & F.col("function_code").isin(*S.FC_CONTROL, 81),
            0.90,
        ),
    ),
    Signature(
        "unknown_function_code",
        "scan",
        when_true(lambda: _is_dnp3() & (F.col("function_code") > 131), 0.80),
    ),
    Signature(
        "high_rate_scan",
        "scan",
        when_true(
            lambda: (F.col("flow_duration") < 0.5) & (F.col("pkt_count") > 20), 0.75
        ),
    ),
    Signature(
        "config_change_fc",
        "command_injection",
        when_true(lambda: _is_dnp3() & F.col("function_code").isin(S.FC_CONFIG), 0.85),
    ),
    Signature(
        "timing_attack",
        "replay",
        when_true(
            lambda: (F.col("function_code") == 19) & (F.col("pkt_count") > 1), 0.70
        ),
    ),
    Signature("flooding", "flooding", _flood_confidence),
    Signature(
        "unusual_port",
        "mitm",
        when_true(
            lambda: F.col("dst_port").isin(S.DNP3_PORTS) & (F.col("src_port") < 1024), 0.60
        ),
    ),
    Signature(
        "error_storm",
        "command_injection",
        when_true(lambda: (F.col("error_rate") > 0.5) & (F.col("pkt_count") > 10), 0.65),
    ),
    Signature(
        "duplicate_unsolicited",
        "replay",
        when_true(
            lambda: (F.col("function_code") == 130)
            & (F.col("pkt_count") > 5)
            & (F.col("req_resp_ratio") < 0.1),
            0.80,
        ),
    ),
]


def hit_column(rule: Signature) -> Column:
    return rule.confidence().isNotNull()


def hits_of(flows: DataFrame, rule: Signature) -> DataFrame:
    """Flows that one rule fires on, with its confidence and attack class."""
    return flows.where(hit_column(rule)).select(
        "uid",
        F.lit(rule.name).alias("rule"),
        rule.confidence().alias("confidence"),
        F.lit(rule.attack).alias("attack_type"),
    )


def _strongest(rules: Sequence[Signature]) -> Column:
    """Score, place, name and class of the strongest rule that applies, of equal ones the
    earliest. Every rule is written once, and with a lambda the operator stays out of fused
    code: repeated in it, the rules made a method too long for the JVM to compile."""
    none = F.struct(
        F.lit(None).cast("double").alias("score"), F.lit(0).alias("place"), F.lit("").alias("name"), F.lit("").alias("attack")
    )
    each = [
        F.struct(
            r.confidence().cast("double").alias("score"), F.lit(-i).alias("place"),
            F.lit(r.name).alias("name"), F.lit(r.attack).alias("attack"),
        )
        for i, r in enumerate(rules)
    ]
    return F.array_max(F.filter(F.array(*each, none), lambda hit: hit["score"].isNotNull()))


def rule_score(rules: Sequence[Signature] = SIGNATURES) -> Column:
    """Highest confidence among the rules, zero when none fires."""
    return F.coalesce(F.greatest(*_padded(rules)), F.lit(0.0))


def best_match(flows: DataFrame, rules: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Add rule_score, rule_name, rule_attack, rule_severity.

    The strongest rule wins and, among equals, the earliest in the list. The name
    columns are null when no rule fires.
    """
    scored = flows.withColumn("_best", _strongest(rules))
    score = F.coalesce("_best.score", F.lit(0.0))
    fired = score > 0
    return scored.withColumns(
        {
            "rule_score": score,
            "rule_name": F.when(fired, F.col("_best.name")),
            "rule_attack": F.when(fired, F.col("_best.attack")),
            "rule_severity": F.when(fired, fn.rule_severity(score)),
        }
    ).drop("_best")


def rule_alerts(flows: DataFrame, rules: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """One alert per flow that any rule fires on; other columns are kept."""
    return (
        best_match(flows, rules)
        .where("rule_score > 0")
        .withColumnsRenamed({"rule_attack": "attack_type", "rule_severity": "severity"})
        .withColumns(
            {
                "confidence": F.col("rule_score"),
                "score": F.col("rule_score"),
                "detector": F.concat(F.lit("rule:"), F.col("rule_name")),
            }
        )
        .drop("rule_score", "rule_name")
    )


def hit_counts(flows: DataFrame, rules: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Hits per rule, rules without hits included: one row of sums, then unpivoted."""
    totals = flows.agg(*[F.count_if(hit_column(r)).alias(r.name) for r in rules])
    return totals.unpivot([], [r.name for r in rules], "rule", "hits").select(
        "rule", F.coalesce("hits", F.lit(0)).alias("hits")
    )


def _padded(rules: Sequence[Signature]) -> list[Column]:
    nothing = F.lit(None).cast("double")
    return [*[r.confidence() for r in rules], nothing, nothing]
