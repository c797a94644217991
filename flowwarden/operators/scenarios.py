"""Attack scenarios: indicator coverage per source and campaign stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.operators.signatures import SIGNATURES, hit_column

# --- fixed values: scenario indicators and campaign stages ---
INDICATORS = {
    "host_scan": ["high_rate_scan", "unusual_port"],
    "replay_attack": ["duplicate_unsolicited", "timing_attack"],
    "command_injection": ["broadcast_write", "config_change_fc", "unknown_function_code"],
    "flooding_dos": ["flooding", "error_storm"],
    "mitm_manipulation": ["error_storm"],
}
STAGES = [
    (0, 100, "scan"),
    (80, 200, "replay"),
    (180, 300, "command_injection"),
    (280, 400, "flooding"),
]


def scenario_coverage(flows: DataFrame, indicators: dict[str, list[str]] = INDICATORS) -> DataFrame:
    """Share of each scenario's indicators seen per source; unmatched ones are left out.

    Rule hits are reduced to one flag per source and rule before anything is unfolded.
    """
    seen = flows.groupBy("src_ip").agg(
        *[F.bool_or(hit_column(r)).alias(r.name) for r in SIGNATURES]
    )
    known = {r.name for r in SIGNATURES}
    rows = []
    for scenario, rules in indicators.items():
        hits = sum((F.col(r).cast("int") for r in rules if r in known), F.lit(0))
        rows.append(
            F.struct(
                F.lit(scenario).alias("scenario"),
                hits.cast("bigint").alias("matched"),
                (hits / F.lit(len(rules))).alias("coverage"),
            )
        )
    return seen.select("src_ip", F.inline(F.array(*rows))).where("matched > 0")


def active_stages(steps: DataFrame, stages: list[tuple[int, int, str]] = STAGES) -> DataFrame:
    """Campaign stages open at each step (first step included, last one not)."""
    table = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("stage"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                F.lit(kind).alias("attack_type"),
            )
            for i, (lo, hi, kind) in enumerate(stages)
        ]
    )
    open_now = F.filter(table, lambda s: (F.col("step") >= s["lo"]) & (F.col("step") < s["hi"]))
    return steps.select("*", F.inline(open_now)).drop("lo", "hi")
