"""Offline evaluation of response policies on logged decisions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.functions.features import state_vector

MAX_STEPS = 200
GAMMA = 0.95


def _clamp(low: float, value: Column, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def _next_state(s: Column, d: Column) -> Column:
    """State after one decision."""
    action = d["action"]

    def by_action(*values: float) -> Column:
        chain = F.when(action == 0, F.lit(values[0]))
        for i, v in enumerate(values[1:], 1):
            chain = chain.when(action == i, F.lit(v))
        return chain.otherwise(F.lit(0.0))

    alert = d["is_attack"]
    latency = F.when(action == 0, F.greatest(F.lit(5.0), s["latency_ms"] - 0.5)).otherwise(
        s["latency_ms"] + by_action(0.0, 2.0, 5.0, 10.0, 0.0)
    )
    return F.struct(
        d["step"].alias("step"),
        F.when(alert, F.least(s["alert_count"] + 1, F.lit(100)))
        .otherwise(F.greatest(s["alert_count"] - 1, F.lit(0)))
        .alias("alert_count"),
        F.when(alert, 0.9 * s["avg_severity"] + 0.1 * d["severity"])
        .otherwise(0.95 * s["avg_severity"])
        .alias("avg_severity"),
        F.when(alert, 0.9 * s["avg_confidence"] + 0.1 * d["confidence"])
        .otherwise(0.95 * s["avg_confidence"])
        .alias("avg_confidence"),
        action.alias("action"),
        _clamp(1.0, latency, 1000.0).alias("latency_ms"),
        F.lit(0.0).alias("packet_loss_pct"),
        F.when(action == 3, F.least(s["isolated_hosts"] + 1, F.lit(20)))
        .otherwise(s["isolated_hosts"])
        .alias("isolated_hosts"),
        _clamp(0.0, s["qos"] + by_action(0.02, -0.05, -0.10, -0.20, 0.0), 1.0).alias("qos"),
        s["qos"].alias("qos_before"),
        alert.alias("is_attack"),
        d["severity"].alias("severity"),
    )


def trajectories(decisions: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Network state after every step of every episode.

    An episode ends after `max_steps` steps and the next step starts afresh; such a part
    is the unit of work, so no episode collects more than `max_steps` rows.
    """
    part = F.floor((F.col("step") - 1) / max_steps).cast("int")
    action = F.greatest(F.lit(0), F.least(F.lit(4), F.col("action")))
    grouped = (
        decisions.withColumn("part", part)
        .groupBy("episode_id", "part")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "step",
                        action.alias("action"),
                        "is_attack",
                        "severity",
                        F.col("confidence").cast("double").alias("confidence"),
                    )
                )
            ).alias("d")
        )
    )
    start = F.struct(
        F.lit(0).alias("step"),
        F.lit(0).alias("alert_count"),
        F.lit(0.0).alias("avg_severity"),
        F.lit(0.0).alias("avg_confidence"),
        F.lit(0).alias("action"),
        F.lit(0.0).alias("latency_ms"),
        F.lit(0.0).alias("packet_loss_pct"),
        F.lit(0).alias("isolated_hosts"),
        F.lit(1.0).alias("qos"),
        F.lit(1.0).alias("qos_before"),
        F.lit(False).alias("is_attack"),
        F.lit(0).alias("severity"),
    )
    states = F.aggregate(
        "d",
        F.array(start),
        lambda acc, d: F.concat(acc, F.array(_next_state(F.element_at(acc, -1), d))),
    )
    return grouped.select("episode_id", "part", F.inline(states)).where("step > 0")


def _outcome() -> Column:
    attack, action = F.col("is_attack"), F.col("action")
    return (
        F.when(attack & (action > 0) & (action >= F.col("severity")), "tp")
        .when(attack, "fn")
        .when(action == 0, "tn")
        .otherwise("fp")
    )


def with_rewards(states: DataFrame) -> DataFrame:
    """Add outcome and reward; the service penalty uses the state before the action."""
    attack, action, severity = F.col("is_attack"), F.col("action"), F.col("severity")
    base = (
        F.when(attack & (action == 0), -2.0)
        .when(attack & (action > severity + 1), 2.0 - 0.3)
        .when(attack & (action >= severity), 2.0)
        .when(attack, 0.5)
        .when(action == 0, 1.0)
        .otherwise(-1.0)
    )
    return states.withColumns(
        {"outcome": _outcome(), "reward": base - 0.5 * (1.0 - F.col("qos_before"))}
    )


def episode_summaries(rewarded: DataFrame) -> DataFrame:
    counts = {c: F.count_if(F.col("outcome") == c) for c in ("tp", "fp", "tn", "fn")}
    return (
        rewarded.groupBy("episode_id", "part")
        .agg(
            F.count("*").alias("total_steps"),
            F.sum("reward").alias("total_reward"),
            F.avg("reward").alias("mean_reward"),
            *[c.alias(n) for n, c in counts.items()],
            F.max_by("qos", "step").alias("final_qos"),
        )
        .withColumns(
            {
                "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)),
                "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)),
            }
        )
    )


def policy_evaluation(summaries: DataFrame) -> DataFrame:
    tpr = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    fpr = F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    return summaries.agg(
        F.avg("total_reward").alias("mean_reward"),
        F.stddev_pop("total_reward").alias("std_reward"),
        F.avg(tpr).alias("mean_tpr"),
        F.avg(fpr).alias("mean_fpr"),
    )


def initial_weights(seed: int, sizes: Sequence[int] = (8, 64, 64, 5)) -> list:
    """Random (matrix, bias) pairs of the policy network, for use without a trained one."""
    rng = np.random.default_rng(seed)
    return [
        (rng.normal(0.0, np.sqrt(2.0 / (a + b)), (a, b)), np.zeros(b))
        for a, b in zip(sizes, sizes[1:])
    ]


def action_values(state: Column, weights: list) -> Column:
    """Value of every action: ReLU layers, linear output. Weights are a few kilobytes."""

    @F.pandas_udf("array<double>")
    def run(states: pd.Series) -> pd.Series:
        if states.empty:
            return pd.Series([], dtype=object)
        h = np.stack(states.to_numpy())
        for i, (w, b) in enumerate(weights):
            h = h @ w + b
            if i < len(weights) - 1:
                h = np.maximum(h, 0.0)
        return pd.Series(list(h))

    return run(state)


def greedy_actions(states: DataFrame, weights: list) -> DataFrame:
    """Best action for every state; the lowest number wins ties."""
    valued = states.withColumn("q", action_values(state_vector(), weights))
    return valued.withColumn(
        "greedy", (F.array_position("q", F.array_max("q")) - 1).cast("int")
    )


def td_targets(rewarded: DataFrame, weights: list, gamma: float = GAMMA) -> DataFrame:
    """Reward plus the discounted best value of the next state; the last step has none.

    Values follow the state after each step, so the next state of step t is its own row.
    """
    order = Window.partitionBy("episode_id", "part").orderBy("step")
    best = F.array_max(action_values(state_vector(), weights))
    done = F.lead("step").over(order).isNull()
    return (
        rewarded.withColumn("next_value", best)
        .withColumn("done", done)
        .withColumn(
            "target",
            F.col("reward")
            + F.when(F.col("done"), 0.0).otherwise(gamma * F.col("next_value")),
        )
    )


def curve_stats(
    losses: DataFrame, rewards: DataFrame, last_losses: int = 100, last_rewards: int = 20
) -> DataFrame:
    """Mean of the newest `last_losses` losses and `last_rewards` episode rewards."""
    recent_losses = losses.orderBy(F.col("step").desc()).limit(last_losses)
    recent_rewards = rewards.orderBy(F.col("episode").desc()).limit(last_rewards)
    reward = recent_rewards.agg(F.coalesce(F.avg("reward"), F.lit(0.0))).scalar()
    return recent_losses.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("mean_loss")).withColumn(
        "mean_reward", reward
    )
