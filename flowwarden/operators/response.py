"""Response decisions for alerts, the policy-rule ledger derived from them, and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.operators.cooldown import cooldown_status
from flowwarden.operators.slices import previous_row

# --- fixed values: response defaults ---
COOLDOWN_SECONDS = 5.0
ISOLATION_SECONDS = 300
RATE_KBPS = 100
CRITICAL_HOSTS = ("10.0.0.1", "10.0.0.10")
DROPPING = ("ISOLATE", "BLOCK")
BASE_LATENCY_MS = 5.0

# --- fixed values: (action, id prefix, rule, priority); the last two name a destination ---
POLICIES = [
    ("RATE_LIMIT", "rl-", "rate_limit", 5000),
    ("ISOLATE", "iso-", "drop", 9000),
    ("SEGMENT", "seg-", "reroute", 2000),
    ("BLOCK", "blk-", "drop", 10000),
]


def action_for(severity: Column) -> Column:
    known = F.create_map(
        *[F.lit(x) for sev, act in S.SEVERITY_ACTION.items() for x in (sev, act)]
    )
    return F.coalesce(F.try_element_at(known, severity.cast("int")), F.lit("MONITOR"))


def with_action(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("action", action_for(F.col("severity")))


def is_safe(
    critical_hosts: Sequence[str] = CRITICAL_HOSTS, protected_ports: Sequence[int] = ()
) -> Column:
    """False where dropping traffic would hit a critical host or a protected port."""
    protected = F.lit(False)
    if critical_hosts:
        protected = F.col("src_ip").isin(*critical_hosts) | F.col("dst_ip").isin(*critical_hosts)
    if protected_ports:
        protected = protected | F.col("dst_port").isin(*protected_ports)
    return ~(F.col("action").isin(*DROPPING) & protected)


def prepared(
    alerts: DataFrame,
    critical_hosts: Sequence[str] = CRITICAL_HOSTS,
    protected_ports: Sequence[int] = (),
) -> DataFrame:
    """Alerts with their action and whether it is safe."""
    ready = alerts if "action" in alerts.columns else with_action(alerts)
    return ready.withColumn("safe", is_safe(critical_hosts, protected_ports))


def verdicts(judged: DataFrame) -> DataFrame:
    """success and notes in place of the status taken, cooldown or unsafe."""
    notes = (
        F.when(F.col("status").isNull(), "no_time")
        .when(F.col("status") == "unsafe", "safety_constraint")
        .when(F.col("status") == "cooldown", "cooldown")
        .when(F.col("action") == "MONITOR", "log_only")
        .otherwise("")
    )
    return judged.withColumns({"success": F.coalesce(F.col("status") == "taken", F.lit(False)), "notes": notes}).drop("status")


def decide(
    alerts: DataFrame,
    cooldown_seconds: float = COOLDOWN_SECONDS,
    critical_hosts: Sequence[str] = CRITICAL_HOSTS,
    protected_ports: Sequence[int] = (),
) -> DataFrame:
    """Alerts with action, success and notes.

    Only a safe action outside the host's cooldown succeeds, and only those start a
    new cooldown.
    """
    ready = prepared(alerts, critical_hosts, protected_ports)
    return verdicts(cooldown_status(ready, int(cooldown_seconds * 1_000_000))).drop("safe")


def _policy(position: int) -> Column:
    return F.element_at(
        F.create_map(*[F.lit(x) for p in POLICIES for x in (p[0], p[position])]), F.col("action")
    )


def rule_id() -> Column:
    return F.concat(_policy(1), F.md5("uid"))


def policy_rules(decided: DataFrame, rate_kbps: int = RATE_KBPS) -> DataFrame:
    """One policy rule per successful action other than MONITOR."""
    nothing = F.create_map().cast("map<string,string>")
    metadata = (
        F.when(
            F.col("action") == "RATE_LIMIT",
            F.create_map(F.lit("rate_kbps"), F.lit(str(rate_kbps))),
        )
        .when(F.col("action") == "SEGMENT", F.create_map(F.lit("vlan"), F.lit("quarantine")))
        .otherwise(nothing)
    )
    return decided.where("success AND action <> 'MONITOR'").select(
        rule_id().alias("rule_id"),
        F.col("src_ip").alias("match_src"),
        F.when(F.col("action").isin("SEGMENT", "BLOCK"), F.col("dst_ip")).alias("match_dst"),
        _policy(2).alias("rule"),
        _policy(3).alias("priority"),
        F.when(F.col("action") == "BLOCK", 0).otherwise(ISOLATION_SECONDS).alias("idle_timeout"),
        metadata.alias("metadata"),
        F.col("ts_us").alias("installed_us"),
        "uid",
    )


def latest_time(df: DataFrame, column: str) -> int:
    return df.agg(F.max(column)).first()[0]


def with_expiry(
    ledger: DataFrame, as_of_us: int, isolation_seconds: int = ISOLATION_SECONDS
) -> DataFrame:
    """Add expires_us (null where the rule never expires) and expired at `as_of_us`."""
    end = F.col("installed_us") + isolation_seconds * 1_000_000
    return ledger.withColumn("expires_us", F.when(F.col("rule") == "drop", end)).withColumn(
        "expired", F.coalesce(F.col("expires_us") < as_of_us, F.lit(False))
    )


def ledger_events(
    ledger: DataFrame, revocations: DataFrame, isolation_seconds: int = ISOLATION_SECONDS
) -> DataFrame:
    """Installs and revocations of each host as one list. `at` orders it: installs come before
    revocations of the same instant. An install bears the time at which its rule expires."""
    rules = with_expiry(ledger, 0, isolation_seconds)
    installs = rules.select(
        F.col("match_src").alias("host"),
        F.col("installed_us").alias("t_us"),
        F.concat(F.lit("0"), "uid").alias("event"),
        F.lit("install").alias("kind"),
        "rule_id",
        "rule",
        "priority",
        "expires_us",
    )
    removals = revocations.select("host", "t_us", F.concat(F.lit("1"), "uid").alias("event"), F.lit("revoke").alias("kind"))
    both = installs.unionByName(removals, allowMissingColumns=True)
    return both.withColumn("at", F.col("t_us") * 2 + (F.col("kind") == "revoke").cast("int"))


def _lasting(time: Column, kind: str, expires: str) -> Column:
    """Is a host's entry, made by its last event, still there at a time?"""
    there = (F.col(kind) == "install") & (F.col(expires).isNull() | (time <= F.col(expires)))
    return F.coalesce(there, F.lit(False))


def active_rules(
    ledger: DataFrame,
    revocations: DataFrame,
    as_of_us: int,
    isolation_seconds: int = ISOLATION_SECONDS,
) -> DataFrame:
    """The rule in force on every host at `as_of_us`: its newest, unless that has expired or was
    revoked since. An older rule does not come back."""
    events = ledger_events(ledger, revocations, isolation_seconds).where(F.col("t_us") <= as_of_us)
    newest = F.max_by(
        F.struct("kind", "rule_id", "rule", "priority", F.col("t_us").alias("installed_us"), "expires_us"),
        F.struct("at", F.md5("event"), "event"),
    )
    last = events.groupBy("host").agg(newest.alias("r")).select("host", "r.*")
    return last.where(_lasting(F.lit(as_of_us), "kind", "expires_us")).drop("kind", "expires_us")


def revoke(
    ledger: DataFrame, revocations: DataFrame, isolation_seconds: int = ISOLATION_SECONDS
) -> DataFrame:
    """Outcome of each revocation: it removes the host's newest rule.

    The host's last event before it decides: it must be an install whose rule has not expired
    by then. Nothing installed, or nothing since the last revocation, gives false.
    """
    events = ledger_events(ledger, revocations, isolation_seconds)
    seen = previous_row(events, ["host"], "at", "event", ["kind", "rule_id", "expires_us"])
    done = _lasting(F.col("t_us"), "prev_kind", "prev_expires_us")
    return seen.where("kind = 'revoke'").select(
        "host",
        "t_us",
        F.expr("substring(event, 2)").alias("uid"),
        done.alias("revoked"),
        F.when(done, F.col("prev_rule_id")).alias("rule_id"),
    )


def audit_log(decided: DataFrame, keep: int | None = None) -> DataFrame:
    """Successful actions; `keep`, the log's retention, leaves the newest ones only."""
    entry = F.when(F.col("action") != "MONITOR", rule_id())
    taken = decided.where("success")
    if keep is not None:
        taken = taken.orderBy(F.col("ts_us").desc(), F.col("uid").desc()).limit(keep)
    return taken.select(
        "ts_us",
        "action",
        F.col("src_ip").alias("target"),
        "attack_type",
        "severity",
        "success",
        entry.alias("entry_id"),
        "notes",
        "uid",
    )


def host_qos(ledger: DataFrame, revoked: DataFrame, rate_kbps: int = RATE_KBPS) -> DataFrame:
    """Latency and rate cap of every touched host after its newest reset.

    A successful revocation resets the host; later installs add up again.
    """
    resets = (
        revoked.where("revoked").groupBy("host").agg(F.max("t_us").alias("reset_us"))
    )
    installs = ledger.select(
        F.col("match_src").alias("host"), F.col("installed_us").alias("t_us"), "rule", "uid"
    )
    live = F.coalesce(F.col("t_us") > F.col("reset_us"), F.lit(True))
    extra = F.when(F.col("rule") == "rate_limit", 2.0).when(F.col("rule") == "reroute", 5.0)
    rate = F.when(F.col("rule") == "drop", 0).when(F.col("rule") == "rate_limit", rate_kbps)
    capped = live & F.col("rule").isin("drop", "rate_limit")
    return (
        installs.join(resets, "host", "left")
        .groupBy("host")
        .agg(
            (
                F.lit(BASE_LATENCY_MS)
                + F.coalesce(F.sum(F.when(live, extra)), F.lit(0.0))
            ).alias("latency_ms"),
            F.lit(0.0).alias("loss_pct"),
            F.coalesce(
                F.max_by(F.when(capped, rate), F.when(capped, F.struct("t_us", "uid"))),
                F.lit(-1),
            ).alias("rate_kbps"),
        )
    )


def fleet_qos(hosts: DataFrame) -> DataFrame:
    return hosts.agg(
        F.count("*").alias("hosts"),
        F.coalesce(F.avg("latency_ms"), F.lit(BASE_LATENCY_MS)).alias("avg_latency_ms"),
        F.coalesce(F.avg("loss_pct"), F.lit(0.0)).alias("avg_loss_pct"),
    )


def alert_events(decided: DataFrame) -> DataFrame:
    """What a dashboard shows per alert."""
    return decided.select(
        F.md5("uid").alias("id"),
        "uid",
        "ts_us",
        "src_ip",
        "dst_ip",
        "attack_type",
        "severity",
        F.round("confidence", 3).alias("confidence"),
        F.round("score", 3).alias("score"),
        F.when(F.col("success"), F.col("action")).otherwise("BLOCKED").alias("action"),
        F.col("success").alias("mitigated"),
        F.col("label").alias("true_label"),
    )
