"""Structured Streaming forms of the stateful operators.

Stateless work, plain windows and suppression run on the engine's own streaming operators.
Ordered per-key state waits for the watermark (see `ordered`), so micro-batches may be of
any size and their rows in any order within the delay. `ended` and `run_to_end` close a
stream: a marker row moves the watermark past everything, and what is open comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.functions.features import enrich
from flowwarden.operators import baseline as B
from flowwarden.operators import connections as C
from flowwarden.operators import link_rules as L
from flowwarden.operators import response as R
from flowwarden.operators.ensemble import alerts, detector_scores, ensemble
from flowwarden.operators.quality import attack_truth
from flowwarden.session import scratch_path
from flowwarden.streaming.ordered import Connections, HostCooldown, HostMoments

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Event time of the end-of-input marker: 2200-01-01.
END_US = 7_258_118_400_000_000
#: Buckets of connections; each is a key of the state store.
BUCKETS = 512


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros(column)).withWatermark(
        "event_time", delay
    )


def given(timed: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet a condition, without the end marker. The test is one expression on
    the event time, so it is not moved below the watermark, which must see the marker."""
    real = F.col("event_time") < F.timestamp_micros(F.lit(END_US))
    return timed.where(F.when(real, F.when(condition, F.lit(1))).isNotNull())


# ---- running a stream ----


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Process what is there, append to Parquet files, stop. Returns how many rows of state
    operators came later than the watermark and were dropped."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = [p["stateOperators"] for p in query.recentProgress]
    return sum(s.get("numRowsDroppedByWatermark", 0) for ops in found for s in ops)


def ended(stream: DataFrame, column: str, markers: str) -> DataFrame:
    """The stream and, once `finish` was called, one more row: all null but for the time in
    `column`, which lies beyond all others. Take the watermark before that row is filtered."""
    spark = stream.sparkSession
    spark.createDataFrame([], f"`{column}` long").write.mode("append").parquet(markers)
    end = spark.readStream.schema(f"`{column}` long").parquet(markers)
    nulls = [
        F.col(f.name) if f.name == column else F.lit(None).cast(f.dataType).alias(f.name)
        for f in stream.schema.fields
    ]
    return stream.unionByName(end.select(nulls))


def finish(spark: SparkSession, column: str, markers: str) -> None:
    spark.createDataFrame([(END_US,)], f"`{column}` long").write.mode("append").parquet(markers)


def run_to_end(stream: DataFrame, column: str, path: str, checkpoint: str, markers: str) -> int:
    """Process what is there and then the end of the input. Returns the number of late rows."""
    late = run_to_files(stream, path, checkpoint)
    finish(stream.sparkSession, column, markers)
    return late + run_to_files(stream, path, checkpoint)


class timer_state_store:  # noqa: N801 - used as a context manager
    """Use the state store that timers need, and restore the setting afterwards."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.old = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_: object) -> None:
        if self.old is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.old)


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str, str]:
    """Output, checkpoint and end-marker folders for one run."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint", f"{base}/end"


# ---- the jobs ----


def detect(
    flows: DataFrame, baseline: B.Baseline, forest_score: Column | None = None
) -> DataFrame:
    """Ensemble alerts over an unbounded flow feed with a fixed baseline: stateless. Flows that
    carry a classifier's `ml_*` columns are judged by all three detectors."""
    scored = detector_scores(enrich(flows), baseline, running=False, forest_score=forest_score)
    return alerts(ensemble(scored))


def host_scores(
    flows: DataFrame,
    start: B.Baseline = B.NO_BASELINE,
    delay: str = "2 minutes",
    forget_seconds: int = 7 * 86_400,
) -> DataFrame:
    """z anomaly scores against each host's own earlier flows, scored before update. A host
    that is silent for `forget_seconds` starts anew. Needs `timer_state_store`."""
    timed = given(with_event_time(enrich(flows), "ts_us", delay), F.col("uid").isNotNull())
    job = HostMoments(list(S.FEATURES), forget_seconds * 1_000_000)
    ready = timed.select(
        "src_ip", "ts_us", "event_time", F.md5("uid").alias("tie"), "uid",
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in S.FEATURES],
    )
    seen = ready.groupBy("src_ip").transformWithStateInPandas(job, job.columns(), "append", "eventtime")
    return B.with_zscores(B.with_priors(seen, start)).select(
        "uid", "src_ip", "prior_n", B.anomaly_score().alias("z_score")
    )


def cooldown_decisions(
    alert_stream: DataFrame,
    cooldown_seconds: float = R.COOLDOWN_SECONDS,
    critical_hosts: tuple[str, ...] = R.CRITICAL_HOSTS,
    protected_ports: tuple[int, ...] = (),
    delay: str = "2 minutes",
) -> DataFrame:
    """Response decisions in time order per host, over any micro-batches: uid, src_ip, success
    and notes. A host is remembered while it is closed. Needs `timer_state_store`."""
    ready = R.prepared(alert_stream, critical_hosts, protected_ports)
    timed = given(with_event_time(ready, "ts_us", delay), F.col("uid").isNotNull())
    job = HostCooldown(int(cooldown_seconds * 1_000_000), ["action"])
    judged = timed.groupBy("src_ip").transformWithState(job, job.columns(), "append", "eventtime")
    return R.verdicts(judged)


def expired_rules(
    rules: DataFrame, delay: str = "1 minute", seconds: int = R.ISOLATION_SECONDS
) -> DataFrame:
    """Drop rules whose time has passed: each opens a window that ends when the rule does, and
    comes out when the watermark reaches that end. All in the JVM, one row of state a rule."""
    timed = given(with_event_time(rules, "installed_us", delay), F.col("rule") == "drop")
    lasting = F.session_window("event_time", f"{seconds} seconds")
    return timed.groupBy("rule_id", "uid", lasting).agg(
        F.first("match_src").alias("host"), (F.max("installed_us") + seconds * 1_000_000).alias("expires_us")
    ).select("rule_id", "host", "expires_us")


def closed_connections(
    messages: DataFrame, idle_seconds: float = 10.0, delay: str = "1 second", buckets: int = BUCKETS
) -> DataFrame:
    """Connection records, when a connection has been idle long enough; `seen_at` is the
    stream's clock then. State is read and written by bucket of connections. Needs
    `timer_state_store`."""
    timed = given(with_event_time(messages, "t_us", delay), F.col("uid").isNotNull())
    job = Connections(int(idle_seconds * 1_000_000), C.BURST_GAP_US)
    ready = timed.select(
        F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("bucket"),
        "uid", "t_us", "event_time", F.col("event_id").cast("bigint").alias("event_id"), "orig_h", "resp_h",
        F.col("resp_p").cast("bigint").alias("resp_p"), F.coalesce(F.col("fc").cast("bigint"), F.lit(-1)).alias("fc"),
        "is_orig", "is_error", F.coalesce(F.col("bytes").cast("bigint"), F.lit(0)).alias("bytes"),
        F.coalesce(C.broadcast_target(), F.lit(False)).alias("broadcast"),
    )
    found = ready.groupBy("bucket").transformWithState(
        job, job.columns(), "append", "eventtime", eventTimeColumnName="seen_at"
    )
    return C.summarise(found, "seen_at")


def ticks(outcomes: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Counts per closed one-second window."""
    truth, fired = attack_truth(), F.col("fired")
    return (
        with_event_time(outcomes, "ts_us", delay)
        .groupBy(F.window("event_time", "1 second"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(fired).alias("alerts"),
            F.count_if(truth & fired).alias("tp"),
            F.count_if(truth & ~fired).alias("fn"),
        )
        .select(F.unix_micros("window.start").alias("tick_us"), "total", "alerts", "tp", "fn")
    )


def message_notices(timed: DataFrame) -> DataFrame:
    """Every notice that a message itself gives rise to, repeats included."""
    odd = F.when(
        F.col("fc").isin(S.FC_SUSPICIOUS), F.format_string("%s-fc-%d", "uid", "fc")
    )
    write = F.when(
        C.broadcast_target() & F.col("fc").isin(C.WRITE_CODES), F.concat("uid", F.lit("-bcast"))
    )
    # explode_outer: an inner one would filter its input, the end marker with it
    every = F.explode_outer(F.array_compact(F.array(odd, write)))
    return given(timed.select("event_time", "t_us", every.alias("identifier")), F.col("identifier").isNotNull())


def connection_notices(closed: DataFrame) -> DataFrame:
    """Flood and anomaly notices of closed connections."""
    time = F.col("seen_at").alias("event_time")
    flood = F.when(C.link_rate() > C.FLOOD_RATE, F.concat("uid", F.lit("-flood")))
    odd = F.when(L.total_score() >= C.NOTICE_SCORE, F.col("uid"))
    return closed.select(time, "t_us", F.explode(F.array_compact(F.array(flood, odd))).alias("identifier"))


def suppressed_notices(
    messages: DataFrame, delay: str = "1 minute", idle_seconds: float = 10.0
) -> DataFrame:
    """All four kinds of notice, one per identifier while repeats keep coming within the delay:
    the notices of messages and, behind a first stateful operator that closes connections,
    those of whole connections, in one append-mode query. Needs `timer_state_store`."""
    own = message_notices(with_event_time(messages, "t_us", delay))
    whole = connection_notices(closed_connections(messages, idle_seconds, delay))
    return own.unionByName(whole).dropDuplicatesWithinWatermark(["identifier"])
