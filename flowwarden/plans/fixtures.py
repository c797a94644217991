"""Flow and message tables derived from the provided parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.functions.features import learned_severity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(column: str) -> str:
    # calendar fields of a zone-free timestamp: independent of the session time zone
    t = f"cast({column} AS timestamp_ntz)"
    return (
        f"(unix_date(to_date({t})) * 86400000000L + (hour({t}) * 3600 + minute({t}) * 60) * 1000000L"
        f" + cast(extract(SECOND FROM {t}) * 1000000 AS bigint))"
    )


UID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " cast(round(l_extendedprice * 100) AS bigint)) AS uid"
)
FLOW_COLUMNS = [
    UID,
    f"{_micros('l_shipdate')} + (l_orderkey*37 + l_linenumber*7) % 86400 * 1000000 AS ts_us",
    "CASE WHEN l_suppkey % 6 = 0 THEN '10.0.0.1' ELSE concat('10.0.', l_suppkey % 4 + 2, '.', l_suppkey % 254 + 1) END AS src_ip",
    "CASE WHEN l_partkey % 11 = 0 THEN '10.0.1.255' ELSE concat('10.0.1.', l_partkey % 8 + 1) END AS dst_ip",
    "l_quantity * l_quantity / 200.0D AS flow_duration",
    "cast(CASE WHEN l_partkey % 9 = 4 THEN l_quantity * 100 ELSE l_quantity END AS int) AS pkt_count",
    "cast(round(l_extendedprice) AS bigint) AS byte_count",
    "0D AS bytes_per_pkt",
    "cast(CASE WHEN l_partkey % 13 = 0 THEN l_orderkey % 1023 + 1 ELSE 1024 + (l_orderkey * 7919) % 64000 END AS int) AS src_port",
    "cast(CASE WHEN l_linenumber % 5 = 4 THEN 49152 + l_orderkey % 1000 ELSE 20000 END AS int) AS dst_port",
    "cast(CASE WHEN l_suppkey % 10 = 9 THEN 0 ELSE 1 END AS int) AS protocol_id",
    "cast(CASE l_partkey % 12 WHEN 0 THEN 3 WHEN 1 THEN 19 WHEN 2 THEN 130 WHEN 3 THEN 14 WHEN 4 THEN 150 WHEN 5 THEN 129 WHEN 6 THEN 65 WHEN 7 THEN 40 ELSE 1 END AS int) AS function_code",
    "cast(l_suppkey % 7 + 1 AS int) AS unique_fc_count",
    "round(l_discount * 10, 4) AS req_resp_ratio",
    "cast((l_orderkey % 100) * 20 AS double) AS inter_arrival_mean",
    "cast(l_linenumber * 10 AS double) AS inter_arrival_std",
    "cast(CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS int) AS is_broadcast",
    "cast(l_suppkey % 3 AS int) AS direction",
    "cast(CASE WHEN l_partkey % 9 = 4 THEN l_quantity * 25 ELSE l_linenumber END AS int) AS burst_count",
    "round(l_tax * 10, 4) AS error_rate",
    "CASE l_partkey % 12 WHEN 0 THEN 'command_injection' WHEN 1 THEN 'replay' WHEN 2 THEN 'replay' WHEN 3 THEN 'command_injection' WHEN 4 THEN 'scan' ELSE CASE WHEN l_partkey % 9 = 4 THEN 'flooding' WHEN l_partkey % 13 = 0 THEN 'mitm' ELSE 'normal' END END AS label",
]


def project_flows(lineitem: DataFrame) -> DataFrame:
    order = [f.name for f in S.FLOWS.fields]
    return lineitem.selectExpr(*FLOW_COLUMNS).select(order)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per line item, spread over years."""
    return project_flows(table(spark, sf_dir, "lineitem"))


def busy_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flows with time compressed 100,000 times, so hosts act within seconds."""
    return flows(spark, sf_dir).withColumn("ts_us", F.expr("ts_us div 100000"))


LEARNED_SCORE = "least(1.0D, 0.1D + error_rate * 0.6D + burst_count / 2500.0D)"
LEARNED_CLASS = (
    "CASE WHEN burst_count > 500 THEN 'flooding' WHEN function_code >= 129 THEN 'scan'"
    " WHEN function_code IN (14, 19) THEN 'command_injection' ELSE 'normal' END"
)


def learned(rows: DataFrame) -> DataFrame:
    """Flows with what a classifier adds, from a plain formula that SQL can repeat: the third
    detector's part in the mix does not depend on how a forest was grown."""
    sure = f"{LEARNED_CLASS} <> 'normal' AND {LEARNED_SCORE} >= 0.35D"
    return rows.withColumns(
        {
            "ml_probability": F.expr(LEARNED_SCORE),
            "ml_attack": F.expr(f"CASE WHEN {sure} THEN {LEARNED_CLASS} END"),
            "ml_severity": F.when(F.expr(sure), learned_severity(F.expr(LEARNED_SCORE))),
        }
    )


MESSAGE_COLUMNS = [
    "event_id",
    "concat('C', user_id, '-', weekofyear(ts)) AS uid",
    f"{_micros('ts')} div 100000 AS t_us",
    "concat('10.0.2.', user_id % 254 + 1) AS orig_h",
    "CASE WHEN user_id % 7 = 0 THEN '255.255.255.255' ELSE concat('10.0.1.', user_id % 8 + 1) END AS resp_h",
    "cast(CASE WHEN user_id % 10 = 9 THEN 502 ELSE 20000 END AS int) AS resp_p",
    "cast(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN event_id % 40 ELSE 129 + event_id % 2 END AS int) AS fc",
    "event_type <> 'signup' AS is_orig",
    "event_type = 'error' AS is_error",
    "cast(round(value) AS bigint) AS bytes",
]


def project_messages(events: DataFrame) -> DataFrame:
    return events.selectExpr(*MESSAGE_COLUMNS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_messages(table(spark, sf_dir, "events"))


LINK_COLUMNS = [
    "ts_us AS t_us",
    "uid",
    "src_ip AS orig_h",
    "dst_ip AS resp_h",
    "dst_port AS resp_p",
    "flow_duration AS duration",
    "cast(pkt_count - pkt_count div 3 AS bigint) AS orig_pkts",
    "cast(pkt_count div 3 AS bigint) AS resp_pkts",
    "byte_count - byte_count div 3 AS orig_bytes",
    "byte_count div 3 AS resp_bytes",
    "array(function_code) AS function_codes",
    "cast(unique_fc_count AS bigint) AS unique_fc_count",
    "cast(pkt_count div 2 AS bigint) AS request_count",
    "cast(pkt_count div (direction * 3 + 1) AS bigint) AS response_count",
    "is_broadcast = 1 AS is_broadcast",
    "inter_arrival_mean / 25000D AS inter_arrival_mean",
    "inter_arrival_std / 1000D AS inter_arrival_std",
    "cast(burst_count AS bigint) AS burst_count",
    "cast(floor(round(error_rate * 10) * pkt_count / 40) AS bigint) AS error_count",
]


def link_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection summaries as a protocol monitor would log them, one per flow."""
    return flows(spark, sf_dir).selectExpr(*LINK_COLUMNS)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged response decisions: episodes of steps with action, truth and alert data."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_suppkey, l_linenumber) AS episode_id",
        "cast(row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey) AS int) AS step",
        "cast((l_partkey + l_suppkey) % 5 AS int) AS action",
        "l_partkey % 12 < 5 AS is_attack",
        "cast(l_orderkey % 4 + 1 AS int) AS severity",
        "0.5D + (l_orderkey % 50) / 100D AS confidence",
    )


def campaign_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        UID,
        "cast(l_orderkey % 420 AS int) AS step",
    )
