"""Readers for JSON-lines logs and the flows made from them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden import schema as S
from flowwarden.functions.features import broadcast_address, protocol_of_port, safe_ratio


def read_json_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSON-lines log; blank, comment and broken lines and rows without
    a uid are skipped. `_at` is the record's place: file, split and line order."""
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("_at"),
    )
    return (
        lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
        .select(F.from_json("line", schema).alias("r"), "_at")
        .where(F.col("r.uid").isNotNull())
        .select("r.*", "_at")
    )


def read_optional_log(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """The log, or no rows when there is none."""
    if path is not None:
        try:
            return read_json_log(spark, path, schema)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    place = T.StructType(
        [
            T.StructField("file", T.StringType()),
            T.StructField("block", T.LongType()),
            T.StructField("line", T.LongType()),
        ]
    )
    return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_at", place)]))


def last_record(log: DataFrame) -> DataFrame:
    """The newest record of every uid; aggregated before the shuffle."""
    fields = [c for c in log.columns if c not in ("uid", "_at")]
    packed = F.struct(*[F.col(f"`{c}`") for c in fields])
    return (
        log.groupBy("uid")
        .agg(F.max_by(packed, F.col("_at")).alias("r"))
        .select("uid", *[F.col(f"r.`{c}`").alias(c) for c in fields])
    )


def _number(name: str, kind: str) -> Column:
    return F.col(f"`{name}`").try_cast(kind)


def _bad(name: str, kind: str) -> Column:
    return F.col(f"`{name}`").isNotNull() & _number(name, kind).isNull()


# numeric fields of the two logs and their types
_NUMBERS = {
    "ts": "double",
    "duration": "double",
    "id.orig_p": "int",
    "id.resp_p": "int",
    "orig_pkts": "bigint",
    "resp_pkts": "bigint",
    "orig_bytes": "bigint",
    "resp_bytes": "bigint",
    "fc_request": "int",
}


def connection_flows(connections: DataFrame, protocol: DataFrame) -> DataFrame:
    """Flows from connection records, with the function code of the protocol log.

    A row with a field that should be a number but is not is dropped; absent fields
    take their defaults.
    """
    joined = last_record(connections).join(last_record(protocol), "uid", "left")
    broken = F.lit(False)
    for name, kind in _NUMBERS.items():
        broken = broken | _bad(name, kind)

    def number(name: str) -> Column:
        return F.coalesce(_number(name, _NUMBERS[name]), F.lit(0).cast(_NUMBERS[name]))

    packets = number("orig_pkts") + number("resp_pkts")
    size = number("orig_bytes") + number("resp_bytes")
    target = F.coalesce("`id.resp_h`", F.lit("0.0.0.0"))
    return joined.where(~broken).select(
        "uid",
        F.round(number("ts") * 1e6).cast("bigint").alias("ts_us"),
        F.coalesce("`id.orig_h`", F.lit("0.0.0.0")).alias("src_ip"),
        target.alias("dst_ip"),
        number("duration").alias("flow_duration"),
        packets.cast("int").alias("pkt_count"),
        size.alias("byte_count"),
        safe_ratio(size, packets).alias("bytes_per_pkt"),
        number("id.orig_p").alias("src_port"),
        number("id.resp_p").alias("dst_port"),
        protocol_of_port(number("id.resp_p")).alias("protocol_id"),
        number("fc_request").alias("function_code"),
        F.lit(1).alias("unique_fc_count"),
        safe_ratio(number("orig_pkts"), packets).alias("req_resp_ratio"),
        F.lit(0.0).alias("inter_arrival_mean"),
        F.lit(0.0).alias("inter_arrival_std"),
        broadcast_address(target).alias("is_broadcast"),
        F.lit(0).alias("direction"),
        F.lit(0).alias("burst_count"),
        F.lit(0.0).alias("error_rate"),
        F.lit(S.LABELS[0]).alias("label"),
    )


def log_flows(spark: SparkSession, connection_path: str, protocol_path: str | None = None) -> DataFrame:
    return connection_flows(
        read_json_log(spark, connection_path, S.CONNECTION_LOG),
        read_optional_log(spark, protocol_path, S.PROTOCOL_LOG),
    )


def link_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flows from the connection summary log: seconds become milliseconds, the request
    share and the error share come from its counters."""
    log = last_record(read_json_log(spark, path, S.LINK_LOG))

    def value(name: str, default: object) -> Column:
        return F.coalesce(F.col(f"`{name}`"), F.lit(default))

    packets = value("orig_pkts", 0) + value("resp_pkts", 0)
    size = value("orig_bytes", 0) + value("resp_bytes", 0)
    requests = value("request_count", 0)
    asked = requests + value("response_count", 0)
    return log.select(
        "uid",
        F.round(value("ts", 0.0) * 1e6).cast("bigint").alias("ts_us"),
        value("id.orig_h", "0.0.0.0").alias("src_ip"),
        value("id.resp_h", "0.0.0.0").alias("dst_ip"),
        value("duration", 0.0).alias("flow_duration"),
        packets.cast("int").alias("pkt_count"),
        size.alias("byte_count"),
        safe_ratio(size, packets).alias("bytes_per_pkt"),
        value("id.orig_p", 0).alias("src_port"),
        value("id.resp_p", 0).alias("dst_port"),
        protocol_of_port(value("id.resp_p", 0)).alias("protocol_id"),
        F.coalesce(F.try_element_at("function_codes", F.lit(1)), F.lit(0)).alias("function_code"),
        value("unique_fc_count", 0).cast("int").alias("unique_fc_count"),
        safe_ratio(requests, asked, 0.5).alias("req_resp_ratio"),
        (value("inter_arrival_mean", 0.0) * 1000).alias("inter_arrival_mean"),
        (value("inter_arrival_std", 0.0) * 1000).alias("inter_arrival_std"),
        value("is_broadcast", False).cast("int").alias("is_broadcast"),
        F.lit(2).alias("direction"),
        value("burst_count", 0).cast("int").alias("burst_count"),
        safe_ratio(value("error_count", 0), packets).alias("error_rate"),
        F.lit(S.LABELS[0]).alias("label"),
        value("anomaly_score", 0.0).alias("anomaly_score"),
        value("anomaly_label", S.LABELS[0]).alias("anomaly_label"),
    )
