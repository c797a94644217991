"""Log folders written from the flow fixture, with the usual defects of real logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _record(**changes: Column | None) -> Column:
    fields: dict[str, Column] = {
        "uid": F.col("uid"),
        "ts": F.col("ts_us") / 1e6,
        "id.orig_h": F.col("src_ip"),
        "id.resp_h": F.col("dst_ip"),
        "id.orig_p": F.col("src_port"),
        "id.resp_p": F.col("dst_port"),
        "duration": F.col("flow_duration"),
        "orig_pkts": F.expr("pkt_count - pkt_count div 3"),
        "resp_pkts": F.expr("pkt_count div 3"),
        "orig_bytes": F.expr("byte_count - byte_count div 3"),
        "resp_bytes": F.expr("byte_count div 3"),
    }
    for name, value in changes.items():
        key = name.replace("id_", "id.")
        if value is None:
            del fields[key]
        else:
            fields[key] = value
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def connection_lines(flows: DataFrame) -> DataFrame:
    """Lines of a connection log; the case of a flow depends on its source port."""
    case = F.col("src_port") % 50
    extra = (
        F.when(case == 0, F.lit("# separator"))
        .when(case == 1, F.lit("   "))
        .when(case == 2, F.lit('{"uid": "broken'))
        .when(case == 3, F.lit('{"ts": 1.0}'))
        .when(case == 4, _record(orig_pkts=F.lit(999999)))
    )
    line = (
        F.when(case == 5, _record(duration=None))
        .when(case == 6, _record(id_orig_p=F.col("src_port").cast("string")))
        .when(case == 7, _record(orig_pkts=F.lit("many")))
        .when(case == 8, _record(id_resp_h=None))
        .otherwise(_record())
    )
    return flows.select(F.explode(F.array_compact(F.array(extra, line))).alias("value"))


def protocol_lines(flows: DataFrame) -> DataFrame:
    case = F.col("src_port") % 50

    def line(code: Column) -> Column:
        return F.to_json(F.struct("uid", code.alias("fc_request")))

    extra = F.when(case == 10, line(F.lit(99)))
    main = F.when(case == 9, line(F.lit("abc"))).otherwise(line(F.col("function_code")))
    return flows.where("dst_port = 20000").select(
        F.explode(F.array_compact(F.array(extra, main))).alias("value")
    )


def link_lines(summaries: DataFrame) -> DataFrame:
    row = F.struct(
        (F.col("t_us") / 1e6).alias("ts"),
        "uid",
        F.col("orig_h").alias("id.orig_h"),
        F.col("resp_h").alias("id.resp_h"),
        F.col("resp_p").alias("id.resp_p"),
        "duration",
        "orig_pkts",
        "resp_pkts",
        "orig_bytes",
        "resp_bytes",
        "function_codes",
        "unique_fc_count",
        "request_count",
        "response_count",
        "is_broadcast",
        "inter_arrival_mean",
        "inter_arrival_std",
        "burst_count",
        "error_count",
    )
    return summaries.select(F.to_json(row).alias("value"))
