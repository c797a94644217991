"""Protocol messages to connection summaries, and the notices raised on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.operators.slices import previous_row

BURST_GAP_US = 100_000
FLOOD_RATE = 100.0
NOTICE_SCORE = 0.60
WRITE_CODES = [2, 3]


def broadcast_target() -> Column:
    return (F.col("resp_p") == 20000) & (F.col("resp_h") == "255.255.255.255")


def code_set() -> Column:
    """The set of one-byte function codes as a bitmap of four longs, so that rows, tasks and
    connections of any size combine into 32 bytes."""
    code = F.col("fc").cast("int")
    bit = F.expr("shiftleft(1L, fc % 64)")
    return F.array(*[F.coalesce(F.bit_or(F.when(F.floor(code / 64) == i, bit)), F.lit(0)) for i in range(4)])


def codes_of(bitmap: Column) -> Column:
    """The codes of a bitmap, ascending."""
    every = F.sequence(F.lit(0), F.lit(255))
    word = lambda c: F.get(bitmap, F.floor(c / 64).cast("int"))
    return F.filter(every, lambda c: F.call_function("getbit", word(c), c % 64) == 1)


def _totals() -> list[Column]:
    """What needs no order: one aggregate per connection, combined before the shuffle."""
    sent = F.col("is_orig")
    return [
        F.min("t_us").alias("first_us"),
        F.max("t_us").alias("last_us"),
        F.min("orig_h").alias("orig_h"),
        F.min("resp_h").alias("resp_h"),
        F.min("resp_p").alias("resp_p"),
        F.count_if(sent).alias("orig_pkts"),
        F.count_if(~sent).alias("resp_pkts"),
        F.sum(F.when(sent, F.col("bytes")).otherwise(0)).alias("orig_bytes"),
        F.sum(F.when(sent, 0).otherwise(F.col("bytes"))).alias("resp_bytes"),
        code_set().alias("codes"),
        F.bool_or(broadcast_target()).alias("is_broadcast"),
        F.count_if("is_error").alias("error_count"),
    ]


def _gaps() -> list[Column]:
    """Inter-arrival times; needs `gap`, the time since the connection's message before."""
    return [
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap_mean"),
        F.coalesce(F.var_pop("gap"), F.lit(0.0)).alias("gap_var"),
        F.count_if(F.col("gap") < BURST_GAP_US).alias("burst_count"),
    ]


def _counted() -> list[Column]:
    codes = codes_of(F.col("codes"))
    return [
        F.col("uid"),
        F.col("first_us").alias("t_us"),
        *[F.col(c) for c in ("orig_h", "resp_h", "resp_p")],
        ((F.col("last_us") - F.col("first_us")) / 1e6).alias("duration"),
        *[F.col(c) for c in ("orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes")],
        codes.cast("array<int>").alias("function_codes"),
        F.size(codes).cast("bigint").alias("unique_fc_count"),
        F.col("orig_pkts").alias("request_count"),
        F.col("resp_pkts").alias("response_count"),
        F.col("is_broadcast"),
    ]


def summarise(merged: DataFrame, *more: str) -> DataFrame:
    """Connection records from totals and gaps."""
    return merged.select(
        *_counted(),
        *more,
        (F.col("gap_mean") / 1e6).alias("inter_arrival_mean"),
        (F.sqrt("gap_var") / 1e6).alias("inter_arrival_std"),
        "burst_count",
        "error_count",
    )


def connection_totals(messages: DataFrame) -> DataFrame:
    """Connection records without inter-arrival times: one aggregate, no order, no slices."""
    merged = messages.groupBy("uid").agg(*_totals())
    return merged.select(*_counted(), "error_count")


def connections(messages: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Summarise the messages of each connection (`uid`).

    The time of the message before comes from slices, so the messages of one connection are
    never sorted in a single task; all else is one aggregate.
    """
    seen = previous_row(messages, ["uid"], "t_us", "event_id", ["t_us"], slice_rows)
    timed = seen.withColumn("gap", F.col("t_us") - F.col("prev_t_us"))
    return summarise(timed.groupBy("uid").agg(*_totals(), *_gaps()))


def code_histogram(messages: DataFrame) -> DataFrame:
    """How often each function code occurs per connection, as a map of at most 256 entries."""
    counts = messages.groupBy("uid", "fc").agg(F.count("*").alias("n"))
    return counts.groupBy("uid").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("fc", "n")))).alias("codes")
    )


def suspicious_codes(messages: DataFrame) -> DataFrame:
    """One notice per connection and unusual function code, at its first sighting."""
    return (
        messages.where(F.col("fc").isin(S.FC_SUSPICIOUS))
        .groupBy("uid", "fc")
        .agg(F.min("t_us").alias("t_us"), F.min("orig_h").alias("orig_h"))
        .select(
            F.format_string("%s-fc-%d", "uid", "fc").alias("identifier"),
            "t_us",
            F.format_string(
                "Suspicious DNP3 function code 0x%02x from %s", "fc", "orig_h"
            ).alias("message"),
        )
    )


def broadcast_writes(messages: DataFrame) -> DataFrame:
    """One notice per connection that writes to the broadcast address."""
    return (
        messages.where(broadcast_target() & F.col("fc").isin(WRITE_CODES))
        .groupBy("uid")
        .agg(F.min("t_us").alias("t_us"), F.min("orig_h").alias("orig_h"))
        .select(
            F.concat("uid", F.lit("-bcast")).alias("identifier"),
            "t_us",
            F.concat(F.lit("DNP3 broadcast WRITE from "), "orig_h").alias("message"),
        )
    )


def link_rate() -> Column:
    """Packets per second of a summary; null without a duration."""
    packets = F.col("orig_pkts") + F.col("resp_pkts")
    return F.when(F.col("duration") > 0, F.try_divide(packets, F.col("duration")))


def floods(summaries: DataFrame, rate: float = FLOOD_RATE) -> DataFrame:
    return summaries.where(link_rate() > rate).select(
        F.concat("uid", F.lit("-flood")).alias("identifier"),
        "t_us",
        "orig_h",
        link_rate().alias("rate"),
    )


def anomaly_notices(records: DataFrame, limit: float = NOTICE_SCORE) -> DataFrame:
    return records.where(F.col("total_score") >= limit).select(
        F.col("uid").alias("identifier"),
        "t_us",
        "orig_h",
        "resp_h",
        F.format_string(
            "ICS Anomaly score=%.2f rules=%s",
            "total_score",
            F.array_join("rules_fired", ","),
        ).alias("message"),
    )
