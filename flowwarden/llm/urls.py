"""URL filters as a temporal list join. DataFrame functions only.

A list is a log of dated entries: a host, a domain with all below it or a host and first path
segment is added or removed. Entries become validity intervals, and every capture is joined
as of its fetch date with the entries that were active then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Captures of one key in one month are dealt over so many groups.
SALTS = 16


def host(url: str) -> F.Column:
    """Lower-cased host without user, port and final dots; empty where there is none."""
    found = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def prefix(url: str) -> F.Column:
    """Host and first segment of the path."""
    first = F.regexp_extract(F.col(url), r"^[^:/?#]+://[^/?#]*/([^/?#]*)", 1)
    return F.concat(host(url), F.lit("/"), F.coalesce(first, F.lit("")))


def domains(url: str) -> F.Column:
    """The host and the domains above it, of two labels at least."""
    parts = F.split(host(url), r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    return F.when(F.size(parts) >= 2, above).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """``entries``: list, kind, value, added (boolean), day. Returns list, kind, value, since,
    until (null: still active): an entry holds from its day to the next removal or addition of
    the same value. Of entries of one day a removal wins. Entries with a null are ignored. A
    value has at most one row a day, so its window is bounded by the days of the log."""
    by = ["list", "kind", "value"]
    daily = entries.dropna().groupBy(*by, "day").agg(F.min("added").alias("added"))
    after = F.lead("day").over(Window.partitionBy(*by).orderBy("day"))
    dated = daily.select(*by, "added", F.col("day").alias("since"), after.alias("until"))
    return dated.where("added").drop("added")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, day_col: str) -> DataFrame:
    """id_col, host, fetched, n_block, n_allow, first_block, since, blocked for every capture,
    repeated rows included. n_block and n_allow count the active entries that match, in lists
    named block and allow; first_block is the smallest of the former as kind:value, since the
    latest day on which one of them began. A capture is blocked if an entry blocks it and none
    allows it. Captures without a URL, host or date match nothing.

    Intervals are cut at months, so that a join on key and month finds the active ones; hot
    keys are salted on the side of the captures and repeated on that of the list.
    """
    rows = captures.groupBy(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(day_col).alias("fetched")
    ).agg(F.count("*").alias("times"))
    rows = rows.withColumn("host", host("url"))
    keys = F.concat(
        F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value"))),
        F.transform(domains("url"), lambda x: F.struct(F.lit("domain").alias("kind"), x.alias("value"))),
        F.array(F.struct(F.lit("prefix").alias("kind"), prefix("url").alias("value"))),
    )
    asked = rows.withColumn("key", F.explode(keys)).select(
        "id", "url", "fetched", "times", "host", "key.kind", "key.value",
        F.trunc("fetched", "month").alias("month"),
        F.pmod(F.xxhash64("id", "url", "fetched"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    last = captures.agg(F.max(day_col)).first()[0]
    end = F.coalesce(F.date_sub("until", 1), F.lit(last).cast("date"))
    months = F.sequence(F.trunc("since", "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    active = (
        intervals(entries)
        .where(F.trunc("since", "month") <= F.trunc(end, "month"))
        .withColumn("month", F.explode(months))
        .withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    )
    active = active.select("list", "kind", "value", "since", "until", "month", "salt")
    a, e = asked.alias("a"), active.alias("e")
    same = [F.col(f"a.{c}") == F.col(f"e.{c}") for c in ("kind", "value", "month", "salt")]
    holds = (F.col("e.since") <= F.col("a.fetched")) & (
        F.col("e.until").isNull() | (F.col("a.fetched") < F.col("e.until"))
    )
    matched = a.join(e, [*same, holds], "left")
    block, allow = F.col("e.list") == "block", F.col("e.list") == "allow"
    named = F.concat_ws(":", "a.kind", "a.value")
    found = matched.groupBy("a.id", "a.url", "a.fetched", "a.times", "a.host").agg(
        F.count(F.when(block, 1)).alias("n_block"),
        F.count(F.when(allow, 1)).alias("n_allow"),
        F.min(F.when(block, named)).alias("first_block"),
        F.max(F.when(block, F.col("e.since"))).alias("since"),
    )
    repeated = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return repeated.select(
        F.col("id").alias(id_col), "host", "fetched", "n_block", "n_allow", "first_block", "since",
        ((F.col("n_block") > 0) & (F.col("n_allow") == 0)).alias("blocked"),
    )


def derived_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date in 2024 that follows from the id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A log of list entries made from the pages' own URLs."""

    def taken(rule: str, name: str, kind: str, value: F.Column, added: bool, factor: int) -> DataFrame:
        days = F.pmod(F.col("page_id") * factor, F.lit(366)).cast("int")
        return pages.where(rule).where("url IS NOT NULL").select(
            F.lit(name).alias("list"), F.lit(kind).alias("kind"), value.alias("value"),
            F.lit(added).alias("added"), F.date_add(F.lit("2024-01-01").cast("date"), days).alias("day"),
        )

    top = F.element_at(domains("url"), -1)
    return (
        taken("page_id % 5 = 0", "block", "host", host("url"), True, 13)
        .union(taken("page_id % 10 = 5", "block", "host", host("url"), False, 29))
        .union(taken("page_id % 97 = 1", "block", "domain", top, True, 17))
        .union(taken("page_id % 97 = 2", "block", "domain", top, False, 19))
        .union(taken("page_id % 11 = 3", "allow", "prefix", prefix("url"), True, 23))
        .union(taken("page_id % 22 = 14", "allow", "prefix", prefix("url"), False, 31))
    )
