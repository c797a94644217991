"""Greedy per-host cooldown as a distributed computation.

An alert is taken when the last taken alert of its host lies at least `cooldown` earlier. The
rule is sequential, but what a stretch of a host's instants does to the "earliest next alert"
is a step function that can be tabulated without knowing what came before, and such functions
compose.

Instants are dealt into slices of the order (host, time), so slices hold similar numbers of
rows and a busy host covers many. Most hosts lie within one slice and are walked there. For a
host that goes on across slices each slice gives a table: a link from every instant to the one
that may follow it, doubled until it leads out of the slice. An entry can't come later than a
cooldown after the slice begins, so that tables stay short. Tables of neighbouring slices are
composed in levels, as many as the longest host needs; the start values are handed down again
and the slices walked. No row or task holds more than a few slices of a host.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.operators.slices import SLICE, deal, join_groups
from flowwarden.session import stored

NEVER = -(2**63)
#: Instants of a slice, and rows of tables that one task composes.
SLICE_INSTANTS = 1 << 18
TABLE_ROWS = 1 << 21

_TABLE = "host string, child bigint, entry bigint, leave bigint"


# ---- one slice or a few tables, in numpy ----


def _links(times: np.ndarray, cooldown: int) -> np.ndarray:
    """For every instant the number of the first one that a cooldown begun there allows."""
    return np.searchsorted(times, times + cooldown)


def _table(times: np.ndarray, cooldown: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a slice of one host, and the earliest next alert after it for each. Only the
    first instant where the host begins in the slice (`whole`)."""
    follow = _links(times, cooldown)
    hop = np.where(follow < len(times), follow, np.arange(len(times)))
    while not (hop[hop] == hop).all():  # twice the reach each time
        hop = hop[hop]
    reach = 1 if whole else int(np.searchsorted(times, times[0] + cooldown, "right")) + 1
    return _compact(times[:reach], times[hop][:reach] + cooldown)


def _compact(entry: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbouring entries with one outcome the last; a value between leads to it as well."""
    keep = np.append(leave[1:] != leave[:-1], True)
    return entry[keep], leave[keep]


def _through(entry: np.ndarray, leave: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = np.searchsorted(entry, value)
    return np.where(at < len(entry), leave[np.minimum(at, len(entry) - 1)], value)


def _children(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    child, entry, leave = (table[c].to_numpy() for c in ("child", "entry", "leave"))
    order = np.lexsort((entry, child))
    child, entry, leave = child[order], entry[order], leave[order]
    edges = np.append(np.flatnonzero(np.diff(child, prepend=child[0] - 1)), len(child))
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(child[a]), entry[a:b], leave[a:b]


def _hosts(table: pa.Table) -> Iterator[tuple[str | None, np.ndarray]]:
    """Rows of each host of a slice, times ascending."""
    codes = table["host"].combine_chunks().dictionary_encode()
    number = np.where(codes.is_null(), -1, codes.indices.fill_null(-1).to_numpy(zero_copy_only=False))
    order = np.lexsort((table["t"].to_numpy(), number))
    edges = np.append(np.flatnonzero(np.diff(number[order], prepend=-2)), len(order))
    for a, b in zip(edges, edges[1:], strict=False):
        code = number[order[a]]
        yield (None if code < 0 else codes.dictionary[int(code)].as_py()), order[a:b]


def _tabulate(cooldown: int):
    """Tables of the hosts of a slice that also lie in others (`first`, `last` tell)."""

    def run(key, table):
        out = {"host": [], "child": [], "entry": [], "leave": []}
        times, usable = table["t"].to_numpy(), table["usable"].to_numpy(zero_copy_only=False)
        first = table["first"].to_numpy()
        for host, rows in _hosts(table):
            mine = times[rows][usable[rows]]
            if not len(mine):
                continue
            entry, leave = _table(mine, cooldown, bool(first[rows[0]] == key[0].as_py()))
            out["host"] += [host] * len(entry)
            out["child"].append(np.full(len(entry), key[0].as_py()))
            out["entry"].append(entry)
            out["leave"].append(leave)
        none = np.zeros(0, np.int64)
        numbers = {c: np.concatenate(v).astype(np.int64) if v else none for c, v in out.items() if c != "host"}
        return pa.table({"host": pa.array(out["host"], pa.string()), **numbers})

    return run


def _compose(cooldown: int):
    def run(key, table):
        parts = list(_children(table))
        entry = np.unique(np.concatenate([e for _, e, _ in parts]))
        entry = entry[: np.searchsorted(entry, parts[0][1][0] + cooldown, "right") + 1]
        leave = entry
        for _, e, v in parts:
            leave = _through(e, v, leave)
        entry, leave = _compact(entry, leave)
        n = len(entry)
        return pa.table({
            "host": pa.array([key[0].as_py()] * n, pa.string()), "child": np.full(n, key[1].as_py()),
            "entry": entry, "leave": leave,
        })

    return run


def _hand_down(key, table):
    """Start value of each child from that of its parent."""
    value = np.array([table["start"][0].as_py()])
    children, starts = [], []
    for child, entry, leave in _children(table):
        children.append(child)
        starts.append(int(value[0]))
        value = _through(entry, leave, value)
    return pa.table({
        "host": pa.array([key[0].as_py()] * len(children), pa.string()), "child": np.array(children, np.int64),
        "start": np.array(starts, np.int64),
    })


def _walk(cooldown: int):
    """When each instant's host opens again, from the start values of the slice's hosts."""

    def run(key, rows, starts):
        begins = dict(zip(starts["host"].to_pylist(), starts["start"].to_pylist(), strict=True))
        times, usable = rows["t"].to_numpy(), rows["usable"].to_numpy(zero_copy_only=False)
        opens = np.full(len(times), NEVER, np.int64)
        for host, own in _hosts(rows):
            begin = begins.get(host, NEVER)
            opens[own] = begin
            mine = times[own][usable[own]]
            follow, taken = _links(mine, cooldown).tolist(), []
            at = int(np.searchsorted(mine, begin))
            while at < len(mine):
                taken.append(at)
                at = follow[at]
            chosen = mine[taken]
            before = np.searchsorted(chosen, times[own])  # taken strictly earlier
            later = before > 0
            opens[own[later]] = chosen[before[later] - 1] + cooldown
        return pa.table({"host": rows["host"], "t": rows["t"], "first_uid": rows["first_uid"], "opens": opens})

    return run


# ---- the levels ----


def _starts(tables: DataFrame, cooldown: int, table_rows: int) -> DataFrame:
    """host, child, start: what each slice of a host begins with."""
    levels = []
    while True:
        sizes = tables.groupBy("host", "child").count()
        most, widest = (
            sizes.groupBy("host").agg(F.max("count").alias("most"), (F.max("child") - F.min("child") + 1).alias("n"))
            .agg(F.max("most"), F.max("n")).first()
        )
        if not widest or widest == 1:
            break
        fan = max(2, table_rows // most)
        grouped = stored(tables.withColumn("parent", F.floor(F.col("child") / fan).cast("bigint")), "tables")
        levels.append(grouped)
        tables = stored(grouped.groupBy("host", "parent").applyInArrow(_compose(cooldown), _TABLE), "composed")
    starts = tables.select("host", "child", F.lit(NEVER).alias("start")).distinct()
    for grouped in reversed(levels):
        above = starts.withColumnRenamed("child", "parent")
        down = join_groups(grouped, above, ["host", "parent"])
        starts = down.groupBy("host", "parent").applyInArrow(_hand_down, "host string, child bigint, start bigint")
    return starts


def cooldown_status(
    alerts: DataFrame,
    cooldown_us: int,
    slice_instants: int = SLICE_INSTANTS,
    table_rows: int = TABLE_ROWS,
) -> DataFrame:
    """Add `status`: taken, cooldown, or unsafe; null for an alert without a time.

    Input columns src_ip, ts_us, uid and a boolean `safe`. Only safe alerts can be
    taken and start a cooldown; an unsafe one outside any cooldown is "unsafe". Order is
    (ts_us, uid) per host; alerts without a source are a host of their own.
    """
    alerts = stored(alerts, "alerts")  # read twice: what finds them is not run again
    instants = (
        alerts.where(F.col("ts_us").isNotNull())
        .groupBy(F.col("src_ip").alias("host"), F.col("ts_us").alias("t"))
        .agg(F.min(F.when(F.col("safe"), F.col("uid"))).alias("first_uid"))
    )
    instants = stored(instants.withColumn("usable", F.col("first_uid").isNotNull()), "instants")
    dealt, slices = deal(instants, ["host", "t"], slice_rows=slice_instants)
    nobody = alerts.sparkSession.createDataFrame([], f"{SLICE} int, host string, start bigint")
    starts = nobody
    if slices > 1:
        spans = dealt.where("usable").groupBy("host").agg(F.min(SLICE).alias("first"), F.max(SLICE).alias("last"))
        wide = join_groups(dealt.select("host", "t", "usable", SLICE), spans.where("first < last"), ["host"])
        tables = wide.groupBy(SLICE).applyInArrow(_tabulate(cooldown_us), _TABLE)
        found = _starts(stored(tables, "tables"), cooldown_us, table_rows)
        starts = stored(found.select(F.col("child").cast("int").alias(SLICE), "host", "start"), "starts")
    walked = (
        dealt.groupBy(SLICE).cogroup(starts.groupBy(SLICE))
        .applyInArrow(_walk(cooldown_us), "host string, t bigint, first_uid string, opens bigint")
        .withColumnsRenamed({"host": "_host", "t": "_t", "first_uid": "_first", "opens": "_opens"})
    )
    same = F.col("src_ip").eqNullSafe(F.col("_host")) & (F.col("ts_us") == F.col("_t"))
    status = (
        F.when(F.col("ts_us") < F.col("_opens"), "cooldown")
        .when(F.col("uid") == F.col("_first"), "taken")
        .when(F.col("uid") > F.col("_first"), "cooldown")
        .when(~F.col("safe"), "unsafe")
        .when(F.col("_opens").isNotNull(), "cooldown")
    )
    return alerts.join(walked, same, "left").withColumn("status", status).drop("_host", "_t", "_first", "_opens")
