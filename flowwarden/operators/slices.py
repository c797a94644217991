"""Ordered computations that never put one key, or the whole table, in one task.

Rows are dealt into range partitions of the full order, tie-break included, so an instant
that most rows share is cut like any other stretch. A partition is a slice. Each slice is
processed on its own and summarised in one row; the summaries are scanned and handed back
to the slices. The number of slices follows the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.session import stored

SLICE = "_slice"
#: Rows of a slice in large tables; small ones are cut for every core, down to LEAST_ROWS.
SLICE_ROWS = 1 << 21
LEAST_ROWS = 10_000


def digest(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def total_order(order: str, tie: str) -> list[Column]:
    return [F.col(order), digest(tie), F.col(tie)]


def slice_count(df: DataFrame, rows: int, slice_rows: int | None = None) -> int:
    if slice_rows:
        return max(-(-rows // slice_rows), 1)
    cores = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // SLICE_ROWS), min(cores, -(-rows // LEAST_ROWS)), 1)


def deal(
    df: DataFrame, order: Sequence[str | Column], rows: int | None = None, slice_rows: int | None = None
) -> tuple[DataFrame, int]:
    """The rows with their slice, monotone in the given order, and the number of slices.

    Bounds are drawn once and the dealt rows written, so that all who read them agree.
    """
    slices = slice_count(df, df.count() if rows is None else rows, slice_rows)
    if slices == 1:
        return df.withColumn(SLICE, F.lit(0)), 1
    dealt = df.repartitionByRange(slices, *order)
    return stored(dealt.withColumn(SLICE, F.spark_partition_id()), "slices"), slices


def add_slices(
    df: DataFrame, order: str, tie: str, rows: int | None = None, slice_rows: int | None = None
) -> tuple[DataFrame, int]:
    """Slices of the order (order, md5(tie), tie)."""
    return deal(df, total_order(order, tie), rows, slice_rows)


def join_groups(rows: DataFrame, per_group: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join one row per group back to its rows; a null in the keys is a group like others."""
    marked = per_group.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    return rows.join(marked, same).drop(*[f"_g_{g}" for g in groups])


def running_totals(
    df: DataFrame,
    order: str,
    tie: str,
    measures: dict[str, Column],
    keys: Sequence[str] = (),
    slice_rows: int | None = None,
) -> DataFrame:
    """For every row add, per measure, the sum over all earlier rows (0 if none).

    Order: (order, md5(tie)). With `keys`, the sums run separately per key.
    """
    keys = list(keys)
    names = list(measures)
    dealt, _ = add_slices(df, order, tie, slice_rows=slice_rows)
    sliced = dealt.withColumns({f"_m_{n}": c.cast("double") for n, c in measures.items()})
    groups = [*keys, SLICE]
    per_slice = sliced.groupBy(groups).agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in names])
    # one row per key and slice
    before = Window.partitionBy(keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *groups,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0.0)).alias(f"_o_{n}") for n in names],
    )
    within = (
        Window.partitionBy(groups)
        .orderBy(*total_order(order, tie))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    partial = sliced.select(
        *sliced.columns,
        *[F.coalesce(F.sum(f"_m_{n}").over(within), F.lit(0.0)).alias(f"_w_{n}") for n in names],
    )
    return join_groups(partial, offsets, groups).select(
        *df.columns, *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in names]
    )


# ---- moments: n, mean and M2 (the sum of squared distances from the mean) ----


def merged(n_a, mean_a, m2_a, n_b, mean_b, m2_b) -> tuple[Column, Column]:
    """mean and M2 of two sets together. Nothing is squared but distances between means, so a
    large offset cancels nowhere."""
    share = F.try_divide(n_b, n_a + n_b)
    delta = mean_b - mean_a
    mean = F.when(n_a == 0, mean_b).when(n_b == 0, mean_a).otherwise(mean_a + delta * share)
    m2 = F.when(n_a == 0, m2_b).when(n_b == 0, m2_a).otherwise(m2_a + m2_b + delta * delta * n_a * share)
    return mean, m2


def _earlier(per_slice: DataFrame, keys: list[str], names: Sequence[str], slices: int) -> DataFrame:
    """Moments of all slices before each, per key: a prefix scan in which every round merges a
    slice's moments with those that end where its own begin, and so doubles their reach."""
    order = Window.partitionBy(keys).orderBy(SLICE)
    columns = ["n", *[f"{part}_{f}" for f in names for part in ("mean", "m2")]]

    def shifted(df: DataFrame, by: int) -> DataFrame:
        back = [F.coalesce(F.lag(c, by).over(order), F.lit(0.0)).alias(f"_b_{c}") for c in columns]
        return df.select(*keys, SLICE, *columns, *back)

    found, reach = per_slice, 1
    while reach < slices:
        both = shifted(found, reach)
        after = {}
        for f in names:
            sides = [F.col(c) for c in ("_b_n", f"_b_mean_{f}", f"_b_m2_{f}", "n", f"mean_{f}", f"m2_{f}")]
            after[f"mean_{f}"], after[f"m2_{f}"] = merged(*sides)
        found = both.select(
            *keys, SLICE, (F.col("n") + F.col("_b_n")).alias("n"), *[c.alias(n) for n, c in after.items()]
        )
        reach *= 2
    return shifted(found, 1).select(*keys, SLICE, *[F.col(f"_b_{c}") for c in columns])


def _merged(n_a, mean_a, m2_a, n_b, mean_b, m2_b) -> tuple[np.ndarray, np.ndarray]:
    """The same as `merged`, of arrays."""
    share, delta = n_b / (n_a + n_b), mean_b - mean_a
    mean = np.where(n_a == 0, mean_b, np.where(n_b == 0, mean_a, mean_a + delta * share))
    m2 = np.where(n_a == 0, m2_b, np.where(n_b == 0, m2_a, m2_a + m2_b + delta * delta * n_a * share))
    return mean, m2


class _Welford:
    """Moments of a group's rows so far, a stretch of rows at a time: rows, and by column the
    values, their mean and M2. M2 grows by products that are never negative."""

    def __init__(self, centre: np.ndarray, before: list[float] | None) -> None:
        width = len(centre)
        self.centre, self.n = centre, 0
        self.count, self.mean, self.m2 = np.zeros(width), np.zeros(width), np.zeros(width)
        given = np.array(before, float) if before else np.zeros(1 + 2 * width)
        self.before = (given[0], given[1::2], given[2::2])

    def add(self, x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n, mean and M2 ahead of every row, with what was given as seen before the group."""
        first = np.where(there.any(axis=0), x[there.argmax(axis=0), np.arange(x.shape[1])], 0.0)
        base = np.where(self.count > 0, self.mean, first)
        away = np.where(there, x - base, 0.0)
        total, count = np.cumsum(away, axis=0), self.count + np.cumsum(there, axis=0)
        total_0, count_0 = np.vstack([np.zeros_like(base), total[:-1]]), np.vstack([self.count, count[:-1]])
        shift, shift_0 = (np.where(c > 0, t / c, 0.0) for t, c in ((total, count), (total_0, count_0)))
        m2 = self.m2 + np.cumsum(np.where(there, (away - shift_0) * (away - shift), 0.0), axis=0)
        m2_0 = np.vstack([self.m2, m2[:-1]])
        n = (self.n + np.arange(len(x), dtype=float))[:, None]
        own_mean = np.where(count_0 > 0, base + shift_0, self.centre)
        own_m2 = np.where(count_0 > 0, m2_0 / count_0 * n, 0.0)
        mean, squares = _merged(*self.before, n, own_mean, own_m2)
        self.n += len(x)
        self.count, self.mean, self.m2 = count[-1], np.where(count[-1] > 0, base + shift[-1], 0.0), m2[-1]
        seen = n + self.before[0]
        return seen, np.where(seen > 0, mean, 0.0), squares


def _walk_moments(columns: list[str], names: Sequence[str], centre: list[float], start: tuple | None):
    """Rows of whole slices, sorted by group; where `_before` is not empty it is ahead of its group's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            slices, texts = batch[SLICE].to_numpy(), batch["_group"].dictionary_encode()
            codes, marks = texts.indices.to_numpy(), pc.list_value_length(batch["_before"]).to_numpy() > 0
            own = [batch[f].cast(pa.float64(), safe=False) for f in names]
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in own])
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in own])
            edges = np.flatnonzero((np.diff(slices) != 0) | (np.diff(codes) != 0)) + 1
            edges = [0, *edges.tolist(), batch.num_rows]
            parts = []
            with np.errstate(all="ignore"):
                for a, b in zip(edges, edges[1:], strict=False):
                    here = (slices[a], texts.dictionary[codes[a]].as_py())
                    if here != group:
                        before = batch["_before"][a].as_py() if marks[a] else None
                        group, state = here, _Welford(np.array(centre), before)
                    a += int(marks[a])
                    if a < b:
                        parts.append(state.add(x[a:b], there[a:b]))
                if not parts:
                    continue
                n, mean, m2 = (np.concatenate(p) for p in zip(*parts, strict=True))
                if start:
                    mean, m2 = _merged(*start, n, mean, m2)
                    n = n + start[0]
            rows = batch.select(columns).filter(pa.array(~marks))
            found = {"_n": n[:, 0]}
            for i, f in enumerate(names):
                found |= {f"_mean_{f}": mean[:, i], f"_m2_{f}": m2[:, i]}
            arrays = [pa.array(np.ascontiguousarray(v)) for v in found.values()]
            yield pa.RecordBatch.from_arrays([*rows.columns, *arrays], [*columns, *found])

    return run


def running_moments(
    df: DataFrame,
    order: str,
    tie: str,
    names: Sequence[str],
    keys: Sequence[str] = (),
    slice_rows: int | None = None,
    start: tuple[float, dict[str, float], dict[str, float]] | None = None,
) -> DataFrame:
    """Add _n, _mean_<name> and _m2_<name> over all earlier rows (zeros if there are none), in
    (order, md5(tie)) order and, with `keys`, per key. `start`: n, and mean and M2 by name, of
    what was seen before the first row of every key.

    Every slice goes to a task of its own and is walked there in order, in Arrow batches; what
    lies before it comes as one more row ahead of each of its groups.
    """
    keys = list(keys)
    whole = df.agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in names]).first()  # one row
    dealt, slices = add_slices(df, order, tie, whole["n"], slice_rows)
    # averages are taken around the overall mean: a sum of large values would round
    centre = {f: float(whole[f] or 0.0) for f in names}
    value = {f: F.col(f).cast("double") - F.lit(centre[f]) for f in names}
    # empty, not null: after each row Arrow's writer fills the offsets of all null lists anew
    rows = dealt.select(*df.columns, SLICE, F.array().cast("array<double>").alias("_before"))
    if slices > 1:
        per_slice = dealt.groupBy(*keys, SLICE).agg(
            F.count("*").cast("double").alias("n"),
            *[(F.avg(value[f]) + F.lit(centre[f])).alias(f"mean_{f}") for f in names],
            *[(F.var_pop(value[f]) * F.count("*")).alias(f"m2_{f}") for f in names],
        )
        before = ["_b_n", *[f"_b_{part}_{f}" for f in names for part in ("mean", "m2")]]
        ahead = _earlier(per_slice, keys, names, slices).select(*keys, SLICE, F.array(*before).alias("_before"))
        rows = rows.unionByName(ahead, allowMissingColumns=True)
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    ordered = (
        rows.withColumn("_group", group)
        .repartitionById(slices, F.col(SLICE))
        .sortWithinPartitions("_group", F.size("_before") == 0, *total_order(order, tie))
    )
    doubles = [T.StructField("_n", T.DoubleType())]
    doubles += [T.StructField(f"_{part}_{f}", T.DoubleType()) for f in names for part in ("mean", "m2")]
    given = None if start is None else (start[0], *(np.array([d[f] for f in names]) for d in start[1:]))
    run = _walk_moments(df.columns, list(names), [centre[f] for f in names], given)
    return ordered.mapInArrow(run, T.StructType([*df.schema.fields, *doubles]))


# ---- neighbours and ranks ----


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    values: Sequence[str],
    slice_rows: int | None = None,
) -> DataFrame:
    """Add prev_<value>: the value in the row before, per key; null in the first row."""
    keys = list(keys)
    groups = [*keys, SLICE]
    sliced, _ = add_slices(df, order, tie, slice_rows=slice_rows)
    packed = F.struct(*values)
    ranked = F.struct(F.col(order).alias("a"), digest(tie).alias("b"), F.col(tie).alias("c"))
    last = sliced.groupBy(groups).agg(F.max_by(packed, ranked).alias("_last"))
    earlier = last.select(
        *groups, F.lag("_last").over(Window.partitionBy(keys).orderBy(SLICE)).alias("_earlier")
    )
    inside = Window.partitionBy(groups).orderBy(*total_order(order, tie))
    return (
        join_groups(sliced.withColumn("_inside", F.lag(packed).over(inside)), earlier, groups)
        .withColumn("_prev", F.coalesce("_inside", "_earlier"))
        .select(*df.columns, *[F.col(f"_prev.{v}").alias(f"prev_{v}") for v in values])
    )


def hash_rank(
    df: DataFrame, key: str, groups: Sequence[str] = (), name: str = "rank", slice_rows: int | None = None
) -> DataFrame:
    """Exact 1-based rank in md5(key) order within each group.

    A group of any size is spread over hash ranges, as many as the table needs; a rank is the
    position inside the range plus the rows in the ranges before it.
    """
    groups = list(groups)
    ranges = slice_count(df, df.count(), slice_rows)
    digits = max(math.ceil(math.log(ranges, 16) - 1e-9), 0)
    hashed = df.withColumn("_hash", digest(key)).withColumn(
        "_range", F.substring("_hash", 1, digits)
    )
    parts = groups + ["_range"]
    before = Window.partitionBy(groups).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        hashed.groupBy(parts)
        .agg(F.count("*").alias("_n"))
        .select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(parts).orderBy("_hash", key)
    return (
        join_groups(hashed.withColumn("_inside", F.row_number().over(inside)), offsets, parts)
        .select(*df.columns, (F.col("_inside") + F.col("_before")).cast("bigint").alias(name))
    )
