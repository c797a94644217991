"""Exact top-k by inner product with vector-approximation files.

Each vector has a cell: its components in 8-bit steps of its own scale. A cell bounds every
inner product from both sides. Cells and queries meet in blocks; what can't be among the k
best by the bounds is left out, and exact vectors are read for the rest, best bound first,
until the k-th result is certain.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.llm.common import stored

#: Every finite component takes part.
LARGEST = sys.float_info.max
CANDIDATES, QUERIES = 16_384, 8_192
#: Blocks of longer vectors hold fewer of them.
_DIMENSIONS = 512
_TILE = 256
#: Sums whose terms' sizes add up to less fit a long, with room for the rounding of that estimate.
_LONG = float(1 << 62)


def scaled(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id, v (array<double>, whole numbers: floor(scale * x)) of the rows that take part,
    repeated rows once. Null or empty vectors, those with a null or non-finite component, and
    rows without an id take no part. A finite component that overflows when scaled is an error."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)))
    usable = F.col(id_col).isNotNull() & (F.size(x) > 0) & fine

    def whole(c):
        y = F.lit(float(scale)) * c.cast("double")
        # from 2^52 on every double is whole, and floor() would end at 2^63
        kept = F.when(F.abs(y) <= LARGEST, y).otherwise(F.raise_error(F.lit("a scaled component overflows")).cast("double"))
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(kept)

    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(x, whole).alias("v"))


def _bounds(k: int):
    def work(cells, queries):
        out = {name: [] for name in ("query", "query_key", "id", "key", "low", "high")}
        if cells.num_rows and queries.num_rows:
            ids, keys = cells["id"].to_numpy(), cells["key"].to_numpy()
            scale = cells["scale"].to_numpy()
            c = cells["cell"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(float)
            # c is off by half a step (and 1e-7 of one), |c| <= 127; n terms are summed, in any
            # order, with an error of at most n * 2^-53 / (1 - n * 2^-53) of their sizes
            error = (c.shape[1] + 8) * 2.0**-52
            half = (0.5 + 1e-6 + 128 * error) * (1 + error)
            names, own = queries["id"].to_numpy(), queries["key"].to_numpy()
            q = queries["v"].combine_chunks().flatten().to_numpy().reshape(len(names), -1)
            finite = np.abs(q).max() * float(np.abs(scale).max()) * 256 * c.shape[1] < 1e300
            for at in range(0, len(names), _TILE):
                part = q[at : at + _TILE]
                with np.errstate(over="ignore", invalid="ignore"):
                    middle = (part @ c.T) * scale
                    reach = np.abs(part).sum(axis=1, keepdims=True) * scale * half
                    low, high = middle - reach, middle + reach
                if not finite:  # beyond doubles: no bound
                    low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf
                same = names[at : at + _TILE, None] == ids
                low[same] = high[same] = -np.inf
                if len(ids) > k:
                    least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k, None]
                else:
                    least = -np.inf
                i, j = np.nonzero((high >= least) & ~same)
                for name, values in zip(
                    out, (names[at + i], own[at + i], ids[j], keys[j], low[i, j], high[i, j]), strict=True
                ):
                    out[name].append(values)
        kinds = (np.int64,) * 4 + (np.float64,) * 2
        return pa.table(
            {n: np.concatenate(v) if v else np.zeros(0, t) for (n, v), t in zip(out.items(), kinds, strict=True)}
        )

    return work


def _product(v: np.ndarray, w: np.ndarray) -> Decimal:
    if np.abs(v).max() * np.abs(w).max() * len(v) < float(1 << 52):
        return Decimal(int(v @ w))
    found = sum(int(a) * int(b) for a, b in zip(v.tolist(), w.tolist(), strict=True))
    if abs(found) >= 10**38:
        raise ValueError("an inner product has more than 38 digits")
    return Decimal(found)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query, query_key, id, score: exact products of vectors that may be too large for longs."""
    for batch in batches:
        pairs = [
            (np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1]))
            for column in (batch.column(3), batch.column(4))
        ]
        scores = [_product(v, w) for v, w in zip(*pairs, strict=True)] if batch.num_rows else []
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(scores, pa.decimal128(38, 0))], ["query", "query_key", "id", "score"]
        )


def _kth(df: DataFrame, k: int, score: str) -> DataFrame:
    """For queries with k scores or more, the k-th."""
    best = Window.partitionBy("query", "query_key").orderBy(F.desc(score))
    top = df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return top.groupBy("query", "query_key").agg(
        F.when(F.count("*") == k, F.min(score)).alias("least")
    )


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every vector whose id is divisible by ``every`` the
    k other vectors of largest inner product, ties to the smaller id; all where there are
    fewer. Vectors of different length aren't compared. Copies of a vector tie, so of each
    distinct one only the k + 1 smallest ids can appear; the rest are left out beforehand,
    task by task. A row never finds rows that share its id.

    score is a long; where the table's largest vectors might pass it, score is decimal(38,0),
    exact all the same, and a product of more digits than that is an error."""
    rows = scaled(df, id_col, vec_col)
    first = Window.partitionBy("v").orderBy("id")
    vectors = rows.withColumn("place", F.dense_rank().over(first)).where(F.col("place") <= k + 1)
    sizes = F.transform("v", lambda c: F.abs(c))
    total = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x).alias("total")
    named = ("id", "v", F.xxhash64("v").alias("key"), F.array_max(sizes).alias("largest"))
    vectors = stored(vectors.drop("place").distinct().select(*named, total), "vectors")
    asked = stored(rows.where(F.col("id") % every == 0).distinct().select(*named), "queries")
    n, n_components = vectors.agg(F.count("*"), F.sum(F.size("v"))).first()
    m, m_components = asked.agg(F.count("*"), F.sum(F.size("v"))).first()
    blocks = lambda n, components, held: int(max(-(-n // held), -(-(components or 0) // (held * _DIMENSIONS)), 1))
    n_blocks, q_blocks = blocks(n, n_components, CANDIDATES), blocks(m, m_components, QUERIES)
    at_most = lambda df, c: df.groupBy(F.size("v").alias("d")).agg(F.greatest(F.max(c), F.lit(1.0)).alias(c))
    passing = at_most(vectors, "total").join(at_most(asked, "largest"), "d").where(F.col("total") * F.col("largest") >= _LONG)
    wide = not passing.isEmpty()

    scale = F.when(F.col("largest") > 0, F.col("largest") / 127.0).otherwise(1.0)
    spread = lambda n, kind: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast(f"array<{kind}>"))
    cells = vectors.withColumn("scale", scale).select(
        F.size("v").alias("d"), "id", "key", "scale",
        F.transform("v", lambda c: F.round(c / F.col("scale")).cast("tinyint")).alias("cell"),
        F.pmod("key", F.lit(n_blocks)).alias("block"), spread(q_blocks, "int").alias("asked"),
    )
    queries = asked.select(
        F.size("v").alias("d"), "id", "key", "v",
        spread(n_blocks, "long").alias("block"), F.pmod("key", F.lit(q_blocks)).cast("int").alias("asked"),
    )
    by = ["d", "block", "asked"]
    bounds = stored(
        cells.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(
            _bounds(k), "query long, query_key long, id long, key long, low double, high double"
        ),
        "bounds",
    )

    def exact(pairs: DataFrame) -> DataFrame:
        whole = lambda a, b: a.cast("long") * b.cast("long")
        product = F.aggregate(F.zip_with("v", "w", whole), F.lit(0).cast("long"), lambda s, x: s + x)
        wanted = asked.select(F.col("id").alias("query"), F.col("key").alias("query_key"), F.col("v").alias("w"))
        found = pairs.select("query", "query_key", "id", "key").join(vectors, ["id", "key"])
        found = found.join(wanted, ["query", "query_key"])
        if wide:
            kinds = "query long, query_key long, id long, score decimal(38,0)"
            return found.select("query", "query_key", "id", "v", "w").mapInArrow(_wide, kinds)
        return found.select("query", "query_key", "id", product.alias("score"))

    alive = bounds.join(_kth(bounds, k, "low"), ["query", "query_key"])
    alive = alive.where("least IS NULL OR high >= least").drop("least")
    order = Window.partitionBy("query", "query_key").orderBy(F.desc("high"), "id", "key")
    near = alive.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    read = stored(exact(near), "exact")
    certain = _kth(read, k, "score")
    rest = alive.join(near.select("query", "query_key", "id", "key"), ["query", "query_key", "id", "key"], "left_anti")
    rest = rest.join(certain, ["query", "query_key"]).where("least IS NULL OR high >= least")
    best = Window.partitionBy("query", "query_key").orderBy(F.desc("score"), "id")
    ranked = read.union(exact(rest)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
