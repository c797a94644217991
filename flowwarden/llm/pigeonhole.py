"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart. Rotated by a fixed random rotation and cut
into blocks of about 16 dimensions, a close pair must be close in some block: within the
block's share, by dimensions, of the squared distance. Each block is a range join: cells of
the block's first coordinate, as wide as its distance, are joined with themselves and the next
one, in chunks of bounded size. Pairs that pass a block are verified on the whole vectors
there and then, and counted in the first block that they pass; on its edge that is decided
from sums that are the same in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import stored
from flowwarden.llm.components import components

COSINE = 0.9
BLOCK_DIMENSIONS = 16
CHUNK = 8_192
_TILE = 1_024
_SLACK = 1e-5
#: More than what float32 products are off by, less than the slack.
_EDGE = np.float32(5e-6)
_ROTATIONS: dict[int, np.ndarray] = {}


def _rotation(d: int) -> np.ndarray:
    if d not in _ROTATIONS:
        _ROTATIONS[d] = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    return _ROTATIONS[d]


def _blocks(d: int, cosine: float) -> list[tuple[slice, float]]:
    """Dimensions and squared distance of each block."""
    n = max(1, round(d / BLOCK_DIMENSIONS))
    edges = [round(i * d / n) for i in range(n + 1)]
    total = 2 - 2 * cosine
    return [(slice(a, b), total * (b - a) / d) for a, b in zip(edges, edges[1:], strict=False)]


def _unit(column: pa.Array, d: int) -> np.ndarray:
    x = column.flatten().to_numpy().reshape(-1, d).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(cosine: float):
    """(d, block, cell, id) of every vector in every block."""

    def work(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                turned = _unit(part.column(1), int(d)) @ _rotation(int(d)).T
                for i, (place, squared) in enumerate(_blocks(int(d), cosine)):
                    cell = np.floor(turned[:, place.start] / np.sqrt(squared + 3 * _SLACK)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), d, np.int32)), pa.array(np.full(len(part), i, np.int32)),
                         pa.array(cell), part.column(0)],
                        ["d", "block", "cell", "id"],
                    )

    return work


def _lowest(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and column of a tile reaches by the tile's links."""
    most = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(link, cols, most).min(axis=1))
        new_cols = np.minimum(cols, np.where(link, new_rows[:, None], most).min(axis=0))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def _joined(cosine: float):
    """Links between two chunks of a block, as counts and as stars: id, n, root."""

    def work(key, pair):
        d, block = key[0].as_py(), key[1].as_py()
        side, ids = pair["side"].to_numpy(), pair["id"].to_numpy()
        times = pair["times"].to_numpy()
        unit = _unit(pair["v"].combine_chunks(), d)
        turned = unit @ _rotation(d).T
        shares = _blocks(d, cosine)[: block + 1]
        left, right, marks = [], [], []
        for place, squared in shares:
            own = turned[:, place]
            half = (own * own).sum(axis=1, keepdims=True) / 2
            one = np.ones_like(half)
            left.append(np.hstack([own, -half, one]).astype(np.float32))
            right.append(np.hstack([own, one, -half]).astype(np.float32))
            marks.append(np.float32(-squared / 2 - _SLACK))

        def passed(k, r, c, link):
            """Which of the tile's links pass block k: of two tasks none decides otherwise."""
            value = left[k][r] @ right[k][c].T
            passes = value >= marks[k]
            i, j = np.nonzero(link & (np.abs(value - marks[k]) <= _EDGE))
            place, squared = shares[k]
            for at in range(0, len(i), _TILE):
                one, other = i[at : at + _TILE], j[at : at + _TILE]
                between, far = unit[r[one]] - unit[c[other]], np.zeros(len(one))
                for axis in _rotation(d)[place]:
                    far += (between * axis).sum(axis=1) ** 2
                passes[one, other] = far <= squared + 2 * _SLACK
            return passes

        first = np.flatnonzero(side == 0)
        alone = not (side == 1).any()
        second = first if alone else np.flatnonzero(side == 1)
        n = np.zeros(len(ids), np.int64)
        found_ids, roots = [], []
        for a in range(0, len(first), _TILE):
            rows = first[a : a + _TILE]
            for b in range(a if alone else 0, len(second), _TILE):
                cols = second[b : b + _TILE]
                mask = left[-1][rows] @ right[-1][cols].T >= marks[-1] - _EDGE
                if alone and a == b:
                    mask = np.triu(mask, 1)
                if not mask.any():
                    continue
                i, j = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
                r, c = rows[i], cols[j]
                link = mask[np.ix_(i, j)] & (unit[r] @ unit[c].T >= cosine)
                if link.any():
                    link &= passed(block, r, c, link)
                for k in range(block):
                    link &= ~passed(k, r, c, link)
                if link.any():
                    n[r] += link @ times[c]
                    n[c] += link.T @ times[r]
                    low_r, low_c = _lowest(link, ids[r], ids[c])
                    found_ids += [ids[r], ids[c]]
                    roots += [low_r, low_c]
        linked = np.flatnonzero(n)
        star_ids = np.concatenate(found_ids) if found_ids else np.zeros(0, np.int64)
        star_roots = np.concatenate(roots) if roots else np.zeros(0, np.int64)
        stars = np.unique(np.stack([star_ids, star_roots])[:, star_ids != star_roots], axis=1)
        return pa.table({
            "id": np.concatenate([ids[linked], stars[0]]),
            "n": np.concatenate([n[linked], np.zeros(stars.shape[1], np.int64)]),
            "root": np.concatenate([ids[linked], stars[1]]),
        })

    return work


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, chunk: int = CHUNK
) -> DataFrame:
    """id_col, n_links, component_id, kept for every row, repeated rows included.

    Rows whose vector is null, empty, zero or holds a null or non-finite component, or whose id
    is null, link with nothing and keep their own id; so do vectors of different length with
    each other. Equal vectors are joined once and counted as often as they occur; n_links is
    the number of other rows linked directly. Rows that share an id share their links.
    """
    x = F.col(vec_col)
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    usable = F.col(id_col).isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda c: c != 0)
    rows = df.select(F.col(id_col).alias("id"), F.when(usable, x).alias("v"))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("times"))
    classes = stored(classes.select("id", "v", F.size("v").alias("d"), "times"), "classes")
    where = stored(
        classes.select("id", "v", "d").mapInArrow(_cells(cosine), "d int, block int, cell long, id long"), "cells"
    )
    by = ["d", "block", "cell"]
    sizes = where.groupBy(*by).count().withColumn("parts", F.ceil(F.col("count") / chunk))
    chunks = sizes.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    nearby = chunks.select(*by, F.col("cell").alias("from"), "part").withColumn(
        "cell", F.explode(F.array(F.col("cell"), F.col("cell") + 1))
    )
    ahead = chunks.select(*by, F.col("part").alias("other"))
    pairs = nearby.join(ahead, by).where("`from` < cell OR part <= other").select(
        "d", "block", F.col("from").alias("cell_a"), "part", F.col("cell").alias("cell_b"), "other"
    )
    pair = F.struct("cell_a", "part", "cell_b", "other").alias("pair")
    sides = pairs.select("d", "block", pair, F.lit(0).alias("side"), F.col("cell_a").alias("cell"), "part").union(
        pairs.where("cell_a != cell_b OR part != other").select(
            "d", "block", pair, F.lit(1).alias("side"), F.col("cell_b").alias("cell"), F.col("other").alias("part")
        )
    )
    placed = where.join(sizes, by).select(*by, "id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    filled = placed.join(classes.select("id", "v", "times", "d"), ["id", "d"]).join(sides, [*by, "part"])
    found = stored(
        filled.select("d", "block", "pair", "side", "id", "times", "v")
        .groupBy("d", "block", "pair")
        .applyInArrow(_joined(cosine), "id long, n long, root long"),
        "links",
    )
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("id", "v", "times").join(counts, "id", "left")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "v",
            (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    own = F.coalesce("component_id", "id")
    return rows.join(named, "v", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )
