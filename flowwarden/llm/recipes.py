"""Exact duplicates by recipes of content-defined chunks.

A text is cut where a rolling hash of its last bytes says so, hence equal passages are cut
alike wherever they stand. A chunk goes by a 128-bit identifier; a text's recipe is the ordered
list of its chunks' identifiers, and the recipe, a short content itself, goes by an identifier
too. Identifiers are verified: every distinct content is moved once, after the copies that one
task sees are put together, and where two contents share an identifier all are drawn anew from
the next seed. So equal identifiers of recipes mean equal texts; from there on rows are narrow,
however long their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import stored, texts_of

#: Chunks hold at least LEAST and at most MOST bytes; between, one place in 2^CUT_BITS ends one.
LEAST, MOST, CUT_BITS = 1 << 10, 1 << 16, 11
WIDTH = 16
#: Groups with more than one row in SHARE are handed out apart from the others; there are fewer than SHARE.
SHARE = 1024
_STEP = 1 << 20
_WINDOW = 32
#: A fixed odd number, the base of the rolling hash, and fixed values of the 256 bytes.
_BASE = 0x9E3779B1
_BYTES = np.random.default_rng(0).integers(0, 1 << 32, 256, dtype=np.uint32)


def _marks(data: np.ndarray) -> np.ndarray:
    """Places behind which a chunk may end: the hash of the last 32 bytes has its top bits
    unset. Sums over windows of 1, 2, 4 ... 32 bytes are each made of two of the half."""
    found = []
    for at in range(0, len(data), _STEP):
        begin = max(at - _WINDOW + 1, 0)
        value = _BYTES[data[begin : at + _STEP]]
        reach, power = 1, _BASE
        while reach < _WINDOW:
            value[reach:] += value[:-reach] * np.uint32(power)
            reach, power = reach * 2, power * power % (1 << 32)
        places = np.flatnonzero(value >> np.uint32(32 - CUT_BITS) == 0) + begin
        found.append(places[places >= at] + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all texts, starting with 0, and for each text the number of
    chunks before it. An empty text has none. A text's cuts depend on its own bytes alone:
    a window is shorter than the shortest chunk."""
    marks = _marks(data).tolist()
    ends, counts, at = [0], [0], 0
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while begin < end:
            least, stop = begin + LEAST, min(begin + MOST, end)
            while at < len(marks) and marks[at] < least:
                at += 1
            begin = marks[at] if at < len(marks) and marks[at] < stop else stop
            ends.append(begin)
        counts.append(len(ends) - 1)
    return np.array(ends), np.array(counts)


def _identified(column: pa.Array, seed: int, width: int):
    """Bytes, cuts, chunk counts, identifiers of a batch's chunks, and those of its recipes."""
    data, offsets = texts_of(column)
    ends, counts = cuts(data, offsets)
    view, at = memoryview(data), ends.tolist()
    name = xxhash.xxh3_128_digest
    chunks = [name(view[a:b], seed)[:width] for a, b in zip(at, at[1:])]  # noqa: B905
    lists = [b"".join(chunks[a:b]) for a, b in zip(counts.tolist(), counts[1:].tolist(), strict=False)]
    return data, offsets, ends, chunks, lists, [name(x, seed)[:width] for x in lists]


def recipes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, width: int = WIDTH
) -> DataFrame:
    """id, row (a number of its own for every row), text_sha256, n_bytes, chunks (the ordered
    identifiers, one after the other) and recipe (their identifier) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets, _, _, lists, names = _identified(batch.column(1), seed, width)
            view, at = memoryview(data), offsets.tolist()
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:])]  # noqa: B905
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.arange(row, row + len(names))), pa.array(digests, pa.string()),
                    pa.array(np.diff(offsets)), pa.array(lists, pa.binary()), pa.array(names, pa.binary()),
                ],
                ["id", "row", "text_sha256", "n_bytes", "chunks", "recipe"],
            )
            row += len(names)

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    kinds = f"id {kind}, row long, text_sha256 string, n_bytes long, chunks binary, recipe binary"
    return chosen.mapInArrow(work, kinds)


def contents(df: DataFrame, text_col: str = "text", seed: int = 0, width: int = WIDTH) -> DataFrame:
    """name, content: every distinct chunk and every distinct recipe with its identifier.
    A text of one chunk that many documents share is one row of each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, _, ends, chunks, lists, names = _identified(batch.column(0), seed, width)
            places = pa.array(ends.astype(np.int32)).buffers()[1]
            whole = pa.Array.from_buffers(pa.binary(), len(chunks), [None, places, pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), whole], ["name", "content"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(lists, pa.binary())], ["name", "content"]
            )

    return df.select(F.col(text_col).alias("text")).mapInArrow(work, "name binary, content binary").distinct()


def verified_seed(df: DataFrame, text_col: str = "text", width: int = WIDTH, seeds: int = 16) -> int:
    """The first seed under which no two contents of the table share an identifier."""
    for seed in range(seeds):
        shared = contents(df, text_col, seed, width).groupBy("name").count().where("count > 1")
        if shared.isEmpty():
            return seed
    raise ValueError(f"identifiers of {width} bytes are too short for the contents of this table")


def duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH
) -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256 of every row of the table.

    Rows with identical texts are a group; a null text is an empty one. keep_id is the group's
    largest id (null only where all are), and ``kept`` is true for exactly one row of the
    group: one that bears that id. Repeated rows count as often as they occur. Other columns
    don't matter, whatever their names; an empty table gives no rows. The table is read twice
    and must read alike.

    Texts are moved at most once, deduplicated by every task before. Groups that hold more
    than one row in 1,024, fewer than 1,024 by that, are joined from a broadcast table of one
    short row each, so a text that a third of all rows share stays spread over all tasks.
    """
    seed = verified_seed(df, text_col, width)
    rows = stored(recipes(df, id_col, text_col, seed, width).drop("chunks", "n_bytes"), "recipes")
    groups = rows.groupBy("recipe").agg(
        F.max("id").alias("keep_id"),
        F.coalesce(F.max_by("row", "id"), F.max("row")).alias("keep_row"),
        F.count("*").alias("group_size"),
    )
    groups = stored(groups, "groups")
    large = F.col("group_size") * SHARE > rows.count()
    marked = rows.join(F.broadcast(groups.where(large)), "recipe", "left")
    rest = marked.where("group_size IS NULL").select(*rows.columns).join(groups.where(~large), "recipe")
    return marked.where("group_size IS NOT NULL").unionByName(rest).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Of rows that repeat id and text, one stays."""
    row = df.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.`{id_col}`").alias("id"),
        F.sha2(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).cast("binary"), 256).alias("digest"),
    )
    stay = duplicates(df, id_col, text_col).where("kept").select(F.col(id_col).alias("id_"), F.col("text_sha256").alias("digest_"))
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_"))
    found = row.join(stay, same, "left_semi").dropDuplicates(["id", "digest"])
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
