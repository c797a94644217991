"""Helpers shared by the operators: tables, batches of texts, files in the shared folder."""

from __future__ import annotations

import ctypes
import os
import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from flowwarden.session import scratch_path, stored

__all__ = ["free_names", "kept", "mix64", "reader", "released", "scratch_path", "splits", "stored", "table", "texts_of", "writer"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where the table has a column called so in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def splits(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in a process. Functions reach the Python workers by
    value, so variables of their modules last for one task; a module of the process's own
    serves all tasks of a worker."""
    held = sys.modules.setdefault("flowwarden_kept", ModuleType("flowwarden_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def released(*names: str) -> None:
    """Drops what earlier stages of a job kept in this process, but for keys that begin with one
    of ``names``, and gives freed memory back to the system: workers outlive their stage."""
    held = sys.modules.get("flowwarden_kept")
    for key in [k for k in (held.__dict__ if held else {}) if isinstance(k, tuple) and k[0] not in names]:
        del held.__dict__[key]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (fixed multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class writer:
    """A file in the shared folder, visible under its name only once it is whole, so that a
    repeated task replaces it and a lost one leaves nothing that is read."""

    def __init__(self, uri: str, compression: str | None = None):
        self._compression = compression
        self._fs, self._path = fs.FileSystem.from_uri(uri)
        self._fs.create_dir(os.path.dirname(self._path), recursive=True)
        self._part = f"{self._path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self._out = self._fs.open_output_stream(self._part, compression=self._compression)
        return self._out

    def __exit__(self, kind, *_):
        self._out.close()
        if kind is None:
            self._fs.move(self._part, self._path)
        else:
            self._fs.delete_file(self._part)


def reader(uri: str, compression: str | None = None):
    """A file of the shared folder: seekable, or a stream where it is compressed."""
    found, path = fs.FileSystem.from_uri(uri)
    if compression:
        return found.open_input_stream(path, compression=compression)
    return found.open_input_file(path)
