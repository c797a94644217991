"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q that is at least two periods long and can't
be extended. The suffix links of a text's automaton form a tree in which the words up to place i
are a path from the root. Every node bears the place where its words last ended; nodes that bear
the same place lie on one path segment. Appending word i walks the segments on its path: where
words of length n ended last at place i - q and q <= n, they and the q words before them form a
square, and by the segment's length the run starts at i + 1 - q - n. Then the whole path is
recoloured i. Segments are the preferred paths of a link-cut forest (one splay tree each, its
colour at the top), so that all accesses together take O(n log n) steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of all states, and the state of every prefix. State 1 is the
    root, 0 stands for none."""
    step, link, length, places = [{}, {}], [0, 0], [0, 0], []
    last = 1
    for word in words:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p:
            q = step[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p and step[p].get(word) == q:
                    step[p][word] = clone
                    p = link[p]
                link[q] = link[new] = clone
        places.append(new)
        last = new
    return link, length, places


class Segments:
    """Path segments of the tree of suffix links, as splay trees ordered by depth."""

    def __init__(self, parent: list[int]):
        self.up = parent  # in a splay tree its parent, at the top the node above the segment
        self.left, self.right = [0] * len(parent), [0] * len(parent)
        self.colour = [-1] * len(parent)

    def splay(self, x: int) -> None:
        """Brings x to the top of its splay tree, with the colour that was there."""
        up, left, right = self.up, self.left, self.right
        top = x
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            if g and left[g] == p:
                over = -1
            elif g and right[g] == p:
                over = 1
            else:
                over = 0
            inner = left[p] == x
            if not over:
                turns = ((x, p, inner),)
                top = p
            elif (over == -1) == inner:
                turns = ((p, g, inner), (x, p, inner))
                top = g
            else:
                turns = ((x, p, inner), (x, g, not inner))
                top = g
            for low, high, was_left in turns:
                above = up[high]
                if was_left:
                    moved = right[low]
                    left[high] = moved
                    right[low] = high
                else:
                    moved = left[low]
                    right[high] = moved
                    left[low] = high
                if moved:
                    up[moved] = high
                if above:
                    if left[above] == high:
                        left[above] = low
                    elif right[above] == high:
                        right[above] = low
                up[low] = above
                up[high] = low
        if top != x:
            self.colour[x] = self.colour[top]

    def access(self, v: int, place: int) -> Iterator[tuple[int, int]]:
        """Deepest node and colour of each segment between v and the root; then all of the
        path is one segment of colour ``place``."""
        up, right, colour = self.up, self.right, self.colour
        below, x = 0, v
        while x:
            self.splay(x)
            yield x, colour[x]
            cut = right[x]
            if cut:
                colour[cut] = colour[x]
            right[x] = below
            if below:
                up[below] = x
            below, x = x, up[x]
        colour[below] = place


def _stretches(words: np.ndarray, least: int, begin: int = 0, rounds: int = 3) -> Iterator[tuple[int, int]]:
    """Stretches outside which no word of a run lies. Each word of a run of ``least`` words or
    more is part of least / 2 words in a row that recur in the run, one period away."""
    n, k = len(words), max(least // 2, 1)
    if n < least:
        return
    key = words[: n - k + 1].astype(np.uint64)
    for i in range(1, k):
        key = key * _ODD + words[i : n - k + 1 + i].astype(np.uint64)
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    edges = np.zeros(n + 1, np.int64)
    again = np.flatnonzero(times[which] > 1)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + k, -1)
    covered = np.concatenate([[0], np.cumsum(edges[:n]) > 0, [0]]).astype(np.int8)
    change = np.flatnonzero(np.diff(covered))
    for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        if b - a < least:
            continue
        if rounds and b - a < n:
            yield from _stretches(words[a:b], least, begin + a, rounds - 1)
        else:
            yield begin + a, begin + b


def find_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words, by start and period."""
    found = []
    for a, b in _stretches(words, least):
        link, length, places = automaton(words[a:b].tolist())
        segments, ends = Segments(link), {}
        for i, state in enumerate(places):
            for node, colour in segments.access(state, i):
                period, n = i - colour, length[node]
                if colour >= 0 and n >= period and n + period >= least:
                    ends[i + 1 - period - n, period] = i
        found += [(a + start, end + 1 - start, period) for (start, period), end in ends.items()]
    return sorted(found, key=lambda run: (run[0], run[2]))


def _numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id_col, n_words, runs (array of start, length, period, by start and then period) and
    collapsed (the words that no run repeats, joined by one blank) of every row.

    Words are split at blanks, tabs and line ends. Of a run the first period stays; a word
    behind it is left out if any run repeats it. A null, empty or blank text has no words, no
    runs and an empty ``collapsed``; repeated rows are each returned; other columns don't matter.
    A text is worked on as a whole by one task, in memory that grows with the longest stretch of
    recurring words in it.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts, lists, texts = [], [], []
                for text in part.column(1).to_pylist():
                    words = (text or "").encode().split()
                    found = find_runs(_numbered(words), least) if len(words) >= least else []
                    counts.append(len(words))
                    lists.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in found])
                    if found:
                        kept = np.ones(len(words), bool)
                        for start, length, period in found:
                            kept[start + period : start + length] = False
                        words = [words[i] for i in np.flatnonzero(kept).tolist()]
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(lists, run_type),
                     pa.array(texts, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"],
                )

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    kinds = f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return chosen.mapInArrow(work, kinds).withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``runs``: how many there are, the longest (ties: smallest start, then
    period), and digests of all runs and of the collapsed text."""
    longest = F.element_at(
        F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"], r["period"]))), 1
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    return best.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.n div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: the words of a tenth of the documents, chosen by the checksum of their id,
    turned periodic from some word on. A document without id stays as it is."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, words).alias("words"))
    n = F.size("words").cast("long")
    placed = split.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    left = n - F.col("a")
    placed = placed.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil(left / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    whole = F.concat(F.slice("words", 1, F.col("a")), F.slice(again, 1, left.cast("int")))
    text = F.when(F.col("a").isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))
