"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Every document becomes its set of hashed five-word shingles. Equal sets are one class. One
hash value deals a set's shingles into bins and each bin keeps its smallest; an empty bin
takes the value of a filled one that a hash of bin and attempt picks, the same for all
documents. Bands of bins are bucket keys. In a bucket only links to its smallest member are
tried, on the full sets. What may still be linked across groups forms the next, smaller stars
over each document's rarest shingles, with more hubs each, until no bucket holds two such
groups: no pair is left out unless it is within one group, too far apart by the triangle
inequality, or without a common bucket of either kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.llm.common import free_names, kept, mix64, released, splits, stored, texts_of
from flowwarden.llm.components import components

WORDS = 5
BINS, ROWS = 128, 4
LATER_HUBS = 64
_CHUNK = 1 << 20
_U = np.uint64


def _randoms(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False
_BYTE = np.where(_IS_WORD, _randoms(256, 1), _U(0))
_PLACE = _randoms(WORDS, 2)
_SHORT = _randoms(WORDS, 3)
_BASE = 0x2545F4914F6CDD1D


def _powers(base: int) -> np.ndarray:
    return kept(("powers", base), lambda: np.cumprod(np.full(_CHUNK, base, _U)))


def _hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of up to _CHUNK bytes, and the number of words of each row."""
    word = _IS_WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = word[first]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.empty(0, _U), np.zeros(len(offsets) - 1, np.int64)
    sums = np.add.reduceat(_BYTE[_LOWER[data]] * _powers(_BASE)[: len(data)], at)
    return mix64(sums * _powers(pow(_BASE, -1, 1 << 64))[at]), np.diff(np.searchsorted(at, offsets))


def _row_words(data: np.ndarray) -> np.ndarray:
    """The same for one row of any length, in pieces that end between words."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~_IS_WORD[data[at:end]])
            if not len(gaps):  # a word longer than a chunk
                rest = np.flatnonzero(~_IS_WORD[data[at:]])
                end = at + int(rest[0]) if len(rest) else len(data)
                if end - at <= _CHUNK:  # just as long as a chunk: hashed like any word
                    parts.append(_hash_words(data[at:end], np.array([0, end - at]))[0])
                    at = end
                    continue
                digest = hashlib.blake2b(_LOWER[data[at:end]].tobytes(), digest_size=8).digest()
                parts.append(np.frombuffer(digest, _U))
                at = end
                continue
            end = at + int(gaps[-1]) + 1
        parts.append(_hash_words(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, _U)


def _set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of a row's words."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        return mix64((words * _PLACE[:n]).sum(keepdims=True, dtype=_U) + _SHORT[n - 1])
    last = n - WORDS + 1
    total = words[:last] * _PLACE[0]
    for k in range(1, WORDS):
        total += words[k : k + last] * _PLACE[k]
    total = np.sort(mix64(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row its set of shingles as sorted 64-bit hashes; empty without words."""
    data, offsets = texts_of(column)
    for a, b in splits(offsets, _CHUNK):
        if offsets[b] - offsets[a] > _CHUNK:
            yield _set(_row_words(data[offsets[a] : offsets[b]]))
            continue
        own = offsets[a : b + 1] - offsets[a]
        hashes, counts = _hash_words(data[offsets[a] : offsets[b]], own)
        ends = np.cumsum(counts)
        for end, n in zip(ends, counts, strict=True):
            yield _set(hashes[end - n : end])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each set; rows of empty sets mean nothing."""
    shift = _U(64 - BINS.bit_length() + 1)
    out = np.zeros((len(sets), BINS), np.uint32)
    filled = np.zeros((len(sets), BINS), bool)
    for i, found in enumerate(sets):
        if len(found):
            bins = found >> shift
            first = np.concatenate(([True], bins[1:] != bins[:-1]))
            at = bins[first].astype(np.int64)
            out[i, at] = (found[first] << (_U(64) - shift)) >> _U(32)
            filled[i, at] = True
    rows, bins = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    attempt = 0
    while len(rows):
        attempt += 1
        source = (mix64((bins + BINS * attempt).astype(_U) * _U(_BASE)) >> shift).astype(np.int64)
        hit = filled[rows, source]
        out[rows[hit], bins[hit]] = out[rows[hit], source[hit]]
        rows, bins = rows[~hit], bins[~hit]
    return out


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """Bucket keys: one for each set and band."""
    bands = signatures(sets).reshape(len(sets), BINS // ROWS, ROWS).astype(_U)
    total = np.arange(1, BINS // ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        total = mix64(total + bands[:, :, k] * _PLACE[k])
    return total.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    released("powers")
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sets = list(shingle_sets(part.column(1)))
            keys = _keys(sets)
            ends = np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())),
                ],
                ["doc", "n", "digest", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            packed = pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), packed], ["doc", "shingles"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    released("powers")
    for batch in batches:
        distance, linked = [], []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(left.as_buffer(), _U), np.frombuffer(right.as_buffer(), _U)
            both = np.concatenate((a, b))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            every = len(a) + len(b) - shared
            distance.append(1 - shared / every)
            linked.append(100 * shared >= 75 * every)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())],
            ["a", "b", "distance", "linked"],
        )


def _among(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc is wanted. A bitmap of fixed size, at most 2^18 words of 64 bits,
    keeps most others out of the shuffle."""
    place = F.xxhash64("doc").bitwiseAND(F.lit((1 << 24) - 1))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    bits = (
        wanted.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    marked = texts.withColumn("place", place).withColumn("word", F.shiftright("place", 6))
    near = marked.join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return near.select("doc", "text").join(wanted, "doc", "left_semi")


def _open(members: DataFrame, groups: DataFrame | None, centre: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that may still hold a link between two groups; ``groups`` is None
    where they are as before.

    Hubs have met all others of their bucket. A member of the first hub's group can go too
    if it is nearer to that hub than every other group by more than a link's length: shares
    of shingles make a metric, so no link can lead from it to another group.
    """
    columns = [c for c in members.columns if c != "group"]
    if groups is not None:
        of_doc = groups.select(F.col("node").alias("doc"), F.col("component").alias("group"))
        placed = members.select(*columns).join(of_doc, "doc", "left")
        placed = stored(placed.withColumn("group", F.coalesce("group", "doc")), "placed")
    elif "group" in members.columns:
        placed = members
    else:
        placed = members.withColumn("group", F.col("doc"))
    mixed = placed.groupBy("key").agg(
        F.min("group").alias("low"),
        F.max("group").alias("high"),
        F.min("doc").alias("hub"),
        F.min_by(F.struct("n", "group"), "doc").alias("x"),
    )
    mixed = mixed.where("low < high").select("key", "hub", F.col("x.n").alias("hub_n"), F.col("x.group").alias("hub_group"))
    met = found.select(F.col("a").alias("hub"), F.col("b").alias("doc"), "distance")
    star = placed.join(mixed, "key").join(met, ["hub", "doc"], "left")
    star = stored(star.withColumn("own", F.col("group") == F.col("hub_group")), "star")
    least = F.coalesce("distance", 1 - F.least("n", "hub_n") / F.greatest("n", "hub_n"))
    others = star.where("NOT own").groupBy("key").agg(F.min(least).alias("nearest"))
    hubs = centre.select("key", F.col("hub_doc").alias("doc"))
    return _several(
        star.join(others, "key")
        .where(~F.col("own") | (F.coalesce("distance", F.lit(1.0)) + 0.25 + 1e-9 >= F.col("nearest")))
        .join(hubs, ["key", "doc"], "left_anti")
        .select(*columns, "group")
    )


def _several(members: DataFrame) -> DataFrame:
    """The members of buckets that hold two groups or more."""
    ends = members.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    return members.join(ends.where("low < high").select("key"), "key")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            found = np.frombuffer(batch.column(3)[row].as_buffer(), np.int64)
            for at in range(0, len(found), 1 << 16):
                part = found[at : at + (1 << 16)]
                same = [pa.repeat(batch.column(k)[row], len(part)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(part), *same], ["key", "doc", "n", "group"])


def _rarest(members: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """The same documents in exact buckets: one for each of a document's rarest shingles.

    Two sets that link share 75 % of either, so they share one of the n - ceil(0.75 n) + 1
    shingles that are rarest in each by one order. Where many documents share a passage and
    no more, their rarest shingles differ and they meet nowhere.
    """
    docs = members.select("doc", "n", "group").distinct()
    rows = docs.join(sets, "doc").select("doc", "n", "group", "shingles")
    single = stored(rows.mapInArrow(_shingles, f"key long, doc {kind}, n long, group {kind}"), "single")
    often = single.groupBy("key").agg(F.count("*").alias("docs")).where("docs > 1")
    own = Window.partitionBy("doc")
    ranked = single.join(often, "key").withColumns({
        "place": F.row_number().over(own.orderBy("docs", "key")),
        "often": F.count("*").over(own),
    })
    # shingles of one document alone come first in the order and are not among the rows
    prefix = ranked.withColumn("at", F.expr("place + n - often")).where("at <= n - ceil(0.75 * n) + 1")
    return _several(prefix.select("key", "doc", "n", "at", "group"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_shingles, component_id, kept for every row, repeated rows included.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a set holds the
    distinct shingles of five words, the whole sequence where there are fewer words, and is
    empty without words or text: such rows link with nothing and keep their own id. Two rows
    link where shared shingles are at least 75 % of all; component_id is the smallest id
    reachable. Rows that share an id count as one document, compared by its smallest text; rows
    without an id are compared with none. A pair at exactly 75 % shares no bucket with probability 5e-6.
    """
    texts = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    described = stored(
        texts.mapInArrow(_describe, f"doc {kind}, n long, digest binary, keys array<long>"), "minhash"
    )
    usable = described.where("doc IS NOT NULL AND digest IS NOT NULL")
    first = F.min_by(F.struct("n", "keys"), "doc")
    classes = stored(
        usable.groupBy("digest").agg(F.min("doc").alias("doc"), first.alias("x")).select("digest", "doc", "x.*"),
        "classes",
    )
    bands = classes.select("doc", "n", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("other"))
    members = stored(
        bands.join(buckets.where("hub < other").select("key"), "key").select("key", "doc", "n"), "members"
    )
    wanted = members.select("doc").distinct()
    compared = _among(texts, wanted).groupBy("doc").agg(F.min("text").alias("text"))
    sets = stored(compared.mapInArrow(_sets, f"doc {kind}, shingles binary"), "sets")
    links, groups, hubs = None, None, 1
    while not members.isEmpty():
        place = F.row_number().over(Window.partitionBy("key").orderBy("doc"))
        centre = members.withColumn("place", place).where(F.col("place") <= hubs).select(
            "key", "place", *[F.col(c).alias(f"hub_{c}") for c in members.columns if c != "key"]
        )
        near = members.join(centre, "key").where("doc > hub_doc AND 4 * least(n, hub_n) >= 3 * greatest(n, hub_n)")
        if "group" in members.columns:
            # where the first shared shingle of a link may stand in both
            shared = F.ceil(3 * (F.col("n") + F.col("hub_n")) / 7 - 1e-9)
            first = (F.col("at") + shared <= F.col("n") + 1) & (F.col("hub_at") + shared <= F.col("hub_n") + 1)
            near = near.where((F.col("place") == 1) | ((F.col("group") != F.col("hub_group")) & first))
        tried = near.select(F.col("hub_doc").alias("a"), F.col("doc").alias("b")).distinct()
        pairs = (
            tried.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right")), "b")
            .join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left")), "a")
            .select("a", "b", "left", "right")
        )
        found = stored(pairs.mapInArrow(_compared, f"a {kind}, b {kind}, distance double, linked boolean"), "found")
        new = found.where("linked").select("a", "b")
        changed = not new.isEmpty()
        if changed:
            links = new if links is None else links.union(new)
            groups = stored(components(links), "groups")
            links = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        members = stored(_open(members, groups if changed else None, centre, found), "members")
        if hubs == 1 and not members.isEmpty():
            members = stored(_rarest(members, sets, kind), "rarest")
        hubs *= LATER_HUBS
    if links is None:
        named = classes.withColumn("component", F.col("doc"))
    else:
        named = classes.join(groups.withColumnRenamed("node", "doc"), "doc", "left")
        named = named.withColumn("component", F.coalesce("component", "doc"))
    named = named.select("digest", "component")
    out = described.drop("keys").join(named, "digest", "left")
    if links is not None:
        out = out.withColumn("component", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")))
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of near-duplicates: the smallest id, and
    of rows that share it the one with the smallest text. Rows without an id all stay."""
    (own,) = free_names(df, "kept__")
    found = near_duplicates(df, id_col, text_col).where("kept")
    smallest = found.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(own)).distinct()
    row = F.min_by(F.struct(*df.columns), F.coalesce(F.col(text_col), F.lit("")))
    named = df.join(smallest, F.col(id_col) == F.col(own)).groupBy(own).agg(row.alias("row"))
    return named.select("row.*").union(df.where(F.col(id_col).isNull()))
