"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import free_names, mix64, released

GRAMS = (2, 3)
BUCKETS = 1 << 16
#: Labelled rows that the model is fitted on, for each language (in expectation).
FIT_ROWS = 3_000
SMOOTHING = 0.5
UNKNOWN = "und"
MOST_LANGUAGES = 1_000
_SCALE = 1 << 20
_CHUNK = 1 << 19


def _grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the lower-cased text with a blank at either end, in
    chunks, so that memory doesn't grow with the text."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), _CHUNK):
        part = codes[at : at + _CHUNK + max(GRAMS) - 1].astype(np.uint64)
        for n in GRAMS:
            last = min(len(part) - n + 1, _CHUNK)
            if last <= 0:
                continue
            total = np.full(last, n, np.uint64)
            for k in range(n):
                total = (total + part[k : k + last]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
            yield (mix64(total) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """Log-probabilities in fixed point, so that sums don't depend on their order."""

    languages: list[str]
    prior: np.ndarray
    weight: np.ndarray

    def classify(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total = self.prior.copy()
        for grams in _grams(text):
            seen, times = self._sparse(grams)
            total += times @ self.weight[seen]
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp((total - total[best]) / _SCALE).sum())

    @staticmethod
    def _sparse(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row's non-zero buckets and how often each occurs."""
        counts = np.bincount(grams, minlength=BUCKETS if len(grams) > BUCKETS // 16 else 0)
        if len(grams) > len(counts) // 16:
            seen = np.flatnonzero(counts)
            return seen, counts[seen]
        return grams, np.ones(len(grams), np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a partition's rows, combined before they are shuffled."""

    def emitted(held):
        for lang, counts in held.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])],
                ["lang", "bucket", "n"],
            )

    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in held:
                if len(held) >= 64:
                    yield from emitted(held)
                    held = {}
                held[lang] = np.zeros(BUCKETS, np.int64)
            for grams in _grams(text):
                held[lang] += np.bincount(grams, minlength=BUCKETS)
    yield from emitted(held)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that the model never learns from: crc32 of the id as text leaves 2 by 4."""
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from text and non-null lang of the rows that aren't held out. Of each language
    a share of the rows, chosen by a hash of id and text, makes up the sample of about
    ``fit_rows`` rows; priors count all rows. Languages are a short list: more than
    ``MOST_LANGUAGES`` raise an error. No labelled row gives a model that knows none."""
    labelled = df.where(~held_out(id_col) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError("lang holds too many values to be a list of languages")
    if not sizes:
        return Model([], np.zeros(0, np.int64), np.zeros((BUCKETS, 0), np.int64))
    languages = sorted(row["lang"] for row in sizes)
    total = {row["lang"]: row["count"] for row in sizes}
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, fit_rows / total[lang])])
    drawn = (F.xxhash64(F.col(id_col), "text").bitwiseAND(F.lit((1 << 40) - 1)) / (1 << 40)) < share[F.col("lang")]
    counted = (
        labelled.where(drawn)
        .select("lang", "text")
        .mapInArrow(_counts, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.zeros((BUCKETS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    columns = np.array([place[x] for x in counted["lang"].to_pylist()], np.int64)
    counts[counted["bucket"].to_numpy(), columns] = counted["n"].to_numpy()
    chance = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)
    priors = np.log(np.array([total[x] for x in languages]) / sum(total.values()))
    return Model(
        languages,
        np.round(priors * _SCALE).astype(np.int64),
        np.round(np.log(chance) * _SCALE).astype(np.int64),
    )


def predict(
    df: DataFrame, model: Model, carry: list[str], names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Returns the ``carry`` columns and the two named ones for every row, repeated rows
    included. A null text, or one without a letter, is ``und`` with score 0; else the score
    is the posterior of the best language, ties going to the first in order. Columns of the
    table that bear one of the two names must not be carried."""
    parts = (model.languages, model.prior, model.weight)
    shared = df.sparkSession.sparkContext.broadcast(parts)
    chosen = df.select(*dict.fromkeys([*carry, "text"]))
    kept, text = len(carry), chosen.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        known = Model(*shared.value)
        for batch in batches:
            found = [known.classify(x) for x in batch.column(text).to_pylist()]
            columns = [
                *batch.columns[:kept],
                pa.array([x for x, _ in found], pa.string()),
                pa.array([x for _, x in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*carry, *names])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:kept]]
    return chosen.mapInArrow(work, ", ".join([*kinds, f"{names[0]} string", f"{names[1]} double"]))


def identify(df: DataFrame, id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fits on the table's own labelled rows and predicts every row: id_col, held_out,
    lang_pred, score."""
    model = fit(df, id_col, fit_rows)
    marked = df.select(id_col, "text", held_out(id_col).alias("held_out"))
    return predict(marked, model, [id_col, "held_out"])


def accepted(df: DataFrame, id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of at least
    ``least``; junk without letters and texts of no learned language go."""
    lang, score = free_names(df, "lang__", "score__")
    found = predict(df, fit(df, id_col), df.columns, (lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*df.columns)
