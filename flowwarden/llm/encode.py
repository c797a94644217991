"""Byte-level BPE over a table: texts to ids and ids back to texts."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.bpe import MAX_STATES, MAX_WORDS, StreamingDecoder, TextEncoder, Vocabulary, ranks_of
from flowwarden.llm.common import kept, released

_SLICE = 512
#: Ids that the streaming decoder takes at a time.
STEP = 65_536


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _tokens(path: str) -> dict[int, bytes]:
    return kept(("tokens", path), lambda: {rank: token for token, rank in ranks_of(path).items()})


def _encoder(path: str, pattern: str, words: int, states: int) -> TextEncoder:
    """One encoder per Python worker: its states and words serve all tasks of the worker."""
    key = ("byte-level", path, pattern, words, states)
    return kept(key, lambda: TextEncoder(Vocabulary(ranks_of(path)), pattern, words, states))


def _lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _text(ids: np.ndarray, tokens: dict[int, bytes], step: int) -> bytes:
    stream = StreamingDecoder(tokens)
    parts = [stream.feed(ids[at : at + step].tolist()) for at in range(0, len(ids), step)]
    stream.finish()
    return b"".join(parts)


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    decoded: bool = False,
    max_words: int = MAX_WORDS,
    max_states: int = MAX_STATES,
) -> DataFrame:
    """Returns id_col and ids (array<int>) for every row, repeated rows included; a null or
    empty text has no ids. With ``decoded`` the ids are decoded again in the same pass, into
    a column of that name. Other columns don't matter, whatever their names. A row's ids
    depend on its text alone. A worker keeps ``max_words`` and ``max_states`` at most; fewer
    take less memory and more time. The vocabulary file must exist on every machine."""
    path = vocabulary or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released("byte-level")
        coder = _encoder(path, pattern, max_words, max_states)
        gc.disable()  # the transducer's many small objects hold no cycles
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, _SLICE):
                    part = batch.slice(at, _SLICE)
                    found = [coder.encode(text or "") for text in part.column(1).to_pylist()]
                    columns, names = [part.column(0), _lists(found)], ["id", "ids"]
                    if decoded:
                        ids = (np.frombuffer(x, np.int32) for x in found)
                        texts = [_text(x, coder.tokens, STEP) for x in ids]
                        columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                        names.append("decoded")
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            gc.enable()
            released("byte-level")

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids array<int>" + ", decoded string" * decoded
    return chosen.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def decode(
    df: DataFrame,
    id_col: str = "doc_id",
    ids_col: str = "ids",
    vocabulary: str | None = None,
    step: int = STEP,
) -> DataFrame:
    """Returns id_col, ids_col and decoded (string) for every row; null ids are an empty
    text. Ids are read ``step`` at a time; those that are no UTF-8 text, or that the
    vocabulary lacks, raise an error."""
    path = vocabulary or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                lists = part.column(1)
                values = lists.values.to_numpy(zero_copy_only=False)
                starts = lists.offsets.to_numpy()
                valid = lists.is_valid().to_numpy(zero_copy_only=False)
                found = [
                    _text(values[a:b], tokens, step) if ok else b""
                    for a, b, ok in zip(starts, starts[1:], valid, strict=False)
                ]
                texts = pa.array(found, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, texts], ["id", "ids", "decoded"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = chosen.schema["id"].dataType.simpleString()
    found = chosen.mapInArrow(work, f"id {kind}, ids array<int>, decoded string")
    return found.withColumnRenamed("id", id_col).withColumnRenamed("ids", ids_col)


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of a decoded table: number of ids, and digests of the ids and of the text."""
    return df.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
