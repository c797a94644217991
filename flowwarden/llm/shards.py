"""Token ids in binary shards: documents compressed one by one with a shared dictionary.

A shard is two files. The data file holds one zstandard frame per document: its ids as
little-endian integers of two bytes, four where the vocabulary needs them. The index holds
the hash of the dictionary, the width, and for each document its id, the ids before it in the
shard, their number and the place of its frame, so one document is read by one seek. The
dictionary is a third file, named by its hash.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.llm.common import kept, reader, scratch_path, stored, writer

END_ID = 1
#: Documents, and bytes of each, that the dictionary is trained on (in expectation).
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 16_384
DICTIONARY_BYTES = 65_536
#: New words that the library sees as one text.
_JOINED = 1_000
_MAGIC = b"IDX1"
_HEADER = "<4sQIQ"
_ROW = np.dtype([("id", "<i8"), ("null", "u1"), ("start", "<i8"), ("n", "<i8"), ("at", "<i8")])


def vocabulary_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a text by the tokenizers library, which sees each distinct word once.

    The file's rules turn runs of white space into one blank, lower-case letter by letter
    and never join across white space, so a text's ids are those of its parts between blanks
    and line ends. New words of letters are joined to one text, whose ids fall apart again
    at the vocabulary's ends of words. At most ``max_words`` are kept, then all are forgotten. With ``added`` the
    file's added tokens, which hold no blank, are found in a text as the library does unless
    told otherwise; without, they are text like any other.
    """

    def __init__(self, path: str, max_words: int = 1_500_000, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = not added
        self.size = self._library.get_vocab_size()
        self.max_words = max_words
        self._words: dict[str, bytes] = {}
        self._ends = self._word_ends()

    def _word_ends(self) -> np.ndarray | None:
        """For each id whether it ends a word; None where a word might end without such an id."""
        suffix = getattr(self._library.model, "end_of_word_suffix", None)
        from tokenizers.pre_tokenizers import ByteLevel

        known = self._library.get_vocab()
        if not suffix or not all(x + suffix in known for x in ByteLevel.alphabet()):
            return None
        ends = np.zeros(max(known.values()) + 1, bool)
        ends[[number for token, number in known.items() if token.endswith(suffix)]] = True
        return ends

    def _learn(self, missing: list[str]) -> None:
        library, joined = self._library, []
        if self._ends is not None:
            joined = [w for w in missing if w.isalpha()]
            missing = [w for w in missing if not w.isalpha()]
        blocks = [joined[i : i + _JOINED] for i in range(0, len(joined), _JOINED)]
        texts = [" ".join(block) for block in blocks]
        for block, found in zip(blocks, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = (np.flatnonzero(self._ends[ids]) + 1) * 4
            if len(cuts) != len(block):  # every word has an end, so some word has several
                missing += block
                continue
            data, at = ids.tobytes(), 0
            for word, end in zip(block, cuts.tolist(), strict=True):
                self._words[word] = data[at:end]
                at = end
        for word, found in zip(missing, library.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            self._words[word] = pack(f"<{len(found)}I", *found.ids)

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        known = self._words
        if missing := set(words).difference(known):
            if len(known) + 2 * len(missing) > self.max_words:
                known.clear()
                missing = set(words)
            ended = {w for w in missing if w[-1:] in ".,;:!?" and w[:-1].lower().isalpha()}
            plain = (missing - ended) | {w[:-1] for w in ended} | {w[-1] for w in ended}
            self._learn(list(plain.difference(known)))
            for word in ended:
                known[word] = known[word[:-1]] + known[word[-1]]
        return b"".join(map(known.__getitem__, words))


def _coder(path: str) -> WordEncoder:
    return kept(("words", path), lambda: WordEncoder(path, added=True))


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def train_dictionary(texts: DataFrame, path: str, rows: int = SAMPLE_ROWS) -> bytes:
    """A dictionary from the ids of about ``rows`` texts chosen by hash, at most
    SAMPLE_BYTES of each; too few samples to train on become the dictionary themselves."""
    total = texts.count()
    if not total:
        return b""
    share = F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 40) - 1)) / (1 << 40) < rows / total

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            found = [np.frombuffer(coder.encode(x or ""), "<u4") for x in batch.column(0).to_pylist()]
            packed = [x.astype(_width(coder.size)).tobytes()[:SAMPLE_BYTES] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["ids"])

    drawn = texts.where(share).select("text").mapInArrow(work, "ids binary").limit(2 * rows)
    samples = sorted(row["ids"] for row in drawn.collect() if row["ids"])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _loaded(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "little")


def write_shards(
    df: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Writes every row's ids, with ``end_id`` after them, in ascending order of id (null
    first, rows of one id in the order of a hash of their text), and returns the shards: shard,
    base (ids in earlier shards), n_docs, n_tokens. Null texts are empty. Ranges of ids are
    shards; rows of one id are spread over several by the hash. No rows give no shard."""
    path = vocabulary or vocabulary_path()
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    trained = train_dictionary(texts, path)
    number = _hash(trained)
    with writer(f"{folder}/dictionary-{number:016x}") as out:
        out.write(trained)
    shared = df.sparkSession.sparkContext.broadcast(trained)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = _coder(path), TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=1, dict_data=_loaded(shared.value))
        name, parts, at, start = f"{folder}/shard-{shard:07d}", [], 0, 0
        tail = np.array([end_id], "<u4").tobytes()
        with writer(f"{name}.ids") as out:
            for batch in batches:
                rows = np.zeros(batch.num_rows, _ROW)
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for i, (doc, text) in enumerate(pairs):
                    ids = np.frombuffer(coder.encode(text or "") + tail, "<u4")
                    frame = squeeze.compress(ids.astype(_width(coder.size)).tobytes())
                    rows[i] = (doc or 0, doc is None, start, len(ids), at)
                    out.write(frame)
                    at, start = at + len(frame), start + len(ids)
                parts.append(rows)
        index = np.concatenate(parts) if parts else np.zeros(0, _ROW)
        if len(index):
            with writer(f"{name}.idx") as out:
                out.write(struct.pack(_HEADER, _MAGIC, number, int(_width(coder.size)[-1]), len(index)))
                out.write(index.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()) for x in (shard, len(index), start)],
                ["shard", "n_docs", "n_tokens"],
            )

    order = ["id", F.xxhash64("text"), "text"]
    ordered = texts.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    shards = stored(ordered.mapInArrow(work, "shard long, n_docs long, n_tokens long"), "shards")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


class Shard:
    """Reads one shard: whole, in order, or a single document."""

    def __init__(self, folder: str, shard: int):
        name = f"{folder}/shard-{shard:07d}"
        with reader(f"{name}.idx") as index:
            magic, number, width, n = struct.unpack(_HEADER, index.read(struct.calcsize(_HEADER)))
            if magic != _MAGIC:
                raise ValueError(f"{name} is no shard")
            self.rows = np.frombuffer(index.read(n * _ROW.itemsize), _ROW)
        with reader(f"{folder}/dictionary-{number:016x}") as file:
            trained = file.read()
        if _hash(trained) != number:
            raise ValueError(f"the dictionary of {name} is another")
        self._kind, self._data = f"<u{width}", reader(f"{name}.ids")
        self._unpack = zstandard.ZstdDecompressor(dict_data=_loaded(trained))
        self._ends = np.append(self.rows["at"][1:], self._data.size())

    def ids(self, i: int) -> np.ndarray:
        begin = int(self.rows["at"][i])
        self._data.seek(begin)
        frame = self._data.read(int(self._ends[i]) - begin)
        return np.frombuffer(self._unpack.decompress(frame), self._kind).astype("<u4")

    def close(self) -> None:
        self._data.close()


def read_shards(shards: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Returns id_col, start (ids of all documents before), n_tokens and ids_crc32 of every
    document, read from the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch["shard"].to_pylist(), batch["base"].to_pylist(), strict=True):
                file = Shard(folder, shard)
                for at in range(0, len(file.rows), 10_000):
                    rows = file.rows[at : at + 10_000]
                    found = [file.ids(at + i) for i in range(len(rows))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rows["id"], mask=rows["null"].astype(bool)),
                            pa.array(rows["start"] + base),
                            pa.array([len(x) for x in found], pa.int64()),
                            pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()),
                        ],
                        ["id", "start", "n_tokens", "ids_crc32"],
                    )
                file.close()

    files = shards.count()  # an explicit number: else the short list ends up in one task
    listed = shards.select("shard", "base").repartitionByRange(max(files, 1), "shard")
    found = listed.mapInArrow(work, "id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder = scratch_path(df.sparkSession, "ids")
    return read_shards(write_shards(df, folder, id_col, text_col), folder, id_col)
