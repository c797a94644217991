"""Byte-level BPE, token shards, language ID: against libraries and plain loops."""

import math
import random
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowwarden.llm import bpe, encode, langid, shards

ALPHABET = "ab \n\t\r'sté \x1c\x85　日本1２٣.,!- 𝒳é🙂<|>İΣ"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.ranks_of(encode.vocabulary_path())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples(n, seed=3):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_transducer_equals_library(ranks, library):
    coder = bpe.TextEncoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN, max_words=500)
    coder.transducer.max_states = 200  # states are forgotten and made again
    for text in [*samples(1500), "x" * 5000, "the of and " * 3000, "  a   b\n\n c \n d"]:
        want = library.encode_ordinary(text)
        assert coder.encode(text) == struct.pack(f"<{len(want)}I", *want)


def test_neighbours_apart_equals_merging(ranks):
    known, draw = bpe.Vocabulary(ranks), random.Random(1)
    tokens = sorted(known.tokens)
    for _ in range(3000):
        a, b = draw.choice(tokens), draw.choice(tokens[:4000])
        assert known.apart(a, b) == (known.merged(known.tokens[a] + known.tokens[b]) == [a, b])


def test_decoder_in_single_ids(ranks, library):
    tokens = {rank: token for token, rank in ranks.items()}
    for text in samples(300, 5):
        stream, parts = bpe.StreamingDecoder(tokens), []
        for number in library.encode_ordinary(text):
            parts.append(stream.feed([number]))
            parts[-1].decode()  # never half a character
        stream.finish()
        assert b"".join(parts).decode() == text


def test_decoder_refuses_broken_text(ranks):
    stream = bpe.StreamingDecoder({0: b"\xe2", 1: b"\x28"})
    with pytest.raises(ValueError):
        stream.feed([0, 1])
        stream.finish()


def test_encode_table(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "née  the", "z"), (3, "née  the", "z"), (None, "a\nb", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = encode.encode(df)
    got = sorted((r.doc_id or 0, r.ids) for r in ids.collect())
    assert got == sorted((a or 0, library.encode_ordinary(b or "")) for a, b, _ in rows)
    back = {r.doc_id: r.decoded for r in encode.decode(ids).collect()}
    assert back == {1: "", 2: "", 3: "née  the", None: "a\nb"}
    assert encode.encode(df, decoded=True).where("decoded = 'née  the'").count() == 2
    assert encode.encode(df.limit(0)).count() == 0


def test_word_encoder_equals_library():
    path = shards.vocabulary_path()
    whole, words = Tokenizer.from_file(path), shards.WordEncoder(path, max_words=400)
    whole.encode_special_tokens = True
    for text in [*samples(1500, 7), "İ. Σ. é. <|endoftext|> don't. O'Neil's", "x" * 3000]:
        want = whole.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == struct.pack(f"<{len(want)}I", *want), text


def test_shards_round_trip(spark, tmp_path):
    rows = [(5, "the cat"), (-2, None), (9, "x " * 4000), (5, "a dog"), (5, "a dog"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    made = shards.write_shards(df, str(tmp_path))
    got = shards.read_shards(made, str(tmp_path)).orderBy("start").collect()
    library, at = Tokenizer.from_file(shards.vocabulary_path()), 0
    assert [r.doc_id for r in got] == [None, -2, 5, 5, 5, 9]
    want = {}
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(doc, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    first = made.orderBy("shard").first()
    file = shards.Shard(str(tmp_path), first.shard)
    assert file.ids(0)[-1] == 1
    file.close()


def test_shards_of_added_tokens(spark, tmp_path):
    texts = ["a<|endoftext|>b", "(<|startoftext|>), x.<|endoftext|>.", "<|endoftext|>", "İ<|STARTOFTEXT|>!<|endoftext|><|startoftext|>é\u0301", "the end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = shards.read_shards(shards.write_shards(df, str(tmp_path)), str(tmp_path)).orderBy("doc_id").collect()
    library, at = Tokenizer.from_file(shards.vocabulary_path()), 0
    assert library.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]
    for r, text in zip(got, texts, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_word_encoder_of_added_tokens_equals_library():
    path, draw = shards.vocabulary_path(), random.Random(11)
    whole, words = Tokenizer.from_file(path), shards.WordEncoder(path, max_words=400, added=True)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", *ALPHABET]
    for text in ("".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(1500)):
        want = whole.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == struct.pack(f"<{len(want)}I", *want), text


def test_shards_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shards.read_shards(shards.write_shards(df, str(tmp_path)), str(tmp_path)).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right = rows.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.95


def test_language_brute_force(spark):
    rows = [(i, "la casa y el perro", "es") for i in range(40)] + [(i, "the house and dog", "en") for i in range(40, 80)]
    rows += [(90, None, "en"), (91, "123 !!", "en"), (92, "", None), (93, "the dog " * 200_000, None), (93, "el perro", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.fit(df)
    assert model.languages == ["en", "es"]
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(df).collect())
    want = sorted((i, *model.classify(text)) for i, text, _ in rows)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(0 <= x[2] <= 1 for x in got)
    found = {i: lang for i, lang, _ in got if i in (90, 91, 92)}
    assert found == {90: "und", 91: "und", 92: "und"}
    kept = langid.accepted(df)
    assert kept.columns == df.columns and kept.where("doc_id BETWEEN 90 AND 92").count() == 0


def plain_bucket(gram):
    mask, value = (1 << 64) - 1, len(gram)
    for char in gram:
        value = (value + ord(char)) * 0x9E3779B97F4A7C15 & mask
        value ^= value >> 29
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        value = (value ^ value >> shift) * factor & mask
    return (value ^ value >> 31) & 0xFFFF


def plain_grams(text):
    padded = f" {text.lower()} "
    return [plain_bucket(padded[i : i + n]) for n in (2, 3) for i in range(len(padded) - n + 1)]


def test_language_equals_plain_naive_bayes(spark):
    """Counts, smoothing, priors and posteriors anew, with dictionaries and logarithms."""
    draw = random.Random(4)
    vocabulary = {"en": "the house and dog of water stone", "es": "la casa y el perro de agua", "de": "das haus und der hund von"}
    rows = []
    for i in range(240):
        lang = draw.choice(["en", "en", "es", "de"])
        words = vocabulary[lang].split() + (vocabulary["es"].split() if i % 5 == 0 else [])
        rows.append((i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 12))), lang if i % 7 else None))
    learned = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    languages = sorted({lang for _, lang in learned})
    counts = {lang: {} for lang in languages}
    for text, lang in learned:
        for bucket in plain_grams(text):
            counts[lang][bucket] = counts[lang].get(bucket, 0) + 1
    want = {}
    for i, text, _ in rows:
        scores = []
        for lang in languages:
            total = sum(counts[lang].values()) + 0.5 * 65_536
            score = math.log(sum(x == lang for _, x in learned) / len(learned))
            score += sum(math.log((counts[lang].get(b, 0) + 0.5) / total) for b in plain_grams(text))
            scores.append(score)
        best = max(range(len(languages)), key=lambda k: (scores[k], -k))  # noqa: B023
        want[i] = (languages[best], 1 / sum(math.exp(s - scores[best]) for s in scores))
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=2e-4)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(df).first()[1:] == (False, "und", 0.0)
    assert langid.identify(df.limit(0)).count() == 0
