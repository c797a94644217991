"""What encoders keep is bounded, and how they learn words changes no id."""

import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

from flowwarden.llm import encode, shards
from flowwarden.llm.bpe import TextEncoder, Vocabulary, ranks_of


def words(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdeéßñ", k=draw.randint(3, 12))) for _ in range(n)]


def test_an_encoder_forgets_words_and_answers_but_no_id():
    vocabulary = Vocabulary(ranks_of(encode.vocabulary_path()))
    small = TextEncoder(vocabulary, public_tokenizers.PATTERN, max_words=200, max_states=600)
    large = TextEncoder(vocabulary, public_tokenizers.PATTERN)
    for i in range(60):
        text = " ".join(words(50, i % 40))
        assert small.encode(text) == large.encode(text) == large.pieces(text)
        assert len(small._words) + len(small._older) <= 200
        assert len(small.transducer._apart) <= 502 and len(small.transducer._continues) <= 502


def test_words_of_letters_are_learned_together(monkeypatch):
    path = shards.vocabulary_path()
    found, whole = shards.WordEncoder(path), Tokenizer.from_file(path)
    found.encode("a")
    calls, library = [], found._library

    class Counting:
        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(found, "_library", Counting())
    # some letters fall apart or change under the file's rules
    text = " ".join([*words(3000, 1), "क़क़", "İx", "ΣΣ", "ẞ", "한글", "ʰʱ"])
    want = whole.encode(text, add_special_tokens=False).ids
    assert found.encode(text) == struct.pack(f"<{len(want)}I", *want)
    assert len(calls) < 2000
