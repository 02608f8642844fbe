"""Ids of many texts together against the library and against one text at a time."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geoledger.llm import pretoken
from geoledger.llm.tokens import default_tokenizer, encode, encode_all

LETTERS = ["a", "B", "word", ".", "...", "#'", "-" * 9, "\n", "don", " ", " ", "  ", "\t", "\x85", "\xa0", "\x1c", "'s", "'re", '"', "1", "²", "é", "é.", "ж", "३", "ि", "́", "中", "€", "×", "\U0001f600", "<|endoftext|>", "<|"]


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(8)
    return ["".join(rng.choice(LETTERS, rng.integers(0, 14))) for _ in range(5_000)] + ["", " ", "a", "a.", "a. ", "\n", "a\n", "\na", "a.\nb", "a\n\nb", "a \nb", "a\n b"]


def test_texts_together_have_the_library_ids(odd):
    library, path = Tokenizer.from_file(default_tokenizer()), default_tokenizer()
    got = encode_all(odd, path, added=True)
    for text, ids in zip(odd, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], text
    assert encode_all(odd, path) == [encode(text, path) for text in odd]
    assert encode_all([], path) == [] and encode_all(["", ""], path) == [bytes(4)] * 2


def test_long_texts_and_many_are_cut_into_groups(odd, monkeypatch):
    want = encode_all(odd, default_tokenizer())
    monkeypatch.setattr(pretoken, "BLOCK_CHARS", 20)
    monkeypatch.setattr(pretoken, "TOGETHER_CHARS", 50)
    assert encode_all(odd, default_tokenizer()) == want


def test_a_word_is_encoded_once_whatever_marks_or_lines_follow_it():
    asked = []

    def encode_one(piece):
        asked.append(piece)
        return piece.encode()

    texts = ["a word, a word. a word!? a word.\nA wordé. a word", "the word) of a word*** a word\nA wordé, a word.\nA word\nA word;"]
    made = pretoken.PieceEncoder(public_tokenizers.PATTERN, encode_one)
    assert made.encode_all(texts) == [t.encode() for t in texts]
    assert asked.count(" word") == 1 and asked.count(" wordé") == 1 and set(made._after_space) == {"a", "word", "wordé", "of"}
