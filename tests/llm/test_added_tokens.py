"""Ids of the registered queries against the library's default settings."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from geoledger.llm.queries import QUERIES
from geoledger.llm.tokens import default_tokenizer, encode

TEXTS = {1: "a <|endoftext|> b", 2: "<|endoftext|><|endoftext|>", 3: "plain words", 4: "  <|endoftext|>\n\n <|endoftext|", 5: "", 6: "x " * 1_500 + "<|endoftext|> y"}


def packed(ids):
    return np.array([*ids, 0], "<u4")


def test_encoding_equals_the_library_by_default():
    library, rng = Tokenizer.from_file(default_tokenizer()), np.random.default_rng(3)
    letters = ["a", ".", "\n", "don", " ", "  ", "'s", "1", "é", "<|endoftext|>", "<|", "endoftext|>", "中"]
    for _ in range(2_000):
        text = "".join(rng.choice(letters, rng.integers(0, 14)))
        assert np.frombuffer(encode(text, default_tokenizer(), added=True), "<u4").tolist() == packed(library.encode(text, add_special_tokens=False).ids).tolist(), text


def test_queries_have_the_library_ids(spark, tmp_path):
    library = Tokenizer.from_file(default_tokenizer())
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids = {k: packed(library.encode(t, add_special_tokens=False).ids) for k, t in TEXTS.items()}
    at = 0
    for row in QUERIES["op10_token_files"](spark, str(tmp_path)).orderBy("doc_id").collect():
        want = ids[row["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    for got in (QUERIES["op1_packing"](spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        rows = got.collect()
        assert {r["doc_id"] for r in rows} == set(TEXTS)
        for r in rows:
            want = ids[r["doc_id"]]
            assert r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes())


def test_words_around_a_line_s_end_take_no_room():
    from geoledger.llm.pretoken import PieceEncoder

    made = PieceEncoder(r"\s?\w+|\s", lambda piece: piece.encode())
    assert made.encode("a word\nline word\nline") == b"a word\nline word\nline"
    assert set(made._after_space) == {"word"}


def test_files_parts_are_counted_from_the_sample_that_is_drawn():
    from geoledger.llm import idfile

    assert idfile._text_bytes([10, 30], 100) == 2_000 and idfile._text_bytes([], 0) == 0
