"""Token ids of whole texts by the tokenizers library, as bytes of little-endian unsigned 32-bit ids."""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable
from functools import cache
from pathlib import Path

from geoledger.llm.common import MEMOS
from geoledger.llm.pretoken import PieceEncoder

#: Ends every document.
END_ID = 0
#: The byte-level alphabet writes these bytes as themselves and the others, in order, from U+0100 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    others = (b for b in range(256) if b not in PRINTED)
    return {b: chr(b) for b in PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def encoder(path: str, added: bool = False) -> Callable[[str], bytes]:
    """A function from a text to its ids, as _encoders makes it."""
    return _encoders(path, added)[0]


@cache
def _encoders(path: str, added: bool) -> tuple[Callable[[str], bytes], Callable[[list[str]], list[bytes]]]:
    """Functions from a text to its ids, and from texts to the ids of each; one pair for each worker process.

    For a plain byte-level BPE file the library's model encodes each match of the pattern, and what it gave is remembered;
    for any other file the library encodes the whole text. With ``added``, strings of the file's added tokens are those
    tokens, as they are to the library unless it is told otherwise; without, strings of special tokens are ordinary text.
    """
    import public_tokenizers
    from tokenizers import Tokenizer, models

    made = json.loads(Path(path).read_text("utf-8"))
    model, before = made["model"], made["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE" and not made["normalizer"] and not model.get("dropout") and not model.get("ignore_merges")
        and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    )
    packed = [i.to_bytes(4, "little") for i in range(1 + max(max(model["vocab"].values()), *(t["id"] for t in made["added_tokens"]), 0))]
    if plain:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        tokenize, letters = models.BPE(model["vocab"], pairs, cache_capacity=0).tokenize, byte_letters()

        def one(piece: str) -> bytes:
            return b"".join([packed[t.id] for t in tokenize((piece if piece.isascii() else piece.encode().decode("latin-1")).translate(letters))])

        pieces = PieceEncoder(public_tokenizers.PATTERN, one)
        tokens = {t["content"]: packed[t["id"]] for t in made["added_tokens"] if added and t["content"]}
        if not tokens:
            return pieces.encode, pieces.encode_all
        if not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"]):
            return cut_at(tokens, pieces.encode, pieces.encode_all)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not added
    alone = lambda text: b"".join(map(packed.__getitem__, whole.encode(text, add_special_tokens=False).ids))
    return alone, lambda texts: list(map(alone, texts))


def forget() -> None:
    """Free the encoders and what they remember, which holds itself in a cycle."""
    if _encoders.cache_info().currsize:
        _encoders.cache_clear()
        gc.collect()


MEMOS.append(forget)


def cut_at(tokens: dict[str, bytes], ordinary: Callable[[str], bytes], ordinary_all: Callable[[list[str]], list[bytes]]) -> tuple[Callable[[str], bytes], Callable[[list[str]], list[bytes]]]:
    """Encode the leftmost, longest strings of ``tokens`` as those, and what lies between by ``ordinary``; texts without any together."""
    find = re.compile(f"({'|'.join(map(re.escape, sorted(tokens, key=len, reverse=True)))})").split

    def plain(text: str) -> bool:
        return not any(t in text for t in tokens)

    def run(text: str) -> bytes:
        if plain(text):
            return ordinary(text)
        return b"".join([tokens[p] if k % 2 else ordinary(p) for k, p in enumerate(find(text))])

    def run_all(texts: list[str]) -> list[bytes]:
        are_plain = list(map(plain, texts))
        together = iter(ordinary_all([t for t, own in zip(texts, are_plain) if own]))
        return [next(together) if own else run(t) for t, own in zip(texts, are_plain)]

    return run, run_all


def encode(text: str, path: str, added: bool = False) -> bytes:
    """Ids of the text and the end id."""
    return encoder(path, added)(text) + END_ID.to_bytes(4, "little")


def encode_all(texts: list[str], path: str, added: bool = False) -> list[bytes]:
    """What encode gives for each text."""
    end = END_ID.to_bytes(4, "little")
    return [ids + end for ids in _encoders(path, added)[1](texts)]
