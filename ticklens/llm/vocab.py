"""Public tokenizer files applied to many short pieces: memoised per Python worker.

BPE merges never cross the pieces of a pre-tokenizer, so the ids of a text are the ids of its
pieces in order. A worker keeps the result of the pieces it met last (bounded, see ``CACHE_ENTRIES``
and ``CACHE_LENGTH``) and asks the library only for others. ``tests/llm`` compares with the library's
own encoding of whole texts.
"""

from __future__ import annotations

import regex

#: pieces that a memo remembers, at most, and the characters of a piece it remembers, at most: an entry
#: takes about 300 bytes (600 at most), so a memo stays at about 150 MB
CACHE_ENTRIES, CACHE_LENGTH = 500_000, 40


def byte_alphabet() -> dict[int, str]:
    """Code point that byte-level BPE writes for each byte: printable Latin-1 stands for itself,
    the other bytes take the code points from 256 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Memo(dict):
    """A dictionary that computes missing values. It holds at most ``limit`` of them, in two generations:
    when the young one is full the old one goes, so what is asked for again and again stays. Values of
    keys beyond ``length`` characters are not kept."""

    def __init__(self, compute, limit: int = CACHE_ENTRIES, length: int = CACHE_LENGTH):
        super().__init__()
        self.compute, self.size, self.length = compute, max(limit // 2, 1), length
        self.old: dict = {}

    def __missing__(self, key):
        if len(key) > self.length:
            return self.compute(key)
        value = self.old.get(key)
        value = self.compute(key) if value is None else value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def load(name: str):
    """The tokenizer of a file of ``public_tokenizers`` (a name) or at a path."""
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if "/" not in name:
        import public_tokenizers
        name = str(public_tokenizers.path(name))
    return Tokenizer.from_file(name)


class Pieces:
    """Library ids of single pre-tokenizer pieces."""

    def __init__(self, tokenizer):
        self.model, self.alphabet = tokenizer.model, byte_alphabet()

    def __call__(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", self.alphabet[32])
        else:
            spelled = piece.encode("utf-8").decode("latin-1").translate(self.alphabet)
        return [token.id for token in self.model.tokenize(spelled)]


#: FIXED VALUE: the pre-tokenizer pattern of byte_bpe_50k.json (byte-level, ``use_regex``)
BYTE_LEVEL = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: FIXED VALUE: the pre-tokenizer pattern of word_bpe_49k.json
WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
