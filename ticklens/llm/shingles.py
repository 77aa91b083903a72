"""Word shingles as 64-bit hashes, computed for many texts at once.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A text's set holds its distinct
5-word shingles; with fewer words the whole sequence is its only shingle; without words it is
empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WORDS = 5
#: texts are hashed in blocks of about so many words
BLOCK_WORDS = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_blocks(texts: list[str | None], size: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (hashes in text order, number of them per text) for consecutive texts."""
    block: list[list[bytes]] = []
    n = 0
    for text in texts:
        words = words_of(text)
        block.append(words)
        n += len(words)
        if n >= BLOCK_WORDS:
            yield _block(block, size)
            block, n = [], 0
    if block:
        yield _block(block, size)


def _block(block: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(words) for words in block], dtype=np.int64)
    total = int(lengths.sum())
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for words in block for w in words), np.uint64, total)
    rolled = np.zeros(total, dtype=np.uint64)
    for k in range(size):
        # word k of the shingle that starts here, where it exists
        rolled *= _STEP
        following = flat[k:]
        rolled[:len(following)] += mixed(following + np.uint64(k))
    counts = np.maximum(lengths - size + 1, 0)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    starts = np.repeat(first, counts) + _within(counts)
    hashes = mixed(rolled[starts])
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        whole = np.array([xxhash.xxh3_64_intdigest(b" ".join(block[i]), seed=len(block[i])) for i in short],
                         dtype=np.uint64)
        hashes = np.insert(hashes, np.cumsum(counts)[short], whole)
        counts[short] = 1
    return hashes, counts


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def distinct_sets(texts: list[str | None], size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for hashes, counts in shingle_blocks(texts, size):
        ends = np.cumsum(counts)
        for start, end in zip(ends - counts, ends):
            yield np.unique(hashes[start:end])


def minima(flat: np.ndarray, starts: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash minima, one row per multiplier: smallest 64-bit product of each run.

    ``flat`` holds the runs' hashes one after the other, ``starts`` where each (non-empty) run
    begins. Multiplication by an odd number permutes the 64-bit integers.
    """
    out = np.empty((len(multipliers), len(starts)), dtype=np.uint64)
    if len(starts):
        product = np.empty_like(flat)
        for i, a in enumerate(multipliers):
            np.multiply(flat, a, out=product)
            np.minimum.reduceat(product, starts, out=out[i])
    return out


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    numbers = mixed(np.arange(1, n + 1, dtype=np.uint64) * _STEP + np.uint64(seed))
    return numbers | np.uint64(1)
