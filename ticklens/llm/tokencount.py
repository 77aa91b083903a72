"""Token counts by overlap resynchronisation (operator 2).

A text longer than ``chunk_chars`` is encoded in overlapping chunks. Every chunk yields its
pieces as (end offset in the text, tokens so far). Two neighbouring chunks are spliced at a
common boundary that is proven stable:

* BPE merges stay inside a pre-tokenizer piece, so counts add up over pieces;
* the pattern matches from left to right and looks at most one character beyond a match, so a
  piece of the left chunk that ends at least ``margin`` characters before the chunk's end is the
  piece of the whole text, given that the chunk began at a true boundary or was itself spliced;
* from a position that is a boundary in both chunks on, both read the same characters with the
  same rule, hence the right chunk continues the whole text's pieces.

The margin also covers special strings that a chunk's end would cut. When no common boundary
lies in the overlap (one piece longer than the overlap), the overlap is widened: the right chunk
starts twice as far back, at the latest at the last accepted boundary itself, where alignment is
certain; a chunk without any stable piece is doubled to the right. So the result never depends on
chunk size or overlap. Null and empty texts have 0 tokens. Rows are independent: no shuffle, and
memory is bounded by a chunk's pieces.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ticklens.llm import vocab
from ticklens.llm.common import text_of

TOKENIZER = "byte_bpe_50k.json"
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10


class ByteLevelCounter:
    """Counts tokens as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, name: str = TOKENIZER):
        tokenizer = vocab.load(name)
        ids = vocab.Pieces(tokenizer)
        self.pieces = vocab.Memo(lambda piece: len(ids(piece)))
        self.words = vocab.Memo(self._count_parts)
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = vocab.regex.compile("|".join(map(vocab.regex.escape, specials)))
        self.margin = 2 + max(map(len, specials), default=0)

    def _parts(self, text: str, base: int = 0):
        """(end, tokens) of each piece; a special string is one piece and one token."""
        at, count = 0, self.pieces
        for hit in self.special.finditer(text) if "<|" in text else ():
            for m in vocab.BYTE_LEVEL.finditer(text[at:hit.start()]):
                yield base + at + m.end(), count[m.group()]
            at = hit.end()
            yield base + at, 1
        rest = text[at:] if at else text
        for m in vocab.BYTE_LEVEL.finditer(rest):
            yield base + at + m.end(), count[m.group()]

    def _count_parts(self, text: str) -> int:
        return sum(n for _, n in self._parts(text))

    def chunk(self, text: str, base: int) -> tuple[list[int], list[int]]:
        """Piece ends (offsets in the whole text) and running token counts of one chunk."""
        ends, totals, total = [], [], 0
        for end, n in self._parts(text, base):
            total += n
            ends.append(end)
            totals.append(total)
        return ends, totals

    def whole(self, text: str) -> int:
        """Tokens of a text taken as one chunk.

        If no space is followed by white space, every space starts a piece, so the text can be
        counted word by word (each with the space before it).
        """
        if vocab.regex.search(r" \s", text):
            return self._count_parts(text)
        first, *others = text.split(" ")
        words = self.words
        return words[first] + sum([words[" " + w] for w in others])

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        if len(text) <= chunk_chars:
            return self.whole(text)
        done, total, start, length, back = 0, 0, 0, chunk_chars, overlap
        while True:
            # one chunk from ``start`` <= ``done``; ``done`` is a proven boundary of the text
            stop = min(len(text), start + length)
            ends, totals = self.chunk(text[start:stop], start)
            if start == done:
                before = 0
            else:
                i = bisect_left(ends, done)
                if i == len(ends) or ends[i] != done:      # not aligned: widen the overlap
                    back *= 2
                    start = max(done - back, 0) if back < done else done
                    if done - start > length // 2:
                        start = done
                    continue
                before = totals[i]
            if stop == len(text):
                return total + totals[-1] - before if ends else total
            last = bisect_left(ends, stop - self.margin + 1) - 1     # last stable piece
            if last < 0 or ends[last] <= done:             # a piece fills the chunk: lengthen it
                length *= 2
                continue
            # leave some stable pieces to the next chunk, so that both agree on a real overlap
            total += totals[last] - before
            done = ends[last]
            length, back = chunk_chars, overlap
            start = max(done - back, 0)


_COUNTERS: dict[str, ByteLevelCounter] = {}


def counter(name: str) -> ByteLevelCounter:
    if name not in _COUNTERS:
        _COUNTERS[name] = ByteLevelCounter(name)
    return _COUNTERS[name]


def n_tokens(text: Column, tokenizer: str = TOKENIZER, chunk_chars: int = CHUNK_CHARS,
             overlap: int = OVERLAP_CHARS) -> Column:
    """Token count of each text (null: 0)."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        c = counter(tokenizer)
        return pd.Series([c.count(t, chunk_chars, overlap) if t else 0 for t in texts], dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, limit: int = 1024, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); one row per row of ``docs``.

    Null or repeated doc_ids and further columns change nothing: rows are counted one by one.
    """
    text = text_of()
    return (docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                        n_tokens(text, tokenizer).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
