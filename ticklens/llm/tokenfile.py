"""Token-id files in ORC (operator 7).

Documents are ordered by doc_id and a hash of the text with a range partitioning, encoded, closed with
an end id and written as ORC: the ids are an integer column in run-length encoding, stripes can be read in
parallel, the row index keeps doc_id ranges for every ``row_index_stride`` rows and a Bloom
filter on doc_id prunes point look-ups. Null texts are empty (only the end id); rows with a null
doc_id come first; repeated doc_ids are written one after the other, and their texts may go to several
files. The column ``position`` ascends over the rows of all files in the order of the token stream (with
gaps between files); the stream is the files in the order of their smallest position.

``read_tokens`` gives the rows back with ``start``, the number of ids before a row. The sum over
all earlier rows is a sum of file totals (one row per file) plus a running sum inside a file, so
no task sees more than one file's (position, n_tokens) pairs.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from ticklens.llm import vocab
from ticklens.llm.common import new_folder, text_of

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
ROW_INDEX_STRIDE = 2_000
#: words and pieces that a worker remembers
KNOWN_ENTRIES = 600_000

SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE_SPACE = re.compile(r"[^\S\x1c-\x1f]+")
#: first code point after the Latin blocks
LATIN_END = "\u0250"
#: letters and numbers (\p{L}, \p{N}) before LATIN_END that lower case leaves as they are
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: ``vocab.WORD_LEVEL`` for lower-case texts that hold nothing of BEYOND: no piece begins in two ways
LATIN_PIECES = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
BEYOND = re.compile(f"[\x1c-\x1f{LATIN_END}-\U0010ffff]")


class WordLevelEncoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` of word_bpe_49k.json gives them.

    The file's normaliser is NFC, white space to one space, lower case; neither it nor the pieces
    reach across white space. Special strings are cut out of the raw text first. A text within the
    Latin blocks is encoded piece by piece: words that differ in case or signs share their pieces, so
    fewer are unknown. Any other text goes word by word, and its words with code points beyond those
    blocks to the library whole, because Unicode versions disagree about some of those letters.
    """

    def __init__(self, name: str = TOKENIZER):
        self.tokenizer = vocab.load(name)
        self.ids = vocab.Pieces(self.tokenizer)
        self.known = vocab.Memo(self._word, KNOWN_ENTRIES)
        self.spelled = [struct.pack("<I", k) for k in range(self.tokenizer.get_vocab_size())]
        self.special = {t.content: np.array([k], dtype="<u4").tobytes()
                        for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = vocab.regex.compile("(" + "|".join(map(vocab.regex.escape, self.special)) + ")")

    def _piece(self, piece: str) -> bytes:
        spelled = self.spelled
        return b"".join([spelled[k] for k in self.ids(piece)])

    def _word(self, word: str) -> bytes:
        """Ids of a word or of one of its pieces."""
        if word.isascii() and word.isalpha():
            return self._piece(word.lower())
        if max(word) >= LATIN_END:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        pieces = vocab.WORD_LEVEL.findall(word.lower())
        if len(pieces) == 1:
            return self._piece(pieces[0])
        known = self.known
        return b"".join([known[p] for p in pieces])

    def _plain(self, text: str) -> bytes:
        known, lower = self.known, text.lower()
        if not BEYOND.search(text) and (text.isascii() or not BEYOND.search(lower)):
            return b"".join([known[p] for p in LATIN_PIECES.findall(lower)])
        # str.split() also splits at the four ASCII separators, which are no white space here
        parts = text.split() if not SEPARATORS.search(text) else filter(None, WHITE_SPACE.split(text))
        return b"".join([known[w] for w in parts])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(self.special.get(part) or self._plain(part) for part in self.cut.split(text))


_ENCODERS: dict[str, WordLevelEncoder] = {}


def encoder(name: str) -> WordLevelEncoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = WordLevelEncoder(name)
    return _ENCODERS[name]


def _encode_batches(tokenizer: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            rows = [enc.encode(t) + end if t else end for t in batch.column("text").to_pylist()]
            offsets = np.zeros(len(rows) + 1, dtype=np.int64)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            ids = pa.array(np.frombuffer(b"".join(rows), dtype="<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("position"), pa.array(np.diff(offsets)),
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids)],
                names=["doc_id", "position", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 row_index_stride: int = ROW_INDEX_STRIDE) -> None:
    """Encode ``docs`` (doc_id, text) into ORC files at ``path`` in ascending doc_id order.

    The texts are range partitioned and sorted before they are encoded, so that finding the
    ranges does not encode anything and the ids are never shuffled. The hash splits the rows of one
    doc_id; only equal rows stay together. Partitions are numbered in the order of their ranges.
    """
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = (docs.select("doc_id", text_of().alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
               .select("doc_id", F.monotonically_increasing_id().alias("position"), "text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, position bigint, n_tokens bigint, ids array<int>"
    (ordered.mapInArrow(_encode_batches(tokenizer, end_id), schema)
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.row.index.stride", str(row_index_stride)).option("orc.create.index", "true")
     .option("compression", "zstd").orc(path))


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf(LongType())
    def crc(lists: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.ascontiguousarray(x, dtype="<i4").tobytes()) for x in lists],
                         dtype="int64")

    return crc(ids)


def read_tokens(spark: SparkSession, path: str, doc_id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of the files at ``path``."""
    rows = (spark.read.schema(f"doc_id {doc_id_type}, position bigint, n_tokens bigint, ids array<int>").orc(path)
            .select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")))
    parts = rows.select("file", "doc_id", "position", "n_tokens", ids_crc32("ids").alias("ids_crc32"))
    totals = (spark.read.schema("position bigint, n_tokens bigint").orc(path)
              .select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "position", "n_tokens")
              .groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("position").alias("least")))
    # one row per file: the only window without a partition key
    in_order = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("file", F.coalesce(F.sum("total").over(in_order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return (parts.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(before, "file")
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def token_file(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID,
               path: str | None = None) -> DataFrame:
    """Write the token file of ``docs`` and return its rows as read back.

    An empty table gives an empty file and no rows. Further columns of ``docs`` are not used.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path, docs.schema["doc_id"].dataType.simpleString())
