"""Ranked lexical search over bit-sliced Bloom signatures (operator 13).

Index. Documents are gathered into blocks of at most ``BLOCK_ROWS`` rows whose signatures have
the same width, a power of two of at least ``BITS_PER_KEY`` bits per key. A document's keys are its
terms, and a term again for each number of ``LEVELS`` that its occurrences reach. Every key sets
``HASHES`` bits. A block is stored by bit, not by document: slice b is the bitmap of the
documents whose bit b is set. Beside the slices stand each document's length and the largest
number of occurrences of a term in it.

Search. The AND of a key's slices marks every document that holds it, and some that don't. The
highest marked level bounds a term's occurrences in a document, hence its part of the score; the
parts are summed per item to upper bounds, in the integers of the score itself. The documents of
highest bound per item, ``PROBES`` times as many as are ranked, are scored exactly from their whole
texts; the 50th exact score is what a document must reach. All documents whose bound reaches it are then scored exactly, however many
they are; the others are proven to rank lower. Ranks are taken from exact scores alone.

Items travel to the tasks in blocks of bounded size, one search per block; document counts and
lengths are taken over all documents. A false mark or a signature that is full (its width ends at
``WIDEST``) costs exact scores, never a result.

A null or empty text, or one without terms, is no document; such an item finds nothing. Rows that
repeat a doc_id, or share a null one, are documents of their own, each with its rank (null after
the others of its score); so are rows that repeat an item_id. Items with a null item_id are ranked
under a null. Equal scores are ordered by doc_id, then by the text's length and hash. An empty
table of documents or items gives an empty result. Further columns, whatever their names, are
ignored. Texts are taken whole; a task holds one text and the slices of one block in memory.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklens.llm.common import stored, text_of
from ticklens.llm.decontam import _item_blocks

#: documents ranked per item
TOP = 50
#: documents of highest bound per item whose exact scores give the score to reach, as a multiple of the ranks
PROBES = 4
BLOCK_ROWS = 512
BITS_PER_KEY = 12
HASHES = 5
#: numbers of occurrences from which a term has one more key
LEVELS = (1, 2, 3, 4, 5, 6, 8, 11, 16, 24, 40)
NARROWEST, WIDEST = 1 << 9, 1 << 22
#: cells of a block's bit matrix
CELLS = 1 << 25
ITEMS_PER_PASS = 2000

#: bytes of a term: digits, letters in lower case and everything beyond ASCII; the rest separates
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32
              for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order (bytes beyond ASCII never separate)."""
    return text.translate(_FOLD).split()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


_LEVEL_MARKS = np.arange(len(LEVELS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_LEVELS = np.array(LEVELS)


def keys_of(hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Hashes of all keys of a document from its terms' hashes and numbers of occurrences."""
    reached = np.searchsorted(_LEVELS, times, "right")
    first = np.cumsum(reached) - reached
    return leveled(np.repeat(hashes, reached), np.arange(reached.sum()) - np.repeat(first, reached))


def width_of(keys: int) -> int:
    """Bits of the signature of a document with that many keys."""
    return min(max(NARROWEST, 1 << (BITS_PER_KEY * keys - 1).bit_length()), WIDEST)


def slots(hashes: np.ndarray, width: int) -> np.ndarray:
    """(HASHES, keys): the bits of every 64-bit hash in a signature of ``width`` bits."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(width - 1) for k in range(HASHES)]).astype(np.int64)


def leveled(hashes: np.ndarray, level) -> np.ndarray:
    """Hashes of the keys "at least LEVELS[level] occurrences"; one level, or one for each hash."""
    x = hashes ^ _LEVEL_MARKS[level]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Block:
    """Documents of one signature width that wait to be written."""

    def __init__(self, width: int):
        self.width, self.rows = width, max(8, min(BLOCK_ROWS, CELLS // width // 8 * 8))
        self.ids, self.lengths, self.most, self.keys = [], [], [], []

    def add(self, doc_id, length: int, most: int, keys: np.ndarray) -> bool:
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.most.append(most)
        self.keys.append(keys)
        return len(self.ids) >= self.rows

    def written(self, id_type: pa.DataType) -> pa.RecordBatch:
        set_bits = np.zeros((-(-len(self.ids) // 8) * 8, self.width), dtype=bool)
        for k, keys in enumerate(self.keys):
            set_bits[k, slots(keys, self.width)] = True
        slices = np.ascontiguousarray(np.packbits(set_bits, axis=0, bitorder="little").T)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.ids], pa.list_(id_type)), pa.array([self.lengths], pa.list_(pa.int64())),
             pa.array([self.most], pa.list_(pa.int64())), pa.array([self.width], pa.int32()),
             pa.array([slices.tobytes()], pa.binary())], names=["ids", "lengths", "most", "width", "slices"])


def _indexed(batches):
    """Arrow batches of (doc_id, text) to blocks (ids, lengths, most, width, slices)."""
    open_blocks: dict[int, Block] = {}
    id_type = pa.int64()
    for batch in batches:
        id_type = batch.column("doc_id").type
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch)):
            words = terms_of(text)
            if not words:
                continue
            counts = Counter(words)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
            times = np.fromiter(counts.values(), np.int64, len(counts))
            keys = keys_of(hashes, times)
            width = width_of(len(keys))
            block = open_blocks.setdefault(width, Block(width))
            if block.add(doc_id, len(words), int(times.max()), keys):
                yield open_blocks.pop(width).written(id_type)
    for width in sorted(open_blocks):
        yield open_blocks[width].written(id_type)


def index(docs: DataFrame) -> DataFrame:
    """The bit-sliced index of ``docs`` (doc_id, text) as a written table of blocks."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text")).where("text <> ''")
    return stored(rows.mapInArrow(_indexed, f"ids array<{id_type}>, lengths array<bigint>, most array<bigint>, "
                                            "width int, slices binary"), "signatures")


class Items:
    """A block of items: their terms, each term's weight, and the corpus counts the score needs."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in rows]
        known: dict[bytes, int] = {}
        self.of = [np.array(sorted({known.setdefault(t, len(known)) for t in terms_of(text.encode())}), dtype=np.int64)
                   for _, text in rows]
        self.terms = known
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
        self.weights = np.zeros(len(known), dtype=np.int64)
        self.documents = self.length = 0

    def weighed(self, documents: int, length: int, df: dict[int, int]) -> Items:
        self.documents, self.length = documents, length
        found = np.array([df.get(t, 0) for t in range(len(self.terms))], dtype=np.float64)
        self.weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * found + 1))).astype(np.int64)
        return self

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        """20 m of documents by their number of terms."""
        return 20 * (50 + (50 * lengths * self.documents) // self.length)

    def scores(self, text: bytes, items: list[int]) -> list[int]:
        """Exact scores of a text for items (by position)."""
        words = terms_of(text)
        counts = Counter(t for w in words if (t := self.terms.get(w)) is not None)
        m20 = int(self.damping(np.array([len(words)], dtype=np.int64))[0])
        part = {t: int(self.weights[t]) * (1_000_000_000 * tf // (1000 * tf + m20)) for t, tf in counts.items()}
        return [sum(part.get(int(t), 0) for t in self.of[k]) for k in items]

    def bounds(self, lengths: np.ndarray, most: np.ndarray, width: int, slices: np.ndarray) -> np.ndarray:
        """(items, documents): upper bounds of the scores in a block."""
        rows = len(lengths)
        m20 = self.damping(lengths)
        part = np.zeros((len(self.terms), rows), dtype=np.int64)
        waiting = np.arange(len(self.terms))
        for level in range(len(LEVELS)):
            marks = slices[slots(leveled(self.hashes[waiting], level), width)]
            both = np.bitwise_and.reduce(marks, axis=0)
            some = both.any(axis=1)
            waiting, both = waiting[some], both[some]
            if not len(waiting):
                break
            held = np.unpackbits(both, axis=1, count=rows, bitorder="little").astype(bool)
            times = most if level == len(LEVELS) - 1 else np.minimum(most, LEVELS[level + 1] - 1)
            most_part = (1_000_000_000 * times) // (1000 * times + m20)
            # a level without the one below is a false mark
            seen = held if level == 0 else held & (part[waiting] > 0)
            part[waiting] = np.where(seen, self.weights[waiting][:, None] * most_part, part[waiting])
        return np.stack([part[of].sum(axis=0) for of in self.of])


def _frequencies(items: Items):
    """Function for mapInArrow: term, number of documents of a batch that hold it."""
    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for text in _texts(batch):
                found.update(t for w in set(terms_of(text)) if (t := items.terms.get(w)) is not None)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())],
                                             names=["term", "df"])
    return run


def _blocks_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            ids = batch.column("ids")[k].values
            width = batch.column("width")[k].as_py()
            slices = np.frombuffer(batch.column("slices")[k].as_buffer(), np.uint8).reshape(width, -1)
            yield (ids, batch.column("lengths")[k].values.to_numpy(), batch.column("most")[k].values.to_numpy(),
                   width, slices)


def _bounded(items: Items, reach: np.ndarray | None, top: int):
    """Function for mapInArrow: (doc_id, item, bound) of documents that may rank.

    Without ``reach`` the ``top`` highest bounds of a block per item; else all bounds of at least
    the item's ``reach``.
    """
    def run(batches):
        for ids, lengths, most, width, slices in _blocks_of(batches):
            bounds = items.bounds(lengths, most, width, slices)
            if reach is None:
                keep = min(top, bounds.shape[1])
                col = np.argpartition(bounds, bounds.shape[1] - keep, axis=1)[:, bounds.shape[1] - keep:]
                row = np.repeat(np.arange(len(bounds)), keep)
                col = col.ravel()
                some = bounds[row, col] > 0
                row, col = row[some], col[some]
            else:
                row, col = np.nonzero(bounds >= reach[:, None])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(col)), pa.array(row, pa.int32()), pa.array(bounds[row, col])],
                names=["doc_id", "item", "bound"])
    return run


def _scored(items: Items, id_type: str):
    """Function for mapInArrow over (doc_id, text, items): exact scores above 0."""
    def run(batches):
        for batch in batches:
            at, which, score, size, digest = [], [], [], [], []
            for k, (text, wanted) in enumerate(zip(_texts(batch), batch.column("items").to_pylist())):
                for item, value in zip(wanted, items.scores(text, wanted)):
                    if value > 0:
                        at.append(k)
                        which.append(item)
                        score.append(value)
                        size.append(len(text))
                        digest.append(xxhash.xxh3_64_intdigest(text) >> 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(which, pa.int32()), pa.array(score, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(digest, pa.int64())],
                names=["doc_id", "item", "score", "size", "digest"])
    return run


def _ranked(rows: DataFrame, by: list[Column], top: int) -> DataFrame:
    return (rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by)))
            .where(F.col("rank") <= top))


def _exact(rows: DataFrame, candidates: DataFrame, items: Items, name: str) -> DataFrame:
    """doc_id, item, score, size, digest of all rows whose doc_id is a candidate, as a written table."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    wanted = stored(candidates.groupBy("doc_id").agg(F.collect_set("item").alias("items"))
                    .withColumnRenamed("doc_id", "wanted_id"), f"{name}-candidates")
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["wanted_id"])).select("doc_id", "text", "items")
    return stored(texts.mapInArrow(_scored(items, id_type), f"doc_id {id_type}, item int, score bigint, size bigint, digest bigint"), name)


def _searched(rows: DataFrame, blocks: DataFrame, items: Items, top: int) -> DataFrame:
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item int, bound bigint"
    best = _ranked(blocks.mapInArrow(_bounded(items, None, PROBES * top), schema), [F.desc("bound"), F.asc_nulls_last("doc_id")],
                   PROBES * top)
    first = _exact(rows, best, items, "first-scores")
    lowest = (_ranked(first, [F.desc("score")], top).where(F.col("rank") == top).select("item", "score").collect())
    reach = np.ones(len(items.ids), dtype=np.int64)           # fewer than ``top`` scores: any bound above 0 may rank
    for r in lowest:
        reach[r["item"]] = r["score"]
    scores = _exact(rows, blocks.mapInArrow(_bounded(items, reach, top), schema), items, "scores")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("size"), F.asc("digest")]
    item_ids = F.array(*(F.lit(i).cast("long") for i in items.ids))
    return _ranked(scores, order, top).select(F.get(item_ids, F.col("item")).alias("item_id"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of highest score per row of ``items``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text")).where("text <> ''")
    empty = docs.sparkSession.createDataFrame([], f"item_id bigint, rank int, doc_id {id_type}, score bigint")
    n, parts = _item_blocks(items, per_pass)
    if n == 0:
        return empty
    blocks = index(docs)
    sizes = blocks.select(F.size("lengths").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")) \
        .agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    if not sizes["n"]:
        return empty
    passes = []
    for part in parts:
        known = Items(part)
        if not known.terms:
            continue
        df = rows.select("text").mapInArrow(_frequencies(known), "term bigint, df bigint").groupBy("term") \
            .agg(F.sum("df").alias("df")).collect()
        known.weighed(sizes["n"], sizes["l"], {r["term"]: r["df"] for r in df})
        found = _searched(rows, blocks, known, top)
        passes.append(found if n == 1 else stored(found, "ranked"))
    return reduce(DataFrame.unionAll, passes) if passes else empty
