"""Benchmark decontamination by size-partitioned MinHash containment search (operator 8).

Items are partitioned by the number of their shingles, class by class of doubling size. For a
class with items below U shingles, a document is a row of windows of 2U shingles that advance by
U, so any passage as long as an item lies inside one window, and the similarity of an item with
its window is bounded from below however long the document is: with three quarters of an item's
shingles present it is at least 0.17. A window is a candidate for the items with which it
shares one of ``HASHES`` minima (miss probability below 1e-5). Window minima are combined from the
minima of blocks of ``BLOCK`` shingles, computed once for all classes; items of fewer than ``BLOCK``
shingles have windows of one shingle, whose minimum is the shingle itself. Every candidate is
verified: it counts if at least ``PERCENT`` percent of the item's distinct shingles occur in the
document.

The benchmark is the stated query set. One of at most ``ITEMS_PER_PASS`` items and ``CHARS_PER_PASS``
characters is searched in one scan of the documents. A larger one is numbered in a written table and
searched block by block: driver and tasks hold one block, and the result of each pass is written
before the next block is read. No shuffle of documents in a pass, no pairs beyond the candidates. Items and documents without words match nothing, null
texts count as empty; items that repeat a text match side by side; rows with a null doc_id are
searched like others, further columns, whatever their names, are not looked at, and a text is searched whole,
however long. An empty table on either side gives no rows. An item of one to four words is one shingle of its whole sequence:
``contained_items`` and ``clean_documents`` find it only in documents of exactly these words; ``contained_short_items``
finds it wherever its words stand one after the other. ``all_contained_items`` takes that rule for short items and the
shingle rule for the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklens.llm import shingles
from ticklens.llm.common import ASCII_SPACE, stored, text_of

HASHES = 64
BLOCK = 8
PERCENT = 75
#: benchmark items, and characters of them, that are compared in one pass over the documents, at most (one
#: item that is longer has a pass of its own)
ITEMS_PER_PASS = 20_000
CHARS_PER_PASS = 40_000_000

_MULTIPLIERS = shingles.odd_multipliers(HASHES, seed=8)
HIT = "array<struct<item_id:bigint,n_item:bigint,n_shared:bigint>>"


@dataclass
class SizeClass:
    """Items of one size class: their minima per hash function, sorted, with the item of each."""

    span: int                      # blocks by which windows advance; 0: single shingles
    values: list[np.ndarray]
    owners: list[np.ndarray]
    filters: list[np.ndarray]      # bit per low 16 bits of a minimum


class ItemIndex:
    """Signatures and sets of a block of benchmark items, partitioned by size."""

    def __init__(self, items: list[tuple[int, str | None]]):
        sets = list(shingles.distinct_sets([text for _, text in items]))
        self.ids = [item_id for item_id, _ in items]
        self.sets = sets
        by_class: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            if len(s):
                span = 0 if len(s) < BLOCK else 1 << max(0, int(len(s)).bit_length() - BLOCK.bit_length() + 1)
                by_class.setdefault(span, []).append(k)
        self.classes = [self._class(span, members) for span, members in sorted(by_class.items())]

    def _class(self, span: int, members: list[int]) -> SizeClass:
        if span == 0:                       # a single shingle is its own minimum
            flat = np.concatenate([self.sets[k] for k in members])
            rows = [(flat, np.repeat(members, [len(self.sets[k]) for k in members]))]
        else:
            flat = np.concatenate([self.sets[k] for k in members])
            sizes = np.array([len(self.sets[k]) for k in members])
            least = shingles.minima(flat, np.cumsum(sizes) - sizes, _MULTIPLIERS)
            rows = [(row, np.array(members)) for row in least]
        values, owners, filters = [], [], []
        for row, owner in rows:
            order = np.argsort(row, kind="stable")
            values.append(row[order])
            owners.append(owner[order])
            seen = np.zeros(1 << 16, dtype=bool)
            seen[row & np.uint64(0xFFFF)] = True
            filters.append(seen)
        return SizeClass(span, values, owners, filters)

    def candidates(self, hashes: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) positions that share a minimum; ``hashes`` holds the documents' shingles."""
        found: set[tuple[int, int]] = set()
        some = np.flatnonzero(counts)
        if not len(some) or not self.classes:
            return found
        counts = counts[some]
        doc_of = np.repeat(some, counts)
        spans = [c for c in self.classes if c.span]
        for c in self.classes:
            if c.span == 0:
                self._look_up(c, 0, hashes, doc_of, found)
        if not spans:
            return found
        blocks = -(-counts // BLOCK)                      # blocks per document
        first_block = np.cumsum(blocks) - blocks
        starts = np.repeat(np.cumsum(counts) - counts, blocks) + BLOCK * shingles._within(blocks)
        steps = []
        for c in spans:
            groups = -(-blocks // c.span)
            at = np.repeat(first_block, groups) + c.span * shingles._within(groups)
            owner = np.repeat(some, groups)
            inner = np.flatnonzero(owner[1:] == owner[:-1])       # neighbours inside a document
            steps.append((c, at, owner, inner))
        product = np.empty_like(hashes)
        for i, a in enumerate(_MULTIPLIERS):
            np.multiply(hashes, a, out=product)
            least = np.minimum.reduceat(product, starts)
            for c, at, owner, inner in steps:
                half = np.minimum.reduceat(least, at)
                window = half.copy()
                window[inner] = np.minimum(half[inner], half[inner + 1])
                self._look_up(c, i, window, owner, found)
        return found

    @staticmethod
    def _look_up(c: SizeClass, i: int, minima: np.ndarray, owner: np.ndarray, found: set) -> None:
        maybe = np.flatnonzero(c.filters[i][minima & np.uint64(0xFFFF)])
        if not len(maybe):
            return
        wanted = minima[maybe]
        lo = np.searchsorted(c.values[i], wanted, "left")
        hi = np.searchsorted(c.values[i], wanted, "right")
        for k in np.flatnonzero(hi > lo):
            found.update((int(owner[maybe[k]]), int(item)) for item in c.owners[i][lo[k]:hi[k]])

    def hits(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Per text the verified (item_id, n_item, n_shared)."""
        out: list[list[tuple[int, int, int]]] = []
        for hashes, counts in shingles.shingle_blocks(texts):
            ends = np.cumsum(counts)
            rows: list[list[tuple[int, int, int]]] = [[] for _ in counts]
            for doc, item in sorted(self.candidates(hashes, counts)):
                wanted = self.sets[item]
                shared = int(np.isin(wanted, hashes[ends[doc] - counts[doc]:ends[doc]]).sum())
                if 100 * shared >= PERCENT * len(wanted):
                    rows[doc].append((self.ids[item], len(wanted), shared))
            out += rows
        return out


def _item_blocks(items: DataFrame, per_pass: int, chars: int = CHARS_PER_PASS):
    """Number of blocks, and an iterator over them as lists of (item_id, text)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where("text <> ''")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    if size["n"] <= per_pass and size["chars"] <= chars:
        return min(size["n"], 1), ([(r["item_id"], r["text"]) for r in part.collect()] for part in [rows][:size["n"]])
    # the number of a row is fixed once it is written; its high bits are its partition
    numbered = stored(rows.repartition(max(-(-size["n"] // per_pass), -(-size["chars"] // chars)))
                      .withColumn("row", F.monotonically_increasing_id())
                      .withColumn("part", F.shiftright("row", 33)), "benchmark")
    before = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    block = F.struct("part", F.floor(F.col("row").bitwiseAND((1 << 33) - 1) / per_pass).alias("turn"),
                     F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / chars).alias("share"))
    bounds = (numbered.select("row", "part", F.length("text").alias("n")).select("row", block.alias("block"))
              .groupBy("block").agg(F.min("row").alias("low"), F.max("row").alias("high")).orderBy("low").collect())
    return len(bounds), ([(r["item_id"], r["text"]) for r in
                          numbered.where(F.col("row").between(b["low"], b["high"])).collect()] for b in bounds)


def _searched(part: list[tuple[int, str]]):
    cache: dict[str, ItemIndex] = {}

    @F.pandas_udf(HIT)
    def search(texts: pd.Series) -> pd.Series:
        if "index" not in cache:
            cache["index"] = ItemIndex(part)
        rows = cache["index"].hits(list(texts))
        return pd.Series([[{"item_id": i, "n_item": n, "n_shared": m} for i, n, m in row] for row in rows],
                         dtype="object")

    return search


def contained_items(docs: DataFrame, items: DataFrame, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: one row per document and item it contains."""
    return _contained(docs, items, per_pass, _searched)


def _contained(docs: DataFrame, items: DataFrame, per_pass: int, searched) -> DataFrame:
    n, blocks = _item_blocks(items, per_pass)
    passes = []
    for part in blocks:
        found = docs.select("doc_id", F.explode(searched(part)(text_of())).alias("hit"))
        passes.append(found if n == 1 else stored(found, "contained-items"))
    if not passes:
        passes.append(docs.select("doc_id", F.explode(F.array().cast(HIT)).alias("hit")))
    found = reduce(DataFrame.unionAll, passes)
    return found.select("doc_id", "hit.item_id", "hit.n_item", "hit.n_shared",
                        (F.col("hit.n_shared") / F.col("hit.n_item")).alias("containment"))


def _short() -> Column:
    """Whether an item has one to four words."""
    words = F.filter(F.split(text_of(), f"{ASCII_SPACE}+"), lambda w: w != "")
    return F.size(words).between(1, shingles.WORDS - 1)


def _searched_short(part: list[tuple[int, str]]):
    cache: dict[int, tuple[np.ndarray, list[list[int]]]] = {}

    def index() -> dict:
        """Per number of words the sorted hashes of items and the items of each."""
        by_size: dict[int, dict[int, list[int]]] = {}
        for item_id, text in part:
            n = len(shingles.words_of(text))
            for value in next(shingles.distinct_sets([text], n)):
                by_size.setdefault(n, {}).setdefault(int(value), []).append(item_id)
        return {n: (np.array(sorted(found), dtype=np.uint64), [found[v] for v in sorted(found)])
                for n, found in by_size.items()}

    @F.pandas_udf(HIT)
    def search(texts: pd.Series) -> pd.Series:
        if not cache:
            cache.update(index())
        rows: list[list[dict]] = [[] for _ in range(len(texts))]
        for n, (values, owners) in cache.items():
            at = 0
            for hashes, counts in shingles.shingle_blocks(list(texts), n):
                ends = np.cumsum(counts)
                for k, (start, end) in enumerate(zip(ends - counts, ends)):
                    for v in np.flatnonzero(np.isin(values, hashes[start:end])):
                        rows[at + k] += [{"item_id": i, "n_item": 1, "n_shared": 1} for i in owners[v]]
                at += len(counts)
        return pd.Series(rows, dtype="object")

    return search


def contained_short_items(docs: DataFrame, items: DataFrame, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of ``contained_items`` for items of one to four words, found inside longer texts too."""
    return _contained(docs, items.where(_short()), per_pass, _searched_short)


def all_contained_items(docs: DataFrame, items: DataFrame, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """Short items by ``contained_short_items``, the others by ``contained_items``."""
    return contained_items(docs, items.where(~_short()), per_pass).unionByName(contained_short_items(docs, items, per_pass))


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def clean_documents(docs: DataFrame, items: DataFrame, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    n, blocks = _item_blocks(items, per_pass)
    if n == 0:
        return docs
    if n == 1:
        flag = _free("_contained_items", docs.columns)
        return docs.withColumn(flag, F.size(_searched(next(iter(blocks)))(text_of()))).where(F.col(flag) == 0).drop(flag)
    row = _free("_row", docs.columns)
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    passes = []
    for part in blocks:
        found = numbered.select(row, F.size(_searched(part)(text_of())).alias("hits")).where("hits > 0").select(row)
        passes.append(stored(found, "contaminated"))
    return numbered.join(reduce(DataFrame.unionAll, passes).distinct(), row, "left_anti").drop(row).select(*docs.columns)
