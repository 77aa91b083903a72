"""Near-duplicate groups by b-bit MinHash (operator 3).

1. One pass over the texts computes each document's shingle set, a 128-bit digest of the set,
   ``PERMUTATIONS`` minima, band keys (hashes of ``ROWS`` minima) and the packed signature: the
   low ``BITS`` bits of every minimum, in 64-bit words.
2. Documents with equal sets form a class; the smallest doc_id stands for it, so thousands of
   copies cost one representative.
3. Band keys with at least two representatives are buckets. Instead of all pairs of a bucket,
   its members are first compared with few hubs of it. A candidate is estimated from the packed
   signatures by bit counts, corrected for chance agreement of b bits, and only if the estimate
   is within six standard errors of the threshold, confirmed on the full sets.
4. Confirmed links give components. A hub has met every other member and leaves its bucket; buckets
   whose other members lie in several components are taken again with other hubs (so buckets of up
   to five members end with two rounds). For what is still unsettled the members' shingles are ordered from rare
   to frequent; sets that reach the threshold share one of their rarest (prefix filter), and the
   places where they first meet bound their overlap (positional filter). All pairs of different
   components that pass are confirmed like the others. Both filters are exact, so every pair that
   shares a band is in one component already, was compared, or can't reach the threshold: no
   link is lost to a cap, and a large group of loose copies costs no pair for each two of them.

With 43 bands of 5 a pair at similarity 0.75 shares no band with probability 9e-6 (at 0.8: 4e-8);
one at similarity 0.4 shares one with probability 0.36.

Full sets are computed again from the texts of candidates alone. Before those texts are joined with the
candidates' doc_ids, a Bloom filter of the doc_ids (``FILTER_BITS`` at most) drops nearly all others
in the task that reads them, so they are never shuffled; what it lets through too much the join drops.

Texts without words are linked with nothing: component_id is their own doc_id. Rows are linked by
their texts, so a repeated doc_id is several rows, each with its own set; a row with a null doc_id
is linked like any other, but the component is named by its smallest non-null doc_id, and such a
row is kept only if its component has no doc_id at all. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklens.llm import shingles
from ticklens.llm.common import bounded_batches, stored, text_of
from ticklens.llm.components import components

BANDS, ROWS = 43, 5
PERMUTATIONS = BANDS * ROWS
BITS = 2
PER_WORD = 64 // BITS
WORDS = -(-PERMUTATIONS // PER_WORD)
#: similarity from which documents are linked, as 100 * intersection >= PERCENT * union
PERCENT = 75
#: rounds with two hubs per bucket before the remaining members are compared completely
HUB_ROUNDS = 2
#: bits of a filter of doc_ids, at most (8 MB): 16 for each of four million; more doc_ids let more texts through
FILTER_BITS = 1 << 26
#: bits of one page of the filter, as ``bitmap_construct_agg`` makes them
PAGE_BITS = 1 << 15

_MULTIPLIERS = shingles.odd_multipliers(PERMUTATIONS, seed=3)
_EVEN_BITS = 0x5555555555555555


def packed(low: np.ndarray) -> np.ndarray:
    """``low`` (permutations, documents) b-bit values as (WORDS, documents) 64-bit words."""
    words = np.zeros((WORDS, low.shape[1]), dtype=np.uint64)
    for i in range(low.shape[0]):
        words[i // PER_WORD] |= low[i] << np.uint64(BITS * (i % PER_WORD))
    return words


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(BANDS, documents): a 64-bit hash of the band's number and its minima."""
    keys = np.empty((BANDS, minima.shape[1]), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(minima.shape[1], band + 1, dtype=np.uint64)
        for row in minima[band * ROWS:(band + 1) * ROWS]:
            key = shingles.mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
        keys[band] = key
    return keys


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _signatures(batches):
    """Arrow batches of (doc_id, text) to (doc_id, n_shingles, digest, s0.., bands)."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        at = 0
        for hashes, counts in shingles.shingle_blocks(texts):
            ends = np.cumsum(counts)
            sets = [np.unique(hashes[s:e]) for s, e in zip(ends - counts, ends)]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            some = np.flatnonzero(sizes)
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1])).astype(np.int64) if len(some) else some
            flat = np.concatenate(sets) if len(some) else np.zeros(0, np.uint64)
            least = np.zeros((PERMUTATIONS, len(sets)), dtype=np.uint64)
            least[:, some] = shingles.minima(flat, starts, _MULTIPLIERS)
            high = least >> np.uint64(32)
            words = packed(high & np.uint64((1 << BITS) - 1))
            keys = np.ascontiguousarray(band_keys(high).T)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, len(sets)), pa.array(sizes), pa.array(digest, pa.binary()),
                 *(_signed(w) for w in words), pa.ListArray.from_arrays(offsets, _signed(keys.ravel()))],
                names=["doc_id", "n_shingles", "digest", *SIGNATURE, "bands"])
            at += len(sets)


SIGNATURE = [f"s{k}" for k in range(WORDS)]


def _sets(batches):
    """Arrow batches of (text) to (digest, hashes); a task passes a set on once."""
    passed: set[bytes] = set()
    for batch in batches:
        found = {}
        for s in shingles.distinct_sets(batch.column("text").to_pylist()):
            found.setdefault(xxhash.xxh3_128_digest(s.tobytes()), s)
        fresh = {digest: s for digest, s in found.items() if digest not in passed}
        passed.update(fresh)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in fresh.values()]))).astype(np.int32)
        flat = np.concatenate(list(fresh.values())) if fresh else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(fresh), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), _signed(flat))],
            names=["digest", "hashes"])


def agreeing(left: str, right: str) -> Column:
    """Number of the PERMUTATIONS b-bit values that agree, by bit counts over the packed words."""
    differing = F.lit(0)
    for name in SIGNATURE:
        x = F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}"))
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_EVEN_BITS))
        differing = differing + F.bit_count(either)
    return F.lit(PERMUTATIONS) - differing


def estimate(left: str, right: str) -> Column:
    """Jaccard estimate: agreement beyond the 2^-BITS that happens by chance."""
    chance = 1.0 / (1 << BITS)
    return (agreeing(left, right) / F.lit(float(PERMUTATIONS)) - F.lit(chance)) / F.lit(1.0 - chance)


def _estimate_floor() -> float:
    """The threshold less six standard errors of the estimate there."""
    chance = 1.0 / (1 << BITS)
    agree = PERCENT / 100 * (1 - chance) + chance
    return PERCENT / 100 - 6 * (agree * (1 - agree) / PERMUTATIONS) ** 0.5 / (1 - chance)


def _maybe_in(ends: DataFrame) -> Column:
    """Whether the column doc_id may be in ``ends`` (column end): true for all that are, and for few others."""
    bits, least = PAGE_BITS, 16 * ends.count()
    while bits < min(least, FILTER_BITS):
        bits *= 2

    def places(column: str) -> list[Column]:
        return [F.pmod(F.xxhash64(column, F.lit(k)), F.lit(bits)) for k in (1, 2)]

    place = F.col("place")
    pages = (ends.select(F.explode(F.array(*places("end"))).alias("place"))
             .groupBy(F.floor(place / PAGE_BITS).alias("page")).agg(F.bitmap_construct_agg(place % PAGE_BITS).alias("bitmap")))
    table = np.zeros((bits // PAGE_BITS, PAGE_BITS // 8), dtype=np.uint8)
    for page, bitmap in pages.collect():
        table[page] = np.frombuffer(bitmap, np.uint8)
    sent = ends.sparkSession.sparkContext.broadcast(table.ravel())

    @F.pandas_udf("boolean")
    def maybe(first: pd.Series, second: pd.Series) -> pd.Series:
        found = np.ones(len(first), dtype=np.uint8)
        for place in (first.to_numpy(), second.to_numpy()):
            found &= sent.value[place >> 3] >> (place & 7).astype(np.uint8)
        return pd.Series((found & 1).astype(bool))

    return maybe(*places("doc_id"))


def _sets_of(ends: DataFrame, rows: DataFrame) -> DataFrame:
    """(digest, hashes) of the documents whose doc_id is in ``ends`` (column end), as a written table."""
    ends = stored(ends, "ends")
    few = rows.where(_maybe_in(ends))
    # a shuffle between the two Python steps: a broadcast would put both, and so two workers, in one task
    ends = ends.hint("merge")
    texts = few.join(ends, few["doc_id"].eqNullSafe(ends["end"]), "left_semi").select("text")
    return stored(texts.mapInArrow(_sets, "digest binary, hashes array<bigint>"), "sets")


def _confirmed(pairs: DataFrame, reps: DataFrame, rows: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Of pairs of nodes (u, v) the links (u, v) between digests whose full sets reach the threshold.

    Only the texts of candidates are read again; sets meet their pairs by equi-joins.
    """
    sig = reps.groupBy("node", "digest", "rep").agg(*(F.min(s).alias(s) for s in SIGNATURE))
    close = (pairs.join(sig.alias("a"), F.col("u") == F.col("a.node")).join(sig.alias("b"), F.col("v") == F.col("b.node"))
             .where(estimate("a", "b") >= F.lit(_estimate_floor()))
             .select(F.col("a.digest").alias("u"), F.col("b.digest").alias("v"),
                     F.col("a.rep").alias("u_doc"), F.col("b.rep").alias("v_doc")))
    close = stored(close, "candidates")
    if sets is None:
        ends = close.select(F.col("u_doc").alias("end")).unionByName(close.select(F.col("v_doc").alias("end")))
        sets = _sets_of(ends.distinct(), rows)
    both = (close.join(sets.alias("a"), F.col("u") == F.col("a.digest"))
            .join(sets.alias("b"), F.col("v") == F.col("b.digest"))
            .select("u", "v", F.size(F.array_intersect("a.hashes", "b.hashes")).alias("common"),
                    (F.size("a.hashes") + F.size("b.hashes")).alias("sizes")))
    return stored(both.where(F.col("common") * 100 >= F.lit(PERCENT) * (F.col("sizes") - F.col("common")))
                  .select("u", "v").distinct(), "links")


def _with_hubs(members: DataFrame, turn: int) -> DataFrame:
    """``members`` (key, node and the member's component so far, part) beside two hubs of their bucket,
    which are chosen anew each turn, as a written table."""
    order = F.xxhash64("node", F.lit(turn))
    hubs = members.groupBy("key").agg(
        F.min_by("node", order).alias("lo"), F.min_by("part", order).alias("lo_part"),
        F.max_by("node", order).alias("hi"), F.max_by("part", order).alias("hi_part"))
    return stored(members.join(hubs, "key"), "buckets")


def _bucket_pairs(hubbed: DataFrame) -> DataFrame:
    """Pairs of bucket members with the hubs of the bucket, but for pairs inside a component."""
    ends = F.explode(F.array(F.struct(F.col("lo").alias("v"), F.col("lo_part").alias("v_part")),
                             F.struct(F.col("hi").alias("v"), F.col("hi_part").alias("v_part"))))
    return (hubbed.select("node", "part", ends.alias("hub")).where("part <> hub.v_part")
            .select(F.col("node").alias("u"), F.col("hub.v").alias("v")).distinct())


def _member_sets(members: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """The shingle sets of the members of unsettled buckets."""
    nodes = members.select("node").distinct()
    return _sets_of(reps.join(nodes, "node", "left_semi").select(F.col("rep").alias("end")).distinct(), rows)


def _rest_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of members in different components that may reach the threshold, by exact filters.

    With ``need`` = least overlap of two sets of n and m shingles (from PERCENT), sets ordered
    from rare to frequent must share one of their first n - PERCENT% n + 1 shingles; where they
    first meet, at places i and j, their overlap is at most 1 + min(n - i, m - j).
    """
    nodes = members.select("node", "part").distinct()
    # rows that repeat a document repeat its set: dense_rank counts a shingle once all the same
    words = (sets.select(F.xxhash64("digest").alias("node"), F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
             .join(nodes, "node"))
    seen = words.groupBy("h").agg(F.count("*").alias("df"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    ranked = words.join(seen, "h").withColumn(
        "i", F.dense_rank().over(Window.partitionBy("node", "part", "n").orderBy("df", "h")))
    # shingles of a single component join nothing, but they count as places
    prefix = stored(ranked.where((F.col("lo") != F.col("hi")) & (
        F.lit(100) * (F.col("n") - F.col("i") + 1) >= F.lit(PERCENT) * F.col("n")))
        .select("h", "node", "part", "n", "i"), "prefixes")
    sizes = prefix.groupBy("h", "part").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("h").agg(F.max_by("part", "k").alias("major"))
    others = prefix.join(largest, "h").where("part <> major").drop("major")
    reach = F.lit(1) + F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    both = F.col("a.n") + F.col("b.n")
    pairs = others.alias("a").join(prefix.alias("b"), "h").where(
        (F.col("a.part") != F.col("b.part")) & (F.lit(100 + PERCENT) * reach >= F.lit(PERCENT) * both))
    return pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def _placed(hubbed: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, node, part) of the members besides the hubs, part the member's component, as a written table.

    A node meets its component once for all its buckets (``BANDS`` at most).
    """
    nodes = hubbed.where("node <> lo and node <> hi").groupBy("node").agg(F.collect_list("key").alias("keys"))
    return stored(nodes.join(parts, "node", "left")
                  .select(F.explode("keys").alias("key"), "node", F.coalesce("part", "node").alias("part")), "placed")


def _unsettled(hubbed: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of the buckets that have more than one component besides their hubs, with each
    member's component. Hubs have met all members and are left out."""
    placed = _placed(hubbed, parts)
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    return stored(placed.join(mixed.select("key"), "key"), "buckets")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_of().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, n_shingles bigint, digest binary, "
              + ", ".join(f"{s} bigint" for s in SIGNATURE) + ", bands array<bigint>")
    signed = stored(rows.mapInArrow(_signatures, schema), "signatures")
    some = signed.where("n_shingles > 0")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = stored(some.join(classes, "digest").where(F.col("doc_id").eqNullSafe(F.col("rep")))
                  .select(F.xxhash64("digest").alias("node"), "digest", "rep", *SIGNATURE, "bands"), "representatives")

    buckets = reps.select(F.explode("bands").alias("key"), "node")
    shared = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    members = stored(buckets.join(shared.select("key"), "key").withColumn("part", F.col("node")), "buckets")
    hubbed = _with_hubs(members, 0)
    grouped = components(_confirmed(_bucket_pairs(hubbed), reps, rows))
    for turn in range(1, HUB_ROUNDS + 1):
        parts = grouped.select(F.xxhash64("node").alias("node"), F.xxhash64("component").alias("part"))
        members = _unsettled(hubbed, parts)
        if members.isEmpty():
            break
        if turn == 1:
            sets = _member_sets(members, reps, rows)     # later turns have fewer members, never others
        if turn < HUB_ROUNDS:
            hubbed = _with_hubs(members, turn)
            pairs = _bucket_pairs(hubbed)
        else:
            pairs = _rest_pairs(members, sets)
        more = _confirmed(pairs, reps, rows, sets)
        if not more.isEmpty():
            known = grouped.select(F.col("node").alias("u"), F.col("component").alias("v"))
            grouped = components(known.unionByName(more))

    named = (classes.join(grouped, classes["digest"] == grouped["node"], "left")
             .select("digest", "rep", F.coalesce("component", "digest").alias("component")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("digest", "component_id")
    lone = F.col("n_shingles") == 0
    result = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
