"""Near-duplicate vectors by a random-projection tree forest with spill overlap (operator 11).

1. Rows with equal vectors form a class (a group-by, combined before the shuffle); everything
   below runs on classes and counts a class by its number of rows.
2. The forest is fitted on the ``SAMPLE`` classes of smallest digest, a random sample of a stated
   bound. A tree splits at the median of a random projection, again and again; what lies within
   ``MARGIN / sqrt(dimension)`` of the split goes to both sides (spill). A split that separates
   next to nothing, because the margin holds most of a dense cluster, is left out. Every class is
   then put into its leaves of all trees.
3. Members of a leaf are compared in double precision. A large leaf is dealt into blocks and every
   pair of blocks is a group, so no group exceeds two blocks. A pair that meets in several leaves
   counts in its first common leaf only: each member carries its leaves, so links are counted
   without sending pairs anywhere. A group returns, per member, the number of links and the root
   of its local union.
4. Roots are joined to components by star contraction.

Dense groups. Vectors within half the threshold's angle of one pivot are all linked with each
other. Pivots of balls that hold at least ``CORE_SHARE`` of the sample are found on the sample;
the members of such a core count each other at once, exactly and without a comparison, however
many they are. Rows outside a core that could reach a member, by the angle to its pivot, are
compared with its members, in blocks again. This way a group that holds a third of all rows costs
work in proportion to its rows.

At cosine 0.9 exactly, in 64 dimensions, a split separates a pair with probability 0.067, so
``TREES`` trees of seven levels miss it with probability 0.003, and of fourteen levels with 0.06;
at 0.95 the figures are below 0.0001 and 0.003.

A vector that is null, empty or zero or holds null or non-finite components is linked with
nothing: its component_id is its own vec_id. Vectors of different lengths are not compared. Rows
are linked by their vectors, so a repeated vec_id is several rows; a row with a null vec_id is
linked like any other, but the component is named by its smallest non-null vec_id, and such a row
is kept only if its component has none at all. An empty table gives an empty result. Further
columns, whatever their names, are ignored. A vector is held in memory by the tasks that compare
it; its length has no bound otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import stored
from ticklens.llm.components import components

#: cosine from which vectors are linked
COSINE = 0.9
TREES = 6
#: classes on which trees and cores are fitted
SAMPLE = 16384
#: members of a leaf that the trees aim at, and of a block of a larger leaf
LEAF = 2048
BLOCK = 2048
#: sampled members below which a node is not split any more
LEAST = 8
#: levels of a tree, and half the overlap of a split times the root of the dimension
LEVELS = 40
MARGIN = 0.12
#: a split must leave at most this share of a node on either side, else it is left out
SHRINK = 0.8
SKIPS = 4
#: share of the sample (and number of sampled rows) from which a ball is a core
CORE_SHARE = 1 / 512
CORE_LEAST = 16
CORE_ROWS = 8192
SEED = 11

_HALF = np.arccos(COSINE) / 2
#: within this cosine of a pivot all are linked; beyond the second nobody reaches a member
_INSIDE = np.cos(_HALF) + 1e-9
_REACH = np.cos(3 * _HALF) - 1e-9


def matrices(column: pa.ListArray):
    """(positions, matrix in double precision) per length, of the vectors that have only finite components."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    present = column.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    for length in np.unique(lengths[present]):
        at = np.flatnonzero(present & (lengths == length))
        block = values[offsets[at][:, None] + np.arange(length)]
        fine = np.isfinite(block.astype(np.float64)).all(axis=1)
        if fine.any():
            yield at[fine], block[fine]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision (rows are not zero)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _digests(batches):
    """Arrow batches of (vec_id, embedding) to (vec_id, digest, dim, vec); the last three null if not comparable."""
    for batch in batches:
        n = batch.num_rows
        digest, dim, vec = [None] * n, [None] * n, [None] * n
        for at, block in matrices(batch.column("embedding")):
            some = np.abs(block).max(axis=1) > 0
            for k, row in zip(at[some], np.ascontiguousarray(block[some])):
                vec[k] = row.tobytes()
                dim[k] = len(row)
                digest[k] = xxhash.xxh3_128_digest(vec[k])
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(digest, pa.binary()), pa.array(dim, pa.int32()), pa.array(vec, pa.binary())],
            names=["vec_id", "digest", "dim", "vec"])


def by_dimension(dims, vectors, dtype: str):
    """(positions, unit rows) per dimension of binary vectors."""
    dims = np.asarray(dims)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, unit(np.frombuffer(b"".join(vectors[k] for k in at), dtype).reshape(len(at), dim))


def directions(tree: int, dim: int) -> np.ndarray:
    """(dim, LEVELS): a unit direction for every level of a tree."""
    r = np.random.default_rng([SEED, tree, dim]).standard_normal((dim, LEVELS))
    return r / np.sqrt((r * r).sum(axis=0))


class Forest:
    """Trees over unit vectors; a node is (level, threshold, left, right), a leaf its number."""

    def __init__(self, sample: list[tuple[int, np.ndarray, np.ndarray]], n_sample: int, n_all: int,
                 leaf: int = LEAF, trees: int = TREES):
        self.leaves = 0
        self.trees = []
        margin = np.zeros(n_sample)
        for dim, at, _ in sample:
            margin[at] = MARGIN / np.sqrt(dim)
        for tree in range(trees):
            at_level = np.zeros((n_sample, LEVELS))
            for dim, at, x in sample:
                at_level[at] = x @ directions(tree, dim)
            enough = max(LEAST, int(leaf * n_sample / max(n_all, 1)))
            self.trees.append(self._grown(at_level, margin, np.arange(n_sample), 0, enough))

    def _grown(self, at_level: np.ndarray, margin: np.ndarray, rows: np.ndarray, level: int, enough: int):
        last = min(level + SKIPS, LEVELS)
        while len(rows) > enough and level < last:
            where = at_level[rows, level]
            cut = float(np.median(where))
            left, right = rows[where <= cut + margin[rows]], rows[where > cut - margin[rows]]
            if max(len(left), len(right)) <= SHRINK * len(rows):
                return (level, cut, self._grown(at_level, margin, left, level + 1, enough),
                        self._grown(at_level, margin, right, level + 1, enough))
            level += 1
        self.leaves += 1
        return self.leaves - 1

    def places(self, dim: int, x: np.ndarray) -> list[list[int]]:
        """Leaves of every row, ascending."""
        margin = MARGIN / np.sqrt(dim)
        found: list[list[int]] = [[] for _ in range(len(x))]
        for tree, root in enumerate(self.trees):
            at_level = x @ directions(tree, dim)
            waiting = [(root, np.arange(len(x)))]
            while waiting:
                node, rows = waiting.pop()
                if not len(rows):
                    continue
                if isinstance(node, int):
                    for k in rows:
                        found[k].append(node)
                    continue
                level, cut, left, right = node
                where = at_level[rows, level]
                waiting.append((left, rows[where <= cut + margin]))
                waiting.append((right, rows[where > cut - margin]))
        return [sorted(f) for f in found]


def cores(sample: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """(dim, pivot) of balls whose members are all linked, largest first per dimension."""
    pivots = []
    for dim, _, x in sample:
        x = x[:CORE_ROWS]
        least = max(CORE_LEAST, CORE_SHARE * len(x))
        if len(x) < least:
            continue
        inside = np.concatenate([x[s:s + 1024] @ x.T >= _INSIDE for s in range(0, len(x), 1024)])
        free = np.ones(len(x), dtype=bool)
        counts = inside.sum(axis=1)
        while counts.max() >= least:
            pivot = int(counts.argmax())
            pivots.append((dim, x[pivot]))
            taken = inside[pivot] & free
            free &= ~taken
            counts -= inside[:, taken].sum(axis=1)
    return pivots


def placed_in(forest: Forest, pivots: list[tuple[int, np.ndarray]], dtype: str):
    """Function for mapInArrow: classes with their core, the cores they may reach and their leaves."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            vectors = batch.column("vec").to_pylist()
            core = np.full(n, -1, dtype=np.int32)
            halo: list[list[int]] = [[] for _ in range(n)]
            leaves: list[list[int]] = [[] for _ in range(n)]
            for dim, at, x in by_dimension(batch.column("dim").to_numpy(), vectors, dtype):
                own = [k for k, (d, _) in enumerate(pivots) if d == dim]
                if own:
                    near = x @ np.stack([pivots[k][1] for k in own]).T
                    first = (near >= _INSIDE).argmax(axis=1)
                    inside = near[np.arange(len(x)), first] >= _INSIDE
                    core[at] = np.where(inside, np.asarray(own)[first], -1)
                    reach = near >= _REACH
                    for r in np.flatnonzero(reach.any(axis=1)):
                        mine = core[at[r]]
                        halo[at[r]] = [own[c] for c in np.flatnonzero(reach[r]) if mine < 0 or own[c] < mine]
                single = core[at] < 0
                for k, found in zip(at[single], forest.places(dim, x[single])):
                    leaves[k] = found
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("w"), batch.column("dim"), batch.column("vec"), pa.array(core),
                 pa.array(halo, pa.list_(pa.int32())), pa.array(leaves, pa.list_(pa.int32()))],
                names=["digest", "w", "dim", "vec", "core", "halo", "leaves"])
    return run


PLACED = "digest binary, w bigint, dim int, vec binary, core int, halo array<int>, leaves array<int>"


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from every one of n positions over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _met_before(leaves, gid: int, rows: np.ndarray) -> np.ndarray:
    """(rows, earlier leaves) indicator of the leaves before ``gid`` that hold the rows."""
    lists = [leaves[k][leaves[k] < gid] for k in rows]
    known = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int32)
    found = np.zeros((len(rows), len(known)), dtype=np.float32)
    for k, ids in enumerate(lists):
        found[k, np.searchsorted(known, ids)] = 1
    return found


def linked(x: np.ndarray, left: np.ndarray, right: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of the pairs of ``left`` x ``right`` that reach the threshold; ``once``: a < b."""
    found = []
    for s in range(0, len(left), 512):
        part = left[s:s + 512]
        r, c = np.nonzero(x[part] @ x[right].T >= COSINE)
        a, b = part[r], right[c]
        found.append((a[a < b], b[a < b]) if once else (a, b))
    return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def compared(dtype: str):
    """Function for applyInPandas: links and local root of the members of a group that have links."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        x = unit(np.frombuffer(b"".join(rows["vec"]), dtype).reshape(len(rows), int(first["dim"])))
        side = rows["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = first["kind"] == 0 and first["i"] == first["j"]
        a, b = linked(x, left, left if alone else right, alone)
        if first["kind"] == 0 and len(a):
            leaves = [np.asarray(v) for v in rows["leaves"]]
            ends = np.unique(np.concatenate((a, b)))
            met = _met_before(leaves, int(first["gid"]), ends)
            at = np.zeros(len(rows), dtype=int)
            at[ends] = np.arange(len(ends))
            new = np.concatenate([np.einsum("ij,ij->i", met[at[a[s:s + 65536]]], met[at[b[s:s + 65536]]]) == 0
                                  for s in range(0, len(a), 65536)])
            a, b = a[new], b[new]
        weight = rows["w"].to_numpy().astype(np.float64)
        links = np.bincount(a, weight[b], len(rows)) + np.bincount(b, weight[a], len(rows))
        root = local_roots(len(rows), a, b)
        some = np.flatnonzero(links > 0)
        digests = rows["digest"].to_numpy()
        return pd.DataFrame({"digest": digests[some], "links": links[some].astype(np.int64), "root": digests[root[some]]})
    return run


def _groups(placed: DataFrame) -> DataFrame:
    """Members of the groups to compare: kind (0 leaf, 1 core), gid, dim, blocks i and j, side, and the class."""
    own = ["digest", "w", "vec", "leaves"]
    leaf = placed.select("dim", F.explode("leaves").alias("gid"), "digest")
    leaf_n = leaf.groupBy("gid", "dim").agg(F.count("*").alias("n")).where("n > 1")
    core_n = placed.where("core >= 0").groupBy(F.col("core").alias("gid")).agg(F.count("*").alias("n"))
    halo_n = placed.select(F.explode("halo").alias("gid")).groupBy("gid").agg(F.count("*").alias("m"))
    sizes = stored(leaf_n, "leaf-sizes")
    pairs = stored(core_n.join(halo_n, "gid"), "core-sizes")

    def blocks(n):
        return F.ceil(F.col(n) / BLOCK).cast("int")

    def block(of):
        return F.pmod(F.xxhash64("digest", "gid"), of).cast("int")

    def others(of):
        return F.explode(F.sequence(F.lit(0), of - 1))

    leaves = (placed.withColumn("gid", F.explode("leaves")).join(sizes, ["gid", "dim"])
              .withColumn("b", block(blocks("n"))).withColumn("o", others(blocks("n")))
              .select(F.lit(0).alias("kind"), "gid", "dim", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"),
                      (F.col("b") > F.col("o")).cast("int").alias("side"), *own))
    members = (placed.withColumn("gid", F.col("core")).join(pairs, "gid")
               .select(F.lit(1).alias("kind"), "gid", "dim", block(blocks("n")).alias("i"),
                       others(blocks("m")).alias("j"), F.lit(0).alias("side"), *own))
    around = (placed.withColumn("gid", F.explode("halo")).join(pairs, "gid")
              .select(F.lit(1).alias("kind"), "gid", "dim", others(blocks("n")).alias("i"),
                      block(blocks("m")).alias("j"), F.lit(1).alias("side"), *own))
    return leaves.unionByName(members).unionByName(around)


def near_vectors(table: DataFrame, leaf: int = LEAF, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of ``table`` (vec_id, embedding)."""
    kind = table.schema["embedding"].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    vectors = table.select("vec_id", "embedding" if kind == "float" else F.col("embedding").cast("array<double>").alias("embedding"))
    id_type = table.schema["vec_id"].dataType.simpleString()
    rows = stored(vectors.mapInArrow(_digests, f"vec_id {id_type}, digest binary, dim int, vec binary"), "vectors")
    classes = stored(rows.where("digest is not null").groupBy("digest", "dim").agg(
        F.count("*").alias("w"), F.min("vec_id").alias("rep"), F.min("vec").alias("vec")), "classes")

    n = classes.count()
    fitted = classes.orderBy("digest").limit(sample).select("dim", "vec").toPandas()
    parts = list(by_dimension(fitted["dim"].to_numpy(), list(fitted["vec"]), dtype))
    pivots = cores(parts)
    core_dims = {dim: np.stack([p for d, p in pivots if d == dim]) for dim in {d for d, _ in pivots}}
    single = [(dim, x[(x @ core_dims[dim].T < _INSIDE).all(axis=1)] if dim in core_dims else x) for dim, _, x in parts]
    ends = np.cumsum([0] + [len(x) for _, x in single])
    singles = [(dim, np.arange(ends[k], ends[k + 1]), x) for k, (dim, x) in enumerate(single)]
    share = ends[-1] / max(len(fitted), 1)
    forest = Forest(singles, int(ends[-1]), int(n * share), leaf, trees)
    placed = stored(classes.select("digest", "w", "dim", "vec").mapInArrow(placed_in(forest, pivots, dtype), PLACED), "placed")

    found = stored(_groups(placed).groupBy("kind", "gid", "dim", "i", "j")
                   .applyInPandas(compared(dtype), "digest binary, links bigint, root binary"), "links")
    dense = placed.where("core >= 0").groupBy("core").agg(F.sum("w").alias("total"), F.min("digest").alias("root"))
    in_core = placed.select("digest", "w", "core").join(dense, "core", "left")
    counts = (in_core.select("digest", (F.coalesce("total", "w") - 1).alias("links"))
              .unionByName(found.select("digest", "links")).groupBy("digest").agg(F.sum("links").alias("n_links")))
    edges = (in_core.where("core >= 0").select(F.col("digest").alias("u"), F.col("root").alias("v"))
             .unionByName(found.select(F.col("digest").alias("u"), F.col("root").alias("v"))))
    grouped = components(edges)

    named = (classes.select("digest", "rep").join(grouped, classes["digest"] == grouped["node"], "left")
             .select("digest", "rep", F.coalesce("component", "digest").alias("component")))
    # written, so that the join has a shuffle of its own, which can be split where a component is large
    least = stored(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component-ids")
    known = named.join(least, "component").join(counts, "digest").select("digest", "component_id", "n_links")
    result = rows.select("vec_id", "digest").join(known, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
