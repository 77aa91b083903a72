"""Whitening directions by blockwise QR and a bidiagonal qd solver (operator 12).

Entries become whole numbers, x = floor(1024 c) + 100000, so counts and sums are exact. One pass
sums them (a partial sum per batch); the next centres each row, (n x - S) / n with the numerator
exact, and reduces the rows of a task to a triangular factor, block after block, by QR; factors
are joined ``FAN_IN`` at a time by QR again, in groups on the cluster, until one is left. What
reaches the driver is that one factor, dimension squared in size whatever the table holds. Its
right singular vectors are the eigenvectors of the covariance, its squared singular values over n
the eigenvalues (``bidiagonal``); no cross-product matrix is ever formed. Two more passes measure
the whitened rows' covariance and write them.

Rows whose vector is null or holds null or non-finite entries are dropped. So are rows whose
vector is not of the commonest length (of equally common ones the longest), since they have no
covariance with the others; empty vectors count as such rows. Entries whose x does not fit a long
are held at its ends. A ``deviation`` beyond a long is null. Equal rows and repeated or null ids
are rows of their own. Directions without variance (eigenvalue at most ``FLAT`` of the largest)
have a null ``whitened`` and are left out of ``identity_error``, which is null if no direction is
left; ``explained`` is null if all rows are equal. An empty table gives an empty result. Further
columns, whatever their names, are ignored. A factor (dimension squared) and a batch of rows are
held in memory by a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.llm.bidiagonal import right_singular
from ticklens.llm.common import stored
from ticklens.llm.rpforest import matrices

COMPONENTS = 8
#: triangular factors joined by one task
FAN_IN = 32
#: rows that a task reduces at a time, at least the dimension
ROWS = 4096
#: eigenvalues up to this share of the largest count as zero
FLAT = 1e-18
_SAFE = float(1 << 62)


def _whole(batches):
    """Arrow batches of (vec_id, embedding) to (vec_id, dim, x): x as little-endian longs."""
    for batch in batches:
        places, dims, found = [], [], []
        for at, block in matrices(batch.column("embedding")):
            x = np.floor(block.astype(np.float64) * 1024) + 100000
            whole = np.where(np.abs(x) < _SAFE, x, 0).astype(np.int64)
            ends = np.iinfo(np.int64)
            whole = np.where(x >= _SAFE, ends.max, np.where(x <= -_SAFE, ends.min, whole))
            places += at.tolist()
            dims += [block.shape[1]] * len(at)
            found += [row.tobytes() for row in np.ascontiguousarray(whole)]
        order = np.argsort(np.asarray(places, dtype=np.int64), kind="stable")
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(np.asarray(places, dtype=np.int64)[order])),
             pa.array([dims[k] for k in order], pa.int32()), pa.array([found[k] for k in order], pa.binary())],
            names=["vec_id", "dim", "x"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def _blocks(batches, dim: int):
    """Batches cut into blocks of rows that fit in memory as matrices."""
    rows = max(1, ROWS * 64 // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, _matrix(part.column("x"), dim)


def _sums(dim: int):
    """Function for mapInArrow: exact sums per dimension, a row per batch and dimension."""
    def run(batches):
        for _, x in _blocks(batches, dim):
            if np.abs(x.astype(np.float64)).max(initial=0) * len(x) >= _SAFE:
                x = x.astype(object)
            total = [str(s) for s in x.sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total)], names=["pos", "s"])
    return run


class Centred:
    """Exact n x - S, and the centred rows (n x - S) / n in double precision."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.bound = max((abs(s) for s in sums), default=0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        most = np.abs(x.astype(np.float64)).max(initial=0)
        if self.n * most + self.bound < _SAFE:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
        y = self.scaled(x)
        if y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= _SAFE:
            total = (y.astype(object) ** 2).sum(axis=1)
            return [int(t) if t < 1 << 63 else None for t in total]
        return (y * y).sum(axis=1).tolist()


def _factors(centred: Centred, dim: int):
    """Function for mapInArrow: the triangular factor of a task's centred rows."""
    def run(batches):
        r = np.zeros((0, dim))
        for _, x in _blocks(batches, dim):
            r = np.linalg.qr(np.concatenate((r, centred.rows(x))), mode="r")
        if len(r):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.tobytes()], pa.binary())],
                                             names=["part", "r"])
    return run


def _joined(dim: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = np.concatenate([np.frombuffer(x).reshape(-1, dim) for x in rows.sort_values("part")["r"]])
        return pd.DataFrame({"part": [int(rows["part"].min()) // FAN_IN], "r": [np.linalg.qr(r, mode="r").tobytes()]})
    return run


def factor(rows: DataFrame, centred: Centred, dim: int) -> np.ndarray:
    """The (dim, dim) triangular factor of all centred rows, by a tree of QR steps."""
    parts = stored(rows.select("x").mapInArrow(_factors(centred, dim), "part int, r binary"), "factors")
    while (most := parts.agg(F.max("part")).first()[0]) is not None and most > 0:
        parts = stored(parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("group"))
                       .applyInPandas(_joined(dim), "part int, r binary"), "factors")
    r = np.zeros((dim, dim))
    for row in parts.collect():
        found = np.frombuffer(row["r"]).reshape(-1, dim)
        r[:len(found)] = found
    return r


def _products(centred: Centred, dim: int, directions: np.ndarray):
    """Function for mapInArrow: sums and cross products of the whitened rows of a batch."""
    k = directions.shape[1]

    def run(batches):
        for _, x in _blocks(batches, dim):
            w = centred.rows(x) @ directions
            full = np.concatenate((w.sum(axis=0)[None], w.T @ w))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(k + 1), k), pa.int32()), pa.array(np.tile(np.arange(k), k + 1), pa.int32()),
                 pa.array(full.ravel())], names=["i", "j", "total"])
    return run


def _written(centred: Centred, dim: int, directions: np.ndarray, flat: np.ndarray):
    """Function for mapInArrow: vec_id, component, deviation, whitened."""
    k = directions.shape[1]

    def run(batches):
        for part, x in _blocks(batches, dim):
            w = centred.rows(x) @ directions
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                 pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                 pa.array(np.repeat(np.array(centred.deviations(x), dtype=object), k).tolist(), pa.int64()),
                 pa.array(w.ravel(), pa.float64(), mask=np.tile(flat, len(x)))],
                names=["vec_id", "component", "deviation", "whitened"])
    return run


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; a row per row and component."""
    kind = table.schema["embedding"].dataType.elementType.simpleString()
    vectors = table.select("vec_id", "embedding" if kind == "float" else F.col("embedding").cast("array<double>").alias("embedding"))
    id_type = table.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    whole = stored(vectors.mapInArrow(_whole, f"vec_id {id_type}, dim int, x binary"), "whole-vectors")
    lengths = whole.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return table.sparkSession.createDataFrame([], schema)
    dim, n = lengths[0]["dim"], lengths[0]["n"]
    rows = whole.where(F.col("dim") == dim).select("vec_id", "x")
    totals = (rows.select("x").mapInArrow(_sums(dim), "pos int, s string")
              .groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    centred = Centred(n, [int(t["s"]) for t in sorted(totals, key=lambda t: t["pos"])])

    squares, vectors_k = right_singular(factor(rows, centred, dim), components)
    values = squares / n
    kept = min(components, dim)
    flat = values[:kept] <= FLAT * values[0]
    directions = vectors_k / np.sqrt(np.where(flat, 1.0, values[:kept]))
    trace = float(values.sum())
    error = None
    if not flat.all():
        sums = np.zeros((kept + 1, kept))
        for t in rows.select("x").mapInArrow(_products(centred, dim, directions), "i int, j int, total double") \
                .groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
            sums[t["i"], t["j"]] = t["total"]
        mean = sums[0] / n
        rest = sums[1:] / n - np.outer(mean, mean) - np.eye(kept)
        error = float(np.abs(rest[~flat][:, ~flat]).max())
    out = rows.mapInArrow(_written(centred, dim, directions, flat),
                          f"vec_id {id_type}, component int, deviation bigint, whitened double")
    share = F.array(*(F.lit(float(v) / trace if trace else None).cast("double") for v in values[:kept]))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(share, F.col("component") - 1).alias("explained"),
                      F.lit(error).cast("double").alias("identity_error"))
