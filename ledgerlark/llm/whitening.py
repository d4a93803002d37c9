"""Whiten embeddings: rows on the principal components of their covariance, each of variance one.

Entries are made whole numbers, so the distinct vectors, their number and their sums per
dimension are exact. RowMatrix sums the products of the centred rows, the driver takes
the eigenvectors of that one small matrix, and tasks project rows by its broadcast columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored

#: Steps of one, what is added to them, and components that are returned.
STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond this are no exact long as a double times STEPS.
LARGEST = 2.0**52
#: Rows of vectors that a task widens at a time.
ROWS = 2048


def whole(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with _x, its entries as whole numbers, without rows that cannot be used.

    Those are null vectors, empty ones, ones that hold null, an infinite or no number, or an
    entry of 2**52 or more, and vectors of another length than most have (the longer of two as frequent).
    """
    entries = F.col(vector)
    usable = entries.isNotNull() & (F.size(entries) > 0) & F.forall(entries, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))  # NaN counts as larger
    rows = vectors.where(F.coalesce(usable, F.lit(False)))
    common = rows.groupBy(F.size(entries).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size(entries) == (common["size"] if common else 0))
    return rows.withColumn("_x", F.transform(entries, lambda c: F.floor(c.cast("double") * STEPS) + SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each dimension of the rows read: their number and their sum."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("_x"))
            n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_pydict({"dim": np.arange(len(total)), "n": np.full(len(total), n), "s": total})


def _gramian(rows: DataFrame, columns: int) -> np.ndarray:
    """The sums of the products of the entries of v, as RowMatrix makes them: partial sums in a tree, never a row on the driver."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    found = RowMatrix(vectors, 0, columns).computeGramianMatrix().toArray()
    return (found + found.T) / 2


class Fit:
    """Number and sums of the distinct rows, and the projection onto their components."""

    def __init__(self, distinct: DataFrame, components: int = COMPONENTS):
        sums = distinct.select("_x").mapInArrow(_sums, "dim long, n long, s long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38, 0)")).alias("s"))
        found = sums.orderBy("dim").collect()  # a row for each dimension
        self.n, self.sums = int(found[0]["n"]), [int(r["s"]) for r in found]
        self._centre = np.array([s // self.n for s in self.sums], np.int64)  # x - S/n = (x - centre) - rest/n, with both parts exact
        self._rest = np.array([s % self.n for s in self.sums], np.int64)
        self.axes, self.explained, self.identity_error = np.zeros((len(found), 0)), np.zeros(0), 0.0
        covariance = _gramian(self._over(distinct, lambda x: self.centred(x)), len(found)) / self.n
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = min(components, int((values > max(values[0], 0) * len(found) * np.finfo(float).eps * 16).sum()))
        if not kept:
            return
        values, vectors = values[:kept], vectors[:, :kept]
        vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)  # the largest entry is positive
        self.axes, self.explained = vectors / np.sqrt(values), values / np.trace(covariance)
        white = self._over(distinct, self.whitened)
        means = white.select(*(F.avg(F.col("v")[i]) for i in range(kept))).first()
        centred = _gramian(white.select(F.transform("v", lambda c, i: c - F.element_at(F.array(*map(F.lit, means)), i + 1)).alias("v")), kept)
        self.identity_error = float(np.abs(centred / self.n - np.eye(kept)).max())

    @staticmethod
    def _over(rows: DataFrame, f) -> DataFrame:
        """v: f of the rows' whole numbers, in tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    out = f(_matrix(batch.column("_x")))
                    offsets = pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["v"])

        return rows.select("_x").mapInArrow(run, "v array<double>")

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, each entry rounded once or twice at its own size, not at that of x."""
        return (x - self._centre) - self._rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n*x - S)**2, exact; None where it is no long."""
        off = x - self._centre
        far = max(int(off.max(initial=0)), -int(off.min(initial=0))) + 1
        if (self.n * far) ** 2 * x.shape[1] < 1 << 63:
            return ((off * self.n - self._rest) ** 2).sum(axis=1)
        exact = (sum((a * self.n - b) ** 2 for a, b in zip(row, self._rest.tolist(), strict=True)) for row in off.tolist())
        return np.array([d if d < 1 << 63 else None for d in exact], object)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row for each usable row and component.

    Rows that `whole` leaves out have no result. Repeated vectors are fitted once and each
    row of them is returned; ids may be null or repeated. A deviation beyond a long is null. Components of no variance are left
    out, so a table of one distinct vector, or an empty one, has no result. Eigenvalues that
    tie have any orthogonal vectors, the same for all rows. Other columns are not read.
    """
    id_type = vectors.schema[vec_id].dataType
    rows = whole(vectors.select(F.col(vec_id).cast("string").alias("_id"), F.col(vector).alias("embedding"))).select("_id", "_x")  # pandas would make numbers beside null floats
    distinct = stored(rows.select("_x").distinct())
    fit = vectors.sparkSession.sparkContext.broadcast(None if distinct.isEmpty() else Fit(distinct, components))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = fit.value
        kept = of.axes.shape[1] if of else 0
        for frame in frames:
            for i in range(0, len(frame) if kept else 0, ROWS):
                part = frame.iloc[i : i + ROWS]
                x = np.stack(part["_x"].to_numpy())
                yield pd.DataFrame({
                    "_id": part["_id"].repeat(kept).to_numpy(), "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x)), "n": of.n, "deviation": of.deviation(x).repeat(kept),
                    "whitened": of.whitened(x).ravel(), "explained": np.tile(of.explained, len(x)), "identity_error": of.identity_error,
                })

    found = rows.mapInPandas(run, "_id string, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return found.select(F.col("_id").cast(id_type).alias(vec_id), *found.columns[1:])


def op11(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
