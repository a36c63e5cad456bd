"""Whitening of embeddings by Chan's merge of partial covariances.

Every partition of the distinct vectors gives its count, its exact sums and its scatter
about its own mean; pairs of these are merged by Chan's formula in a tree of tasks, so
no term is a difference of large numbers however far the data lie from zero. One
summary reaches the driver, which takes its eigenvectors. A second pass over the same
vectors sums up the whitened ones in the same way: their covariance must be the
identity, and how far it is from that is returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from .lattice import COMPONENTS_FIT, matrix, whole_vectors

OFFSET = 1_000_000
#: Vectors that a partition takes into its summary at once.
SLICE = 4096
LONG = 1 << 62
#: A component has variance if its eigenvalue is over this share of the largest one, times the dimensions.
RANK = 1e-12


class Summary:
    """Count, sums and centred scatter of some vectors; sums are whole numbers where the vectors are."""

    def __init__(self, n: int, total: list, scatter: np.ndarray):
        self.n, self.total, self.scatter = n, total, scatter

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        if x.dtype == np.int64:
            exact = x if float(np.abs(x).max(initial=0)) * len(x) < LONG else x.astype(object)
            total = [int(t) for t in exact.sum(axis=0)]
            about = np.array([t // len(x) for t in total], np.int64)
            rest = np.array([(t - int(a) * len(x)) / len(x) for t, a in zip(total, about, strict=True)])
            centred = (x - about).astype(float) - rest
        else:
            total = [float(t) for t in x.sum(axis=0)]
            centred = x - np.array(total) / len(x)
        return cls(len(x), total, centred.T @ centred)

    def merged(self, other: Summary) -> Summary:
        """Chan: the scatters, and the outer product of the means' difference weighted by n m / (n + m)."""
        n, m = self.n, other.n
        apart = np.array([(b * n - a * m) / (n * m) for a, b in zip(self.total, other.total, strict=True)], float)
        return Summary(n + m, [a + b for a, b in zip(self.total, other.total, strict=True)], self.scatter + other.scatter + np.outer(apart, apart) * (n / (n + m) * m))


def merge(a: Summary | None, b: Summary | None) -> Summary | None:
    return b if a is None else a if b is None else a.merged(b)


def summarised(rows: DataFrame, width: int, change: Callable[[np.ndarray], np.ndarray] | None = None) -> Summary | None:
    """The summary of all x of ``rows``: one for each partition, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = matrix(batch.column(0).slice(at, SLICE).to_pylist(), width) + OFFSET
                own = merge(own, Summary.of(x if change is None else change(x)))
        if own is not None:
            numbers = [str(t) for t in own.total] if change is None else [t.hex() for t in own.total]
            yield pa.record_batch([pa.array([own.n]), pa.array([numbers]), pa.array([own.scatter.tobytes()], pa.binary())], ["n", "total", "scatter"])

    def read(row) -> Summary:
        scatter = np.frombuffer(row.scatter)
        return Summary(row.n, [int(t) if change is None else float.fromhex(t) for t in row.total], scatter.reshape(math.isqrt(len(scatter)), -1))

    parts = rows.select("x").mapInArrow(run, "n long, total array<string>, scatter binary")
    return parts.rdd.map(read).treeReduce(merge) if not parts.isEmpty() else None


class Model:
    """Mean, components by falling eigenvalue, and the check of the second pass."""

    def __init__(self, found: Summary, most: int):
        self.n, self.total = found.n, found.total
        values, vectors = np.linalg.eigh(found.scatter / found.n)
        order = np.argsort(-values, kind="stable")[:most]
        self.values, self.axes = np.maximum(values[order], 0.0), vectors[:, order]
        trace = float(np.trace(found.scatter)) / found.n
        self.there = self.values > RANK * len(values) * max(float(values.max()), 0.0)
        self.explained = self.values / trace if trace > 0 else np.zeros(len(order))
        self.about = np.array([t // self.n for t in self.total], np.int64)
        self.rest = np.array([(t - int(a) * self.n) / self.n for t, a in zip(self.total, self.about, strict=True)])
        self.error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections on the components over the root of their eigenvalue; NaN where a component has no variance."""
        centred = (x - self.about).astype(float) - self.rest
        return (centred @ self.axes) / np.sqrt(np.where(self.there, self.values, np.nan))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S)^2, exact; None where one does not fit a long."""
        far = float(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.total), default=0)
        own = x * self.n - np.array(self.total, np.int64) if far < LONG else x.astype(object) * self.n - np.array(self.total, object)
        if own.dtype != object and float(np.abs(own).max(initial=0)) ** 2 * max(own.shape[1], 1) < LONG:
            return (own * own).sum(axis=1).tolist()
        sums = [sum(int(v) ** 2 for v in row) for row in own]
        return [s if s < 1 << 63 else None for s in sums]


def fit(vectors: DataFrame, width: int, most: int) -> Model | None:
    """The model of the distinct x of ``vectors``, verified by a second pass over them."""
    if not width:
        return None
    distinct = stored(spread(vectors.select("x").distinct()))
    found = summarised(distinct, width)
    if found is None:
        return None
    model = Model(found, most)
    there = np.flatnonzero(model.there)
    if len(there):
        check = summarised(distinct, width, lambda x: model.whitened(x)[:, there])
        model.error = float(np.abs(check.scatter / check.n - np.eye(len(there))).max())
    return model


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16) -> DataFrame:
    """One row per usable row of ``vectors`` and component, up to ``most``: id, component, n, deviation, whitened, explained and identity_error.

    x = floor(64 c) + 1000000 for every component c of a vector. The mean and the
    covariance (divisor n) are those of the n distinct x; components are its unit
    eigenvectors, from 1 by falling eigenvalue, with one sign for all rows. whitened is
    the centred x along the component over the root of its eigenvalue, explained the
    eigenvalue over the trace, deviation the sum of (n x - S)^2 as a whole number,
    identity_error the largest difference between the covariance of the whitened
    distinct vectors and the identity.

    Rows whose vector is null, holds a null or non-finite component, or has a squared
    length (in 64ths) of 2^104 or more are dropped. A shorter vector counts as filled up
    with components of 0. A component without variance (fewer distinct vectors than
    dimensions, constant dimensions) has a null whitened and does not count for
    identity_error; a deviation that does not fit a long is null. Repeated rows and null
    ids keep their rows. No rows, or none with a component, give no rows.
    """
    rows = stored(whole_vectors(vectors, id_col, vector_col, COMPONENTS_FIT).where("x is not null"))
    width = rows.agg(F.coalesce(F.max("width"), F.lit(0))).first()[0]
    model = fit(rows, width, most)
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = matrix(part.column(1).to_pylist(), width) + OFFSET
                white = model.whitened(x)
                rows, count = white.shape
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(np.arange(rows).repeat(count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * count, model.n)),
                        pa.array(model.deviations(x), pa.int64()).take(pa.array(np.arange(rows).repeat(count))),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(np.tile(model.explained, rows)),
                        pa.array(np.full(rows * count, model.error)),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("node", "x").mapInArrow(run, schema)
