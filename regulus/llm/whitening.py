"""Whitening of embeddings from a singular value decomposition that is merged up a tree.

A block of rows is summed up by its count, its mean and the singular values and
vectors of what is left when the mean is taken away. Two such summaries are
merged without a loss: their vectors, each times its value, are stacked with one
row that corrects for the two means, and decomposed again. All dimensions are
kept, so the last summary has the covariance of all rows to double precision,
though no product of rows was ever summed. Tasks fold their blocks into one
summary each, and these meet a few at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.llm.common import cut

#: Entries are floor(SCALE * c); components; summaries that meet in one task.
SCALE, COMPONENTS, FAN = 256, 4, 8
#: Rows of a block, at least; a block has four times as many rows as dimensions at least.
BLOCK = 2048
LOW = (1 << 32) - 1


@dataclass
class Summary:
    """Rows in short: ``high`` and ``low`` are the exact sums of each dimension's upper and lower 32 bits."""

    n: int
    high: np.ndarray
    low: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        whole = x if x.dtype == np.int64 else np.zeros(x.shape, np.int64)
        rows = x.astype(float)
        mean = rows.mean(axis=0)
        values, vectors = np.linalg.svd(rows - mean, full_matrices=False)[1:]
        return cls(len(x), (whole >> 32).sum(axis=0), (whole & LOW).sum(axis=0), mean, values, vectors)

    def __add__(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = (self.n / n * other.n) ** 0.5 * (self.mean - other.mean)
        stacked = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, apart])
        values, vectors = np.linalg.svd(stacked, full_matrices=False)[1:]
        return Summary(n, self.high + other.high, self.low + other.low, self.mean + (other.mean - self.mean) * (other.n / n), values, vectors)

    def sums(self) -> list[int]:
        return [(int(h) << 32) + int(low) for h, low in zip(self.high, self.low)]

    def eigen(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues of the covariance, falling, and the unit vectors as rows; dimensions beyond the rank have value zero."""
        return self.values**2 / self.n, self.vectors


SCHEMA = "n long, high array<long>, low array<long>, mean array<double>, singular array<double>, vectors binary"


def written(s: Summary | None) -> pa.RecordBatch:
    held = [] if s is None else [s]
    columns = [pa.array([s.n for s in held], pa.int64()), *[pa.array([getattr(s, k) for s in held], pa.list_(pa.int64() if k in ("high", "low") else pa.float64())) for k in ("high", "low", "mean", "values")], pa.array([s.vectors.tobytes() for s in held], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["n", "high", "low", "mean", "singular", "vectors"])


def read(b: dict) -> Summary:
    mean = np.array(b["mean"], float)
    return Summary(b["n"], np.array(b["high"], np.int64), np.array(b["low"], np.int64), mean, np.array(b["singular"], float), np.frombuffer(b["vectors"], float).reshape(-1, len(mean)))


def folded(parts: Iterable[Summary]) -> Iterator[pa.RecordBatch]:
    held = None
    for s in parts:
        held = s if held is None else held + s
    yield written(held)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length and without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def blocks(batches: Iterable[pa.RecordBatch], rows: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[np.ndarray]:
    """The rows of many batches, some thousand at a time."""
    held: list[np.ndarray] = []
    n = 0
    for b in batches:
        if len(b):
            held.append(rows(b))
            n += len(b)
            if n >= max(BLOCK, 4 * held[0].shape[1]):
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def summary(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> Summary | None:
    """The summary of what ``of`` makes of batches of rows; none for no rows.

    What comes to the driver is one summary: it grows with the square of the
    dimensions and not with the rows.
    """

    def leaf(batches):
        return folded(map(Summary.of, blocks(batches, of)))

    def merge(batches):
        return folded(read(r) for b in batches for r in b.to_pylist())

    level = cut(rows.mapInArrow(leaf, SCHEMA))
    n = level.count()
    while n > 1:
        level = cut(level.repartition(-(-n // FAN)).mapInArrow(merge, SCHEMA))
        n = level.count()
    last = level.first()
    return read(last.asDict()) if last else None


def fixed(rows: DataFrame, vector: str, id_column: str) -> DataFrame:
    """``(id, x)`` of the rows with a usable vector: whole numbers, ``floor(SCALE * c)``."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(usable).select(F.col(id_column).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum of ``(n * x - S) ** 2`` over the dimensions; null where a long can't hold it."""
    most = max(int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0), 1)
    if most < 1 << 62 and most**2 * max(1, len(sums)) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, vector: str = "embedding", id_column: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Each usable row on the first principal components, scaled to unit variance; one output row for each row and component.

    Columns: id, ``component`` (from 1), ``n`` (distinct vectors, to which the
    components are fitted), ``deviation``, ``whitened``, ``explained`` and
    ``identity_error``. Rows whose vector is null or holds null, NaN or infinite
    entries are dropped. If vectors differ in length, those of the commonest
    length are used (the longer of two that are as common) and the others
    dropped as well. Repeated vectors are fitted once and come back as often as
    they are there; null ids stay null. A component without variance has null as
    ``whitened``, and no more components come back than there are dimensions. An
    entry too large for a long counts as the largest one, and a deviation too
    large for it is null. Other columns are not looked at. An empty table, or
    one without usable rows, gives an empty result.
    """
    spark = rows.sparkSession
    usable = fixed(rows, vector, id_column)
    kind = usable.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not lengths or not lengths["d"]:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    usable = usable.where(F.size("x") == lengths["d"])
    distinct = cut(usable.select("x").distinct())
    fit = summary(distinct, lambda b: matrix(b.column(0)))
    sums, n = fit.sums(), fit.n
    values, vectors = fit.eigen()
    trace = float(values.sum())
    some = min(components, lengths["d"])
    shown = np.zeros(some)
    shown[: len(values[:some])] = values[:some]
    full = int((shown > trace * 1e-14).sum())
    centre = np.array([s // n + (s % n) / n for s in sums])
    onto = (vectors[:full] / np.sqrt(shown[:full])[:, None]).T

    def projected(x: np.ndarray) -> np.ndarray:
        return (x - centre) @ onto

    error = 0.0
    if full:
        seen = summary(distinct, lambda b: projected(matrix(b.column(0))))
        spread = seen.vectors.T @ (seen.values[:, None] ** 2 * seen.vectors) / n
        error = float(np.abs(spread - np.eye(full)).max())
    explained = [float(e) / trace if k < full else 0.0 for k, e in enumerate(shown)]

    def each(batches):
        for b in batches:
            x = matrix(b.column(1)) if len(b) else np.zeros((0, len(sums)), np.int64)
            z, off = projected(x), deviations(x, n, sums)
            for k in range(some):
                column = pa.array(z[:, k]) if k < full else pa.nulls(len(b), pa.float64())
                same = lambda v, t: pa.array([v] * len(b), t)
                yield pa.RecordBatch.from_arrays([b.column(0), same(k + 1, pa.int32()), same(n, pa.int64()), pa.array(off, pa.int64()), column, same(explained[k], pa.float64()), same(error, pa.float64())], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(each, schema).withColumnRenamed("id", id_column)
