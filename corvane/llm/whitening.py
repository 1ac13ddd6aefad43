"""Whitening of embeddings by a randomised range finder.

The covariance V of the distinct vectors is never needed whole at first: each pass over all centred rows multiplies it with a
thin orthonormal basis (the wanted components and OVERSAMPLE more), which is a power step, and Rayleigh-Ritz on the basis
gives components and their residuals. If those do not fall to double precision, the basis becomes the full dimension.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import materialize

COMPONENTS = 4
#: Columns of the random basis beyond the components.
OVERSAMPLE = 8
#: Power passes at most, before the basis becomes the full dimension.
PASSES = 6
#: A residual, as a share of the gap between eigenvalues, at which a component counts as exact to double precision.
PRECISION = 1e-12
#: Eigenvalues of at most this share of the trace are rounding: there is no such component.
LEAST = 1e-14
#: A vector's entries are kept as floor(SCALE * c).
SCALE = 256.0
SEED = 42


def lattice(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): entries as floor(256 * c) longs; rows whose vector is null or holds null or non-finite entries are dropped."""
    whole = F.transform(F.col(vector), lambda c: c.cast("double"))
    odd = F.exists(whole, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(whole, lambda c: F.floor(c * F.lit(SCALE)).cast("long"))
    return rows.where(F.col(vector).isNotNull() & ~odd).select("vec_id", scaled.alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(points: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """part(batch of vectors) summed over all batches: a small matrix, whose rows are summed in tasks of their own.

    The driver gets one matrix; kind is the numpy type of its entries.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(_matrix(batch.column("x")))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "row": pa.array([r.astype(kind).tobytes() for r in total], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist(), strict=True):
                one = np.frombuffer(row, kind)
                rows[i] = rows[i] + one if i in rows else one
        if rows:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(rows), pa.int32()), "row": pa.array([r.tobytes() for r in rows.values()], pa.binary())})

    found = points.mapInArrow(partial, "i int, row binary").repartition("i").mapInArrow(added, "i int, row binary").collect()
    return np.stack([np.frombuffer(r["row"], kind) for r in sorted(found, key=lambda r: r["i"])])


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the high and of the low 32 bits of each dimension: exact whatever the entries."""
    return np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])


class Components:
    """Of the fit list: n, exact sums, mean, trace; `vectors` (a column each) with falling eigenvalues `values`; `passes` over the rows."""

    def __init__(self, points: DataFrame, n: int, dimension: int, components: int = COMPONENTS):
        self.n = n
        high, low = _summed(points, _sums, "int64").astype(object)
        self.sums = [(h << 32) + lo for h, lo in zip(high, low, strict=True)]
        self.mean = mean = np.array([s / n for s in self.sums])
        self.passes, self.full = 1, False
        wanted = min(components, dimension)

        def multiplied(basis: np.ndarray) -> np.ndarray:
            """V times the basis, and below it the trace."""

            def part(x: np.ndarray) -> np.ndarray:
                centred = x - mean
                product = centred.T @ (centred @ basis)
                return np.vstack([product, np.full((1, basis.shape[1]), np.einsum("ij,ij->", centred, centred))])

            self.passes += 1
            return _summed(points, part, "float64") / n

        width = min(dimension, wanted + OVERSAMPLE)
        basis = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dimension, width)))[0]
        before = None
        for left in range(PASSES, -1, -1):
            product = multiplied(basis)
            self.trace, product = float(product[-1, 0]), product[:-1]
            if self._ritz(basis, product, wanted) or len(basis) == width:
                break
            worst = float((self.residuals / self.gaps).max())
            slow = before is not None and (worst >= before or math.log(PRECISION / worst) / math.log(worst / before) > left)
            if not left or slow:
                basis, width, self.full = np.eye(dimension), dimension, True
                product = multiplied(basis)[:-1]
                self._ritz(basis, product, wanted)
                break
            before, basis = worst, np.linalg.qr(product)[0]
        real = self.values > LEAST * max(self.trace, 0.0)
        self.values, self.vectors = self.values[real], self.vectors[:, real]
        self.identity_error = self._identity_error(points) if len(self.values) else 0.0

    def _ritz(self, basis: np.ndarray, product: np.ndarray, wanted: int) -> bool:
        """Rayleigh-Ritz on the basis; whether all components are exact to double precision."""
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = basis @ turn
        self.residuals = np.linalg.norm(product @ turn - vectors * values, axis=0)[:wanted]
        apart = np.abs(np.diff(values)) if len(values) > 1 else np.array([max(values[0], 1e-300)])
        gaps = np.minimum(np.append(apart, apart[-1]), np.append(apart[:1], apart))[:wanted]
        self.gaps = np.maximum(gaps, 1e-300)
        self.values, self.vectors = values[:wanted], vectors[:, :wanted] / np.linalg.norm(vectors[:, :wanted], axis=0)
        return bool((self.residuals <= PRECISION * self.gaps).all())

    @property
    def whitening(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def _identity_error(self, points: DataFrame) -> float:
        mean, whitening, k = self.mean, self.whitening, len(self.values)

        def part(x: np.ndarray) -> np.ndarray:
            y = (x - mean) @ whitening
            return np.vstack([y.T @ y, y.sum(0)])

        self.passes += 1
        total = _summed(points, part, "float64") / self.n
        return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each vector the sum over dimensions of (n*x - S)^2, exact; None where it is no long."""
    widest = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(abs(float(s)) for s in sums)
    if widest * widest * x.shape[1] < 2.0**62:
        off = x * n - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", off, off).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, vector) -> (vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Every distinct x vector counts once in the fit; repeated rows and equal vectors get equal values, null ids stay. Rows with a
    null vector, or with null or non-finite entries, are dropped; so are vectors that are empty or not of the most frequent
    length (on a tie the longer). Components without variance do not exist, so constant or single vectors, and empty tables,
    give no row. A deviation beyond a long is null. Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    points = lattice(rows, vector)
    length = F.size("x").alias("d")
    sizes = points.groupBy(length).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    points = points.where(F.size("x") == sizes["d"])
    fit = materialize(points.select("x").distinct(), "vectors")
    n = fit.count()
    model = Components(fit, n, sizes["d"], components)
    mean, whitening, sums, k = model.mean, model.whitening, model.sums, len(model.values)
    explained, error = (model.values / model.trace).tolist() if k else [], model.identity_error

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            x = _matrix(batch.column("x"))
            each = np.repeat(np.arange(m), k)
            columns = {
                "vec_id": batch.column("vec_id").take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, n, np.int64)),
                "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                "whitened": pa.array(((x - mean) @ whitening).ravel()),
                "explained": pa.array(np.tile(np.array(explained), m)),
                "identity_error": pa.array(np.full(m * k, error)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return points.mapInArrow(projected, schema)
