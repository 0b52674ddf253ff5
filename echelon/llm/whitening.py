"""Embedding whitening: eigenvectors in single precision, refined to double by matrix multiplications.

Spark computes what grows with the rows: the distinct vectors, their sums, and their covariance as a sum of products of
centred blocks. The covariance has the size of the dimension squared, whatever the number of rows. Its eigenvectors are found
in float32 and corrected by Ogita and Aishima's iteration, which needs nothing but products: with R = I - X'X and S = X'VX
it adds X E, where E holds (S + e R) / (differences of eigenvalues), and doubles the right digits in each step. Eigenvalues
that lie too close for that, by the error bound of the step, are a cluster: the step only makes their vectors orthogonal,
and a sub-solve of the shifted, projected matrix turns them within their space. The last steps run in extended precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from echelon.llm.common import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond plus or minus this (after scaling) are taken for it.
FARTHEST = float(2**50)
#: Most steps of the iteration in double precision, and in extended precision after them.
STEPS, LAST_STEPS = 8, 6


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Places of eigenvalues (any order) that are linked by differences of at most `near`, two or more of them."""
    order = np.argsort(values)
    ends = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [one for one in np.split(order, ends) if len(one) > 1]


def _step(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction of approximate eigenvectors: vectors, eigenvalues and the size of the correction."""
    size = len(matrix)
    rest = np.eye(size, dtype=matrix.dtype) - vectors.T @ vectors
    inner = vectors.T @ matrix @ vectors
    rest, inner = (rest + rest.T) / 2, (inner + inner.T) / 2
    values = np.diag(inner) / (1 - np.diag(rest))
    # Frobenius norms are upper bounds of the spectral ones
    off = inner - np.diag(values)
    near = 2 * (math.sqrt(float((off * off).sum())) + math.sqrt(float((matrix * matrix).sum())) * math.sqrt(float((rest * rest).sum())))
    near = max(near, float(np.finfo(matrix.dtype).eps) * size * float(np.abs(values).max()))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > near
    # half of `rest` and a part that is antisymmetric to the last digit, so that rounding can't spoil orthogonality
    change = rest / 2 + np.where(apart, (inner + (values[None, :] + values[:, None]) / 2 * rest) / np.where(apart, gaps, 1), 0)
    vectors = vectors + vectors @ change
    for cluster in _clusters(values, near):
        part = vectors[:, cluster]
        middle = values[cluster].mean()
        shifted = part.T @ (matrix @ part - middle * part)
        # the shift takes the common part away, so that double precision tells the rest apart
        largest = float(np.abs(shifted).max())
        if largest > 0:
            _, turn = np.linalg.eigh(((shifted + shifted.T) / (2 * largest)).astype(np.float64))
            vectors[:, cluster] = part @ turn.astype(matrix.dtype)
    return vectors, values, float(np.abs(change).max())


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns, to double precision.

    The largest entry of each vector is positive.
    """
    size = len(matrix)
    largest = float(np.abs(matrix).max()) if size else 0.0
    if largest == 0:
        return np.zeros(size), np.eye(size)
    scaled = matrix / largest
    scaled = (scaled + scaled.T) / 2
    _, single = np.linalg.eigh(scaled.astype(np.float32))
    vectors = single.astype(np.float64)
    before = math.inf
    for _ in range(STEPS):
        vectors, _, change = _step(scaled, vectors)
        if change < 1e-14 or change >= before and before < 1e-10:
            break
        before = change
    wide = vectors.astype(np.longdouble)
    for _ in range(LAST_STEPS):
        wide, _, change = _step(scaled.astype(np.longdouble), wide)
        if change < 1e-10:  # its square is what is left
            break
    wide = wide / np.sqrt((wide * wide).sum(axis=0))
    values = (wide * (scaled.astype(np.longdouble) @ wide)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    found = wide[:, order].astype(np.float64)
    sign = np.sign(found[np.abs(found).argmax(axis=0), np.arange(size)])
    return (values[order] * largest).astype(np.float64), found * sign


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has entries, all of them finite, with `x`: the vector on its grid of integers.

    The dimension is the one that most rows have (ties: the larger); rows of other dimensions are left out.
    """
    entries = F.col(vector).cast("array<double>")
    whole = F.coalesce(F.size(entries) > 0, F.lit(False)) & ~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf))
    x = F.transform(entries, lambda c: F.floor(F.greatest(F.least(SCALE * c, F.lit(FARTHEST)), F.lit(-FARTHEST))).cast("long") + SHIFT)
    kept = rows.where(whole).withColumn("x", x)
    common = kept.groupBy(F.size("x").alias("dimension")).count().orderBy(F.desc("count"), F.desc("dimension")).first()
    return kept.where(F.size("x") == (common["dimension"] if common else 0))


def _block(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: as integers of Python where 64 bits don't do."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(abs(int(one)) for one in sums) < 2**63:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _deviation(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exactly; null beyond 64 bits."""
    largest = max((abs(int(one)) for one in (centred.max(), centred.min())), default=0) if centred.size else 0
    if largest * largest * centred.shape[1] < 2**63:
        return (centred.astype(np.int64) ** 2).sum(axis=1).tolist()
    exact = (centred.astype(object) ** 2).sum(axis=1)
    return [int(one) if one < 2**63 else None for one in exact]


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number and sums of the vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                total = _block(batch.column("x")).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64()), pa.array([total], pa.list_(pa.int64()))], ["n", "total"])

    parts = fit.select("x").mapInArrow(add, "n bigint, total array<bigint>")
    # sums as decimals: they may need more than 64 bits
    totals = parts.select("n", F.posexplode("total").alias("place", "part")).groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
    found = totals.orderBy("place").collect()  # a row for each dimension
    return (int(found[0]["n"]) if found else 0), np.array([int(one["total"]) for one in found], object)


def _products(fit: DataFrame, n: int, sums: np.ndarray, turn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and mean products of the centred vectors (projected by `turn`), summed in blocks, then over the tasks."""
    width = len(sums) if turn is None else turn.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, seen = np.zeros((width, width)), np.zeros(width), False
        for batch in batches:
            if len(batch):
                centred = (_centred(_block(batch.column("x")), n, sums) / n).astype(np.float64)
                centred = centred if turn is None else centred @ turn
                total += centred.T @ centred
                mean += centred.sum(axis=0)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array([*total, mean], pa.list_(pa.float64()))], ["i", "products"])

    parts = fit.select("x").mapInArrow(multiply, "i bigint, products array<double>")
    summed = parts.select("i", F.posexplode("products").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    found = summed.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "value"))), lambda one: one["value"]).alias("row")).orderBy("i").collect()
    whole = np.array([one["row"] for one in found]).reshape(width + 1, width) / n
    return whole[:width], whole[width]


def whitened(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors count by x = floor(64 c) + 1000000. Mean, covariance and components are those of the distinct x vectors, n of
    them; `deviation` is the squared distance of n x from their sum, exactly (null where 64 bits don't hold it). Components
    are numbered from 1 by falling eigenvalue. A component without variance (within rounding) has no whitened value: null,
    and `explained` 0, or null where nothing varies at all. `identity_error` is the largest entry by which the covariance of
    the whitened distinct vectors, computed from them, differs from the identity. Rows with null vectors, empty ones, ones
    with null or non-finite entries, or of another length than most are left out. Null ids and repeated rows stay; other columns aren't
    read. Without usable rows there are no rows.
    """
    kind = rows.select(id).schema[0].dataType
    plain = usable(rows.select(F.col(id).alias("id"), F.col(vector).alias("vector")), "vector").select("id", "x")
    fit = stored(plain.select("x").distinct(), "vectors")
    n, sums = _sums(fit)
    out = f"id {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not n:
        return plain.where("false").mapInArrow(lambda batches: iter(()), out).withColumnRenamed("id", id)
    covariance, _ = _products(fit, n, sums)
    values, vectors = eigenvectors(covariance)
    trace = float(np.trace(covariance))
    many = min(components, len(values))
    varied = values[:many] > len(values) * np.finfo(np.float64).eps * max(values[0], 0)
    turn = np.where(varied, vectors[:, :many] / np.sqrt(np.where(varied, values[:many], 1)), 0)
    explained = [float(max(one, 0) / trace) if trace > 0 else None for one in values[:many]]
    error = None
    if varied.any():
        products, mean = _products(fit, n, sums, turn[:, varied])
        error = float(np.abs(products - np.outer(mean, mean) - np.eye(int(varied.sum()))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = len(batch)
            if not count:
                continue
            centred = _centred(_block(batch.column("x")), n, sums)
            value = pa.array(((centred / n).astype(np.float64) @ turn).ravel(), mask=np.tile(~varied, count))
            columns = [
                batch.column("id").take(pa.array(np.repeat(np.arange(count), many))),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), count)),
                pa.array(np.full(count * many, n, np.int64)),
                pa.array(_deviation(centred), pa.int64()).take(pa.array(np.repeat(np.arange(count), many))),
                value,
                pa.array(explained * count, pa.float64()),
                pa.array([error] * (count * many), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return plain.mapInArrow(project, out).withColumnRenamed("id", id)
