import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echelon.llm import whitening
from tests.llm.conftest import CLASHING


def by_hand(rows):
    """Grid vectors of the usable rows, and mean and covariance of the distinct ones in integers."""
    kept = [(id, [math.floor(64 * c) + 1_000_000 for c in one]) for id, one in rows if one and all(c is not None and math.isfinite(c) for c in one)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(column) for column in zip(*fit, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], object)
    covariance = (centred.T @ centred).astype(object)
    return kept, n, sums, np.array([[float(int(v) / n**3) for v in row] for row in covariance])


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def vectors(seed, n, size):
    numbers = np.random.default_rng(seed)
    mix = numbers.normal(size=(size, size))
    return [(i, [float(np.float32(c)) for c in one]) for i, one in enumerate(numbers.normal(size=(n, size)) @ mix)]


def test_whitening_equals_direct_computation(spark):
    rows = vectors(1, 300, 20)
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (400, None), (401, []), (402, [math.nan] * 20), (403, [None] + [0.0] * 19), (404, [math.inf] + [0.0] * 19)]
    got = whitening.whitened(table(spark, rows).repartition(3)).collect()
    kept, n, sums, covariance = by_hand(rows)
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    assert len(got) == 16 * len(kept) and {row.n for row in got} == {n} == {300}
    deviations = {id: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for id, x in kept}
    xs = dict(kept)
    signs = {}
    for row in got:
        assert row.deviation == deviations[row.vec_id]
        k = row.component - 1
        assert math.isclose(row.explained, values[k] / values.sum(), rel_tol=1e-12)
        want = float((np.array(xs[row.vec_id]) - np.array(sums) / n) @ vectors_[:, k] / math.sqrt(values[k]))
        if abs(want) > 1e-3:
            assert signs.setdefault(k, math.copysign(1, want * row.whitened)) * row.whitened == pytest.approx(want, rel=1e-8, abs=1e-10)
    assert {row.identity_error for row in got} == {got[0].identity_error} and got[0].identity_error < 1e-12


@pytest.mark.parametrize("gap", [0.0, 1e-14, 1e-9, 1e-6])
def test_clustered_eigenvalues(gap):
    """Eigenvalues closer than single precision tells apart, equal ones and ones of zero."""
    numbers = np.random.default_rng(5)
    basis, _ = np.linalg.qr(numbers.normal(size=(24, 24)))
    values = np.array([5, 5 * (1 + gap), 5 * (1 + 2 * gap), 3, 1, 1 + gap, *np.linspace(0.5, 0.1, 15), 1e-9, 0, 0])
    matrix = basis @ np.diag(values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    found, vectors_ = whitening.eigenvectors(matrix)
    assert np.allclose(found, np.sort(values)[::-1], atol=1e-14)
    assert np.abs(vectors_.T @ vectors_ - np.eye(24)).max() < 1e-14
    assert np.abs(matrix @ vectors_ - vectors_ * found).max() < 4e-15
    _, single = np.linalg.eigh(matrix.astype(np.float32))
    assert np.abs(matrix @ single - single * np.diag(single.T @ matrix @ single)).max() > 1e-8


def test_close_eigenvectors_are_told_apart():
    basis, _ = np.linalg.qr(np.random.default_rng(6).normal(size=(12, 12)))
    values = np.array([2, 2 - 1e-7, *np.linspace(1, 0.1, 10)])
    matrix = basis @ np.diag(values) @ basis.T
    _, vectors_ = whitening.eigenvectors((matrix + matrix.T) / 2)
    assert np.abs(np.abs(np.diag(vectors_.T @ basis)) - 1).max() < 1e-12
    assert np.abs(np.abs(vectors_.T @ basis) - np.eye(12)).max() < 2e-8


def test_vectors_without_variance(spark):
    rows = [(1, [0.5, 1.0, 2.0]), (2, [0.75, 1.0, 2.0]), (3, [0.5, 1.0, 2.0])]
    got = whitening.whitened(table(spark, rows)).orderBy("vec_id", "component").collect()
    assert [row.component for row in got] == [1, 2, 3] * 3 and {row.n for row in got} == {2}
    assert [row.explained for row in got[:3]] == [1.0, 0.0, 0.0]
    assert abs(got[0].whitened) == 1 and got[1].whitened is None and got[2].whitened is None
    same = whitening.whitened(table(spark, rows[:1])).collect()
    assert [(row.deviation, row.whitened, row.explained, row.identity_error) for row in same] == [(0, None, None, None)] * 3


def test_other_lengths_large_entries_and_no_rows(spark):
    rows = [(i, one) for i, one in vectors(3, 30, 4)] + [(90, [1.0, 2.0]), (91, [1.0] * 7), (92, [3e38, 0.0, 0.0, 0.0])]
    got = whitening.whitened(table(spark, rows)).collect()
    assert {row.vec_id for row in got} == {*range(30), 92}
    assert {row.deviation is None for row in got if row.vec_id == 92} == {True}
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).collect() == []
    clashing = table(spark, rows[:30]).withColumns({name: F.lit("taken") for name in (*CLASHING, "x", "n", "component", "i")})
    plain = {(row.vec_id, row.component): row.whitened for row in whitening.whitened(table(spark, rows[:30])).collect()}
    assert all(plain[row.vec_id, row.component] == pytest.approx(row.whitened, abs=1e-9) for row in whitening.whitened(clashing).collect())


def test_refinement_of_random_matrices():
    numbers = random.Random(8)
    for size in (1, 2, 3, 40):
        root = np.random.default_rng(numbers.randrange(10**9)).normal(size=(size, size + 2))
        matrix = root @ root.T
        values, vectors_ = whitening.eigenvectors(matrix)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], rtol=1e-12)
        assert np.abs(matrix @ vectors_ - vectors_ * values).max() < 2e-15 * np.abs(matrix).max() * max(4, size)
