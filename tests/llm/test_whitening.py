import numpy as np
import pytest

from fleetstream.llm import whitening
from fleetstream.llm.common import table
from tests.conftest import SF


def plain(vectors, k=4):
    """x vectors -> (n, deviations, eigenvalues, projections over sqrt(e), trace)"""
    x = np.array(vectors, dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x], e, (x - s / n) @ axes / np.sqrt(e), np.trace(v)


def check(rows, ids, vectors, k=4):
    n, deviation, e, projected, trace = plain(vectors, k)
    assert len(rows) == len(ids) * len(e)
    got = {(r.vec_id, r.component): r for r in rows}
    for c in range(len(e)):
        own = np.array([got[i, c + 1].whitened for i in ids])
        assert min(np.abs(own - projected[:, c]).max(), np.abs(own + projected[:, c]).max()) < 1e-8
    for i, d in zip(ids, deviation):
        assert got[i, 1].deviation == d and got[i, 1].n == n
    assert all(abs(got[ids[0], c + 1].explained * trace / e[c] - 1) < 1e-9 for c in range(len(e)))
    assert max(r.identity_error for r in rows) < 1e-9


def test_given_table(spark):
    rows = whitening.usable(table(spark, SF, "embeddings")).collect()
    check(whitening.whiten(table(spark, SF, "embeddings")).collect(), [r.vec_id for r in rows], [r.x for r in rows])


@pytest.mark.parametrize("d", [1, 3, 16, 17, 90])
def test_dimensions_and_flat_spectra(spark, d):
    rng = np.random.default_rng(d)
    vectors = rng.standard_normal((400, d)).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    check(whitening.whiten(df).collect(), list(range(400)), np.floor(256 * vectors).astype(int).tolist(), min(4, d))


def test_steep_spectrum(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((300, 40)) * np.geomspace(1000, 0.01, 40) + 500
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    check(whitening.whiten(df).collect(), list(range(300)), np.floor(256 * vectors).astype(int).tolist())


def test_residuals_are_certified(spark):
    found = whitening.fit(whitening.usable(table(spark, SF, "embeddings")))
    assert found.residuals.max() < 1e-13 * found.values[0] and 0 < found.passes < 200


def test_odd_rows(spark):
    good = [(1, [0.5, -0.25, 1.0]), (2, [0.0, -0.0, 0.75]), (2, [0.0, -0.0, 0.75]), (None, [1.5, 2.0, -3.0]), (4, [0.5, -0.25, 1.0]), (5, [9.0, 1.0, 2.0]), (6, [-7.0, 3.0, 1.0])]
    bad = [(10, None), (11, []), (12, [1.0, None, 2.0]), (13, [1.0, float("nan"), 2.0]), (14, [float("inf"), 1.0, 2.0]), (15, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, x string, n long"
    out = whitening.whiten(spark.createDataFrame([(*r, "x", 1) for r in good + bad], schema)).collect()
    assert sorted({r.vec_id for r in out if r.vec_id is not None}) == [1, 2, 4, 5, 6]
    assert len(out) == 7 * 3 and {r.n for r in out} == {5}
    by = lambda i: sorted((r.component, r.deviation, r.whitened) for r in out if r.vec_id == i)
    for a, b in zip(by(1) + by(2)[::2], by(4) + by(2)[1::2], strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-12
    x = [[int(np.floor(256 * c)) for c in v] for _, v in good]
    n, deviation, *_ = plain(x, 3)
    assert [d for _, d, _ in by(5)] == [deviation[5]] * 3


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], schema)).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)


def test_values_beyond_exact_doubles(spark):
    rows = [(i, [float(i) * 1e15, 1e300 if i == 3 else 1.0]) for i in range(6)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in out} == set(range(6)) and all(r.deviation is None for r in out if r.vec_id == 3)
