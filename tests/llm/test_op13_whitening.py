from fractions import Fraction

import numpy as np
import pytest

from recollect.llm import whitening as W
from recollect.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(rows):
    return [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def check(got, rows, k):
    """Rows of the operator against exact integers and numpy's eigenvectors."""
    good = usable(rows)
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in good])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for j in range(k):
        mine = np.array([by[i, j + 1][0].whitened for i, _ in good])
        want = centred @ axes[:, j] / np.sqrt(values[j])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7
    for (i, _), row in zip(good, x.tolist(), strict=True):
        r = by[i, 1][0]
        assert r.n == n and r.deviation == sum((n * a - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
        assert abs(r.explained - values[0] / np.trace(centred.T @ centred / n)) < 1e-9
        assert r.identity_error <= 1e-4


def test_data(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = QUERIES["op13_welford_whitening"](spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(got.collect(), [tuple(r) for r in df.select("vec_id", "embedding").collect()], 8)


@pytest.mark.parametrize("parts", [1, 40])
def test_odd_vectors(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=10) * np.arange(1, 11) + 50).tolist(), 1) for i in range(300)]
    rows += [(1000, None, 1), (1001, [None] * 10, 1), (1002, [float("nan")] + [1.0] * 9, 1), (1003, [float("inf")] * 10, 1), (1004, [1.0, None] * 5, 1)]
    odd = [(1005, [1.0] * 9, 1), (1006, [], 1), (1007, [1e12] * 10, 1)]
    got = W.components_long(spark.createDataFrame(rows + odd, SCHEMA).repartition(parts)).collect()
    check(got, rows, 8)


def test_many_lengths_and_states(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    rows = [(i, np.random.default_rng(i).normal(size=3 + i % 13 if i % 2 else 4).tolist(), 1) for i in range(400)]
    got = W.components_long(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect()
    check(got, [r for r in rows if len(r[1]) == 4], 4)


def test_repeats_rank_and_empty(spark):
    rows = [(None, [1.0, 2.0, 3.0], 1)] * 3 + [(2, [2.0, 4.0, 6.0], 1)] * 2
    got = W.components_long(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and {r.component for r in got} == {1} and {r.n for r in got} == {5} and abs(got[0].explained - 1) < 1e-12
    assert W.components_long(spark.createDataFrame([(1, [1.0, 2.0], 1)] * 4, SCHEMA)).count() == 0
    assert W.components_long(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    assert W.components_long(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i), 1.0], i) for i in range(9)], SCHEMA).selectExpr("*", "1 as whitened", "2 as deviation", "3 as n")
    out = W.whitened(df, W.fit(df))
    assert out.columns == ["vec_id", "embedding", "label", "whitened_in", "deviation_in", "n", "whitened", "deviation"] and out.count() == 9


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 130])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n)) * 10.0 ** rng.integers(-3, 4, size=n)
    for m in (a @ a.T, a + a.T, np.eye(n), np.zeros((n, n)), np.diag(np.arange(n, dtype=float))):
        values, axes = W.symmetric_qr(m)
        assert np.abs(axes.T @ axes - np.eye(n)).max() < 1e-12 * max(n, 10)
        assert np.abs(m @ axes - axes * values).max() <= 1e-12 * max(n, 10) * max(np.abs(m).max(), 1e-300) * n
        assert (np.diff(values) <= 0).all() and np.allclose(values, np.linalg.eigvalsh(m)[::-1], rtol=1e-9, atol=1e-9 * max(np.abs(m).max(), 1e-300))


def test_welford_is_exact_about_the_mean():
    rng = np.random.default_rng(0)
    x = rng.integers(99_000, 101_000, size=(5000, 4))
    one, parts = W.State.empty(4), W.State.empty(4)
    for at in range(0, 5000, 7):
        one.add(x[at : at + 7])
        part = W.State.empty(4)
        part.add(x[at : at + 7])
        parts = parts.merge(part)
    mean = [Fraction(int(s), 5000) for s in x.sum(axis=0)]
    want = float(sum((int(r[0]) - mean[0]) * (int(r[1]) - mean[1]) for r in x))
    assert one.squares[0, 1] == pytest.approx(want, rel=1e-11) and parts.squares[0, 1] == pytest.approx(want, rel=1e-11)
    assert one.sums == parts.sums == x.sum(axis=0).tolist()


def test_deviation_beyond_a_long_is_null():
    model = W.Whitener(10**12, [10**17], np.array([1e5]), np.eye(1), [1.0])
    assert model.deviation(np.array([[10**5], [10**5 + 10**6]])) == [0, None]
