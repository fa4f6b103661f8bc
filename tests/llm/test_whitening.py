"""Whitening against numpy."""

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, index string, n string, uid string"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, "a", "b", "c") for i, v in enumerate(vectors)], SCHEMA)


def exact(vectors):
    """n, deviation, covariance and centred rows by whole numbers."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    return n, ((n * x - s) ** 2).sum(1), c.T @ c / n, c


@pytest.mark.parametrize(("rows", "columns"), [(8192, 128), (7, 5)])  # the second: many blocks each way, a last one of each that isn't full
def test_whitened_rows_equal_numpy(spark, monkeypatch, rows, columns):
    monkeypatch.setattr(whitening, "ROWS", rows)
    monkeypatch.setattr(whitening, "COLUMNS", columns)
    monkeypatch.setattr(whitening, "GROUPS", 3)
    r = np.random.default_rng(5)
    vectors = (r.normal(size=(90, 12)) * np.linspace(0.3, 4, 12) + 5).tolist()
    got = whitening.whitening_report(table(spark, vectors), most=9).toPandas().sort_values(["vec_id", "component"])
    n, deviation, v, c = exact(vectors)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:9], u[:, ::-1][:, :9]
    y = c @ u / np.sqrt(e)
    mine = got["whitened"].to_numpy().reshape(n, 9)
    sign = np.sign((mine * y).sum(0))
    assert np.abs(mine * sign - y).max() < 1e-9
    assert got["component"].tolist() == list(range(1, 10)) * n and set(got["n"]) == {n}
    assert got["deviation"].to_numpy().reshape(n, 9).T.tolist() == [deviation.tolist()] * 9
    assert np.allclose(got["explained"][:9], e / np.trace(v), rtol=1e-12)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10


def test_a_large_mean_costs_no_precision(spark):
    """With entries near 1e9, squares that aren't centred would lose all that matters."""
    r = np.random.default_rng(6)
    vectors = (1e9 + r.integers(-8, 8, size=(50, 4)) * 64.0).tolist()
    got = whitening.whitened_rows(table(spark, vectors)).toPandas().sort_values("vec_id")
    _, deviation, v, _ = exact(vectors)
    assert got["deviation"].tolist() == deviation.tolist()
    assert np.allclose(np.stack(got["explained"])[0], np.linalg.eigvalsh(v)[::-1] / np.trace(v), rtol=1e-9)
    assert got["identity_error"].iloc[0] < 1e-10


def test_odd_vectors(spark):
    good = [[1.0, 2.0, 0.5], [0.5, -1.0, 2.0], [2.0, 0.0, 1.0], [1.0, 1.0, -3.0], [1.0, 2.0, 0.5]]  # the last repeats the first
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0], [1e30, 0.0, 0.0], [1.0, 2.0]]
    got = whitening.whitening_report(table(spark, [*bad, *good])).toPandas()
    assert set(got["vec_id"]) == {7, 8, 9, 10, 11} and set(got["n"]) == {5} and got["component"].max() == 3
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(wide[0], wide[4])
    assert np.allclose(wide.T @ wide / 5, np.eye(3), atol=1e-10)
    held = spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert whitening.whitening_report(held).filter("vec_id is null").count() == 4


def test_no_variance_no_components(spark):
    assert whitening.whitening_report(table(spark, [])).collect() == []
    assert whitening.whitening_report(table(spark, [[1.0, 2.0]])).collect() == []
    assert whitening.whitening_report(table(spark, [[1.0, 2.0]] * 3)).collect() == []
    flat = whitening.whitening_report(table(spark, [[float(i), 2.0, -float(i)] for i in range(6)])).collect()  # one direction
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whitened_rows(table(spark, [[1e12, 0.0], [-1e12, 1.0], [0.0, 5.0]])).collect()
    assert [r["deviation"] for r in got if r["vec_id"] < 2] == [None, None]
    assert [r["n"] for r in got] == [3, 3, 3]
