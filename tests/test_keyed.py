"""Matrices by key and models solved where they are."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.operators import folds as Cv
from bandwright.operators import moments as M
from bandwright.operators import solvers as So


def rows(spark, keys, n, d=5, seed=1, parts=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x @ np.arange(1, d + 1) + rng.normal(size=n)
    k = keys(rng, n)
    data = [(i, k[i], float(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(data, "id long, k string, y double, x array<double>").repartition(parts), x, y, np.asarray(k, dtype=object)


def test_hot_key_and_null_key(spark, monkeypatch):
    """One key with most rows, a null key, keys of one row; tasks that pass partial sums on after every batch."""
    monkeypatch.setattr(M, "HELD_BYTES", 1)
    df, x, y, k = rows(spark, lambda rng, n: ["hot" if r < 0.7 else None if r < 0.75 else f"k{int(r * 400)}" for r in rng.random(n)], 3000)
    got = M.gram(df, "k")
    assert set(got) == set(k)
    for key, g in got.items():
        at = np.asarray([v == key for v in k])
        full = np.hstack([np.ones((at.sum(), 1)), x[at] - g.about, y[at][:, None]])
        assert np.allclose(g.m, full.T @ full)
    whole = M.gram_table(df, "k").total()
    assert np.allclose(whole.m, M.gram(df)[None].m if np.allclose(whole.about, M.gram(df)[None].about) else M.total(got).m)


def test_models_of_ten_thousand_keys(spark):
    """Leave-one-key-out models are made on executors; nothing of the keys is collected."""
    df, x, y, k = rows(spark, lambda rng, n: [f"g{i % 10_000}" for i in range(n)], 30_000, d=3)
    out = Cv.out_of_fold(df, lambda g: So.ridge(g, 2.0), "k")
    got = {r.id: r.y_pred for r in out.where("id % 997 = 0").collect()}
    assert out.where("y_pred IS NULL").count() == 0
    for i, p in got.items():
        at = k != k[i]
        sd, mean = x[at].std(0), x[at].mean(0)
        z = (x[at] - mean) / sd
        w = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ (y[at] - y[at].mean()))
        assert p == pytest.approx(y[at].mean() + ((x[i] - mean) / sd) @ w, abs=1e-8)


def test_small_matrices_take_the_total(spark):
    df, *_ = rows(spark, lambda rng, n: ["a"] * (n - 3) + ["b"] * 3, 200)
    table = M.gram_table(df, "k")
    fits = {"ridge": lambda g: So.ridge(g, 1.0), "mean": So.mean_only}
    got = {r.k: r for r in Cv.solve(table, fits, min_rows=40).collect()}
    whole = So.ridge(table.total(), 1.0)
    assert got["b"].n == 3 and [m.spec for m in got["b"].m] == ["ridge", "mean"]
    assert np.allclose(got["b"].m[0].w, whole.coef) and not np.allclose(got["a"].m[0].w, whole.coef)
    alone = Cv.solve(table, fits, min_rows=40, fallback=False)
    assert [r.k for r in alone.collect()] == ["a"]
    info = Cv.solve(table, {"": So.one_band}).select(F.col("m")[0]["info"].alias("i")).first().i
    assert set(json.loads(info)) == {"band"}


def test_a_single_fold_has_no_model(spark):
    df, *_ = rows(spark, lambda rng, n: ["a"] * n, 50)
    assert Cv.out_of_fold(df, So.mean_only, "k").where("y_pred IS NOT NULL").count() == 0


def test_weights_and_missing_values(spark):
    df = spark.createDataFrame(
        [("a", 1.0, [1.0, 2.0], 2.0), ("a", 3.0, [0.0, 1.0], 1.0), ("a", None, [9.0, 9.0], 1.0), ("b", float("nan"), [1.0, 1.0], 1.0), ("b", 2.0, None, 1.0), ("b", 5.0, [2.0, 2.0], 3.0)],
        "k string, y double, x array<double>, w double",
    )
    got = M.gram(df, "k", ["y"], "w")
    assert (got["a"].n, got["b"].n) == (3.0, 3.0)
    assert np.allclose(got["a"].mean, [2 / 3, 5 / 3]) and got["a"].y_mean() == pytest.approx(5 / 3)
