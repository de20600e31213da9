"""Spectrum transforms: properties, edges and numpy checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.functions import arrays as A
from bandwright.functions import features as X
from bandwright.functions import scalars as S
from bandwright.functions.preprocessors import PREPROCESSORS, get_preprocessor

RNG = np.random.default_rng(3)
ROWS = RNG.normal(1.0, 0.4, size=(12, 30))


def frame(spark, rows):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(rows)], "id long, x array<double>")


def run(spark, fn, rows=ROWS):
    got = frame(spark, rows).select("id", fn(F.col("x")).alias("o")).orderBy("id").collect()
    return [np.asarray(r["o"], dtype=float) for r in got]


def test_snv_has_mean_zero_and_deviation_one(spark):
    for row in run(spark, A.snv):
        assert abs(row.mean()) < 1e-12 and abs(row.std(ddof=1) - 1) < 1e-12


@pytest.mark.parametrize("ddof,zero", [(1, "floor"), (0, "floor"), (0, "one")])
def test_snv_of_a_constant_is_zero(spark, ddof, zero):
    assert np.allclose(run(spark, lambda x: A.snv(x, ddof, zero), [[2.0] * 5])[0], 0)


def test_scatter_correction_returns_the_reference(spark):
    ref = ROWS.mean(0)
    rows = [3.0 + 2.0 * ref, ref - 1.0]
    for row in run(spark, lambda x: A.scatter_correct(x, A.doubles(ref)), rows):
        assert np.allclose(row, ref)


def test_extended_scatter_correction(spark):
    ref = ROWS.mean(0)
    t = np.linspace(-1, 1, 30)
    row = run(spark, lambda x: A.extended_scatter_correct(x, ref, 2), [1.5 * ref + 0.3 - 0.2 * t + 0.1 * t * t])[0]
    assert np.allclose(row, ref)


@pytest.mark.parametrize("window,deriv", [(7, 0), (9, 0), (11, 1), (11, 2)])
def test_savgol_equals_local_polynomials(spark, window, deriv):
    half = window // 2
    got = run(spark, lambda x: A.savgol(x, window, 2, deriv), ROWS[:2])
    for row, out in zip(ROWS[:2], got):
        for j in range(30):
            s = min(max(j - half, 0), 30 - window)
            poly = np.polynomial.Polynomial.fit(np.arange(window), row[s : s + window], 2, domain=[0, window - 1], window=[0, window - 1])
            assert abs((poly.deriv(deriv) if deriv else poly)(j - s) - out[j]) < 1e-9


def test_short_rows_pass_the_fixed_filter(spark):
    assert np.allclose(run(spark, A.smooth5, [[1.0, 5.0, 2.0]])[0], [1, 5, 2])


def test_one_band_row(spark):
    assert np.allclose(run(spark, A.centre, [[4.0]])[0], [0])
    assert len(run(spark, A.difference, [[4.0]])[0]) == 0


def test_split_points_follow_uneven_split():
    for n, bins in ((10, 4), (64, 5), (7, 3)):
        want = [(int(p[0]), int(p[-1]) + 1) for p in np.array_split(np.arange(n), bins)]
        assert X.split_points(n, bins) == want


def test_dct_is_orthonormal():
    m = np.asarray(X.dct_rows(16, range(16)))
    assert np.allclose(m @ m.T, np.eye(16))


def test_perturbation_is_repeatable_and_small(spark):
    fn = lambda x: X.perturb(x, F.lit(5), 0.005, 1)
    a, b = run(spark, fn), run(spark, fn)
    assert all(np.array_equal(p, q) for p, q in zip(a, b))
    assert max(np.abs(p - r).max() for p, r in zip(a, ROWS)) < 0.3
    assert max(np.abs(p - r).max() for p, r in zip(a, ROWS)) > 0


def test_every_view_and_set_builds(spark):
    ref = ROWS.mean(0)
    for name in (*X.SEARCH_VIEWS, "center", "sg7_snv", "sg9_snv_d2", "sg9_snv_stack_d1", "detrend_snv", "msc_sg9"):
        assert len(run(spark, lambda x, n=name: X.view(x, n, ref), ROWS[:1])[0]) > 0
    for name in ("shape_compact", "shape_ratios", "shape_deriv", "shape_all", "mv_core", "mv_dct", "mv_contrast", "event"):
        assert len(run(spark, lambda x, n=name: X.feature_set(x, 30, n, ref), ROWS[:1])[0]) > 0
    with pytest.raises(ValueError):
        X.view(F.col("x"), "nope")


def test_preprocessor_registry(spark):
    assert len(PREPROCESSORS) == 25
    with pytest.raises(KeyError):
        get_preprocessor("nope")
    with pytest.raises(RuntimeError):
        get_preprocessor("spectral_msc").transform(frame(spark, ROWS))
    df = frame(spark, ROWS).withColumn("grp", F.col("id") % 2).withColumn("seq", F.col("id"))
    out = get_preprocessor("spectral_snv_diff1_meta").transform(df).orderBy("id").first()
    assert len(out["x"]) == 31 and out["x"][-2:] == [0.0, 0.0]


def test_power_transforms_invert(spark):
    df = spark.createDataFrame([(v,) for v in (-3.0, -0.5, 0.0, 0.7, 12.0)], "y double")
    for lam in (-0.5, 0.0, 0.5, 1.0, 2.0, 2.5):
        for r in df.select("y", S.yeo_johnson_inverse(S.yeo_johnson(F.col("y"), lam), lam).alias("b")).collect():
            assert abs(r["y"] - r["b"]) < 1e-9
    pos = df.where("y > 0")
    for lam in (-0.5, 0.0, 0.5, 2.0):
        for r in pos.select("y", S.box_cox_inverse(S.box_cox(F.col("y"), lam), lam).alias("b")).collect():
            assert abs(r["y"] - r["b"]) < 1e-9


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.3, 0.5, 0.8, 0.99, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", S.normal_quantile(F.col("p")).alias("z")).collect()
    for r in got:
        assert abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-6


def test_numbers_out_of_text(spark):
    df = spark.createDataFrame([("",), (" ",), (None,), ("3.5",), ("x",), ("NaN",), ("Infinity",), ("0",)], "t string")
    assert [r[0] for r in df.select(S.parse_number(F.col("t"))).collect()] == [None, None, None, 3.5, None, None, None, 0.0]
