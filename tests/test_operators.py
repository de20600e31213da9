"""Order, neighbours, monotone fits, selections and fits against brute force, with skewed groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.operators import compare as K
from bandwright.operators import corrections as C
from bandwright.operators import detectors as De
from bandwright.operators import fits as Fi
from bandwright.operators import folds as Cv
from bandwright.operators import groups as G
from bandwright.operators import monotone as Mo
from bandwright.operators import neighbours as Nb
from bandwright.operators import ordered as O
from bandwright.operators import select as P
from bandwright.operators import sets as U
from bandwright.operators import solvers as So
from bandwright.operators import targets as T
from bandwright.operators import weights as W
from bandwright.operators.moments import Gram, gram, held_out, total

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of all rows, one of two rows and one of one row; many tied values."""
    grp = [0] * 400 + [1] * 2 + [2] + list(RNG.integers(3, 20, 800))
    rows = [(k, int(g), float(v)) for k, (g, v) in enumerate(zip(grp, RNG.integers(0, 30, len(grp)) / 2.0))]
    return spark.createDataFrame(rows, "id long, grp long, v double").repartition(7).cache()


@pytest.fixture(scope="module")
def spectra(spark):
    n, d = 160, 9
    x = RNG.normal(size=(n, d)) @ RNG.normal(size=(d, d)) + 5
    y = x @ RNG.normal(size=d) + RNG.normal(size=n)
    rows = [(k, k % 6, [float(v) for v in x[k]], float(y[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, grp long, x array<double>, y double").repartition(5).cache()
    return df, x, y


# ---- order -----------------------------------------------------------------------------


def test_ordinal_numbers_rows_of_a_group(skewed):
    far = O.ordinal(skewed, ["grp"], ["v", "id"], "r").select("id", "r").toPandas().set_index("id")["r"]
    pdf = skewed.toPandas().sort_values(["grp", "v", "id"])
    want = pdf.assign(r=pdf.groupby("grp").cumcount()).set_index("id")["r"]
    assert (far.sort_index() == want.sort_index()).all()


def test_quantiles_equal_numpy(skewed):
    got = O.quantiles(skewed, "v", [0.0, 0.1, 0.5, 0.93, 1.0], ["grp"]).collect()
    pdf = skewed.toPandas()
    for r in got:
        want = np.quantile(pdf[pdf.grp == r["grp"]].v, [0, 0.1, 0.5, 0.93, 1])
        assert np.allclose([r[f"q{j}"] for j in range(5)], want)


def test_blocks_do_not_change_neighbours_or_sums(skewed, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 7)
    ranked = O.ordinal(skewed, ["grp"], ["id"], "r").withColumn("h", F.when(F.col("id") % 11 == 0, F.col("v")))
    out = O.running_sum(O.previous(ranked, ["grp"], "r", "v", "p"), ["grp"], "r", "v", "s")
    out = O.carry(O.carry(out, ["grp"], "r", "h", "f"), ["grp"], "r", "h", "b", forward=False)
    pdf = out.toPandas().sort_values(["grp", "r"])
    g = pdf.groupby("grp")
    for got, want in ((pdf.p, g.v.shift()), (pdf.s, g.v.cumsum()), (pdf.f, g.h.ffill()), (pdf.b, g.h.bfill())):
        assert np.allclose(got.astype(float), want.astype(float), equal_nan=True)


def test_bins_when_n_is_not_divisible(spark):
    df = spark.range(10).withColumn("v", F.col("id").cast("double"))
    got = [r["b"] for r in O.equal_bins(df, [], ["v"], 4, "b").orderBy("id").collect()]
    want = []
    for b in range(4):
        want += [b] * (10 * (b + 1) // 4 - 10 * b // 4)
    assert got == want


# ---- monotone --------------------------------------------------------------------------


def pav(v):
    runs = []
    for a in v:
        runs.append([a, 1])
        while len(runs) > 1 and runs[-2][0] / runs[-2][1] > runs[-1][0] / runs[-1][1]:
            s, n = runs.pop()
            runs[-1][0] += s
            runs[-1][1] += n
    return np.concatenate([[s / n] * n for s, n in runs])


@pytest.mark.parametrize("chunk", [3, 16, 100_000])
def test_isotonic_in_chunks(skewed, chunk):
    ranked = O.ordinal(skewed, ["grp"], ["id"], "k")
    pdf = Mo.isotonic(ranked, ["grp"], "k", "v", "fit", True, chunk=chunk).toPandas().sort_values(["grp", "k"])
    for _, part in pdf.groupby("grp"):
        assert np.allclose(part.fit, pav(part.v.to_numpy()))


def test_isotonic_is_monotone_idempotent_and_leaves_small_groups(skewed):
    once = Mo.isotonic_by_group(skewed, "grp", ["id"], "v", "f").cache()
    twice = Mo.isotonic_by_group(once, "grp", ["id"], "f", "f2").toPandas().sort_values(["grp", "id"])
    assert np.allclose(twice.f, twice.f2)
    big = twice[twice.grp != 1]
    assert (big.groupby("grp").f.diff().dropna() <= 1e-9).all()
    small = twice[twice.grp.isin([1, 2])]
    assert np.allclose(small.f, small.v)


def test_curve_reading_interpolates_and_clips(spark):
    curve = spark.createDataFrame([(0.2, 1.0), (0.6, 0.5), (0.8, 0.0)], "p double, c double")
    df = spark.createDataFrame([(k, p) for k, p in enumerate([0.0, 0.2, 0.4, 0.6, 0.7, 0.9])], "id long, pos double")
    got = [r["o"] for r in Mo.read_curve(df, curve, "pos", "id", "o").orderBy("id").collect()]
    assert np.allclose(got, np.interp([0.0, 0.2, 0.4, 0.6, 0.7, 0.9], [0.2, 0.6, 0.8], [1.0, 0.5, 0.0]))


# ---- neighbours ------------------------------------------------------------------------


def brute(q, qid, r, rid, k, no_self):
    out = {}
    for v, a in zip(q, qid):
        d = np.sqrt(((r - v) ** 2).sum(1))
        order = [j for j in np.lexsort((rid, d)) if not (no_self and rid[j] == a)][:k]
        out[a] = [(int(rid[j]), d[j]) for j in order]
    return out


@pytest.mark.parametrize("plan", ["refs", "queries", "cells"])
@pytest.mark.parametrize("no_self", [True, False])
def test_knn_plans_with_many_copies(spark, plan, no_self, monkeypatch):
    monkeypatch.setattr(Nb, "BLOCK_ROWS", 40)
    monkeypatch.setattr(Nb, "CELL_ROWS", 20)
    x = np.round(RNG.normal(size=(240, 4)), 2)
    x[:80] = x[0]
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, x array<double>")
    got = Nb.knn(df, df, 6, no_self, plan=plan).toPandas()
    want = brute(x, range(240), x, np.arange(240), 6, no_self)
    for a, part in got.groupby("qid"):
        part = part.sort_values("pos")
        assert list(part.rid) == [j for j, _ in want[a]]
        assert np.allclose(part.d, [d for _, d in want[a]])
    assert len(got) == 240 * 6


def test_fewer_references_than_k(spark):
    df = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(3)], "id long, x array<double>")
    for plan in ("refs", "queries", "cells"):
        assert Nb.knn(df, df, 5, True, plan=plan).count() == 6


def test_energy_of_a_group_with_itself_and_blocks(spectra, monkeypatch):
    df, x, _ = spectra
    one = Nb.energy_distance(df, df, 10, None).toPandas().set_index(["test_grp", "train_grp"]).energy
    monkeypatch.setattr(Nb, "BROADCAST_BYTES", 8 * 9 * 20)
    many = Nb.energy_distance(df, df, 10, None).toPandas().set_index(["test_grp", "train_grp"]).energy
    assert np.allclose(one.sort_index(), many.sort_index())
    assert (one >= 0).all()


def test_isolation_score_ranks_an_outlier_first(spark):
    x = RNG.normal(size=(300, 3))
    x[7] = 12.0
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, x array<double>")
    assert De.isolation_score(df, df, trees=40, sample=64).orderBy(F.col("iso").desc()).first()["id"] == 7


# ---- selection -------------------------------------------------------------------------


def test_caps_hold_and_refill_reaches_the_target(skewed):
    for refill, cap in ((False, 3), (True, 3)):
        out = P.capped_top_fraction(skewed, "v", "id", "grp", 0.2, cap, refill=refill).where("gate")
        most = out.groupBy("grp").count().agg(F.max("count")).first()[0]
        if refill:
            assert out.count() == round(1203 * 0.2)
        else:
            assert most <= cap


def test_ties_at_the_edge_of_a_top_k(spark):
    corr = spark.createDataFrame([(0, 0.5), (1, -0.5), (2, 0.5), (3, 0.1)], "band long, corr double")
    assert [r["band"] for r in P.top_bands(corr, 2).orderBy("pos").collect()] == [2, 1]
    assert [r["band"] for r in P.top_bands(corr, 2, ties="low").orderBy("pos").collect()] == [0, 1]


def test_farthest_points_equal_brute_force(spectra):
    df, x, _ = spectra
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    chosen = [int(np.sqrt(((x - x.mean(0)) ** 2).sum(1)).argmax())]
    while len(chosen) < 5:
        near = d[:, chosen].min(1)
        near[chosen] = -1
        chosen.append(int(near.argmax()))
    assert P.farthest_points(df, 5) == chosen


def test_alignment_refuses_missing_and_repeated_ids(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, p double")
    b = spark.createDataFrame([(1, 1.0), (3, 2.0)], "id long, q double")
    c = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 2.0)], "id long, q double")
    for other in (b, c):
        with pytest.raises(ValueError):
            U.align(a, other)


# ---- matrices and fits -----------------------------------------------------------------


def local(x, y, w=None):
    rows = np.hstack([np.ones((len(x), 1)), x, y[:, None]])
    return Gram((rows if w is None else rows * w[:, None]).T @ rows, np.zeros(x.shape[1]), 1)


def test_gram_equals_numpy_and_fold_complement_equals_direct(spectra):
    df, x, y = spectra
    grams = gram(df, "grp")
    rest = held_out(grams)
    assert np.allclose(total(grams).sxx, (x - x.mean(0)).T @ (x - x.mean(0)))
    for k, g in rest.items():
        at = np.arange(len(y)) % 6 != int(k)
        a, b = So.ridge(g, 2.0), So.ridge(local(x[at], y[at]), 2.0)
        assert np.allclose(a.coef, b.coef) and abs(a.intercept - b.intercept) < 1e-8


def test_weighted_gram(spectra):
    df, x, y = spectra
    w = 1.0 + (np.arange(len(y)) % 3)
    g = gram(df.withColumn("w", F.col("id") % 3 + 1.0), None, ["y"], "w")[None]
    h = local(x, y, w)
    assert np.allclose(g.mean, h.mean) and np.allclose(g.sxy(), h.sxy())


@pytest.mark.parametrize("k", [1, 2, 4, 9])
def test_kernel_pls_equals_nipals(spectra, k):
    df, x, y = spectra
    model = So.pls(gram(df)[None], k)
    sd = x.std(0, ddof=1)
    a, b = (x - x.mean(0)) / sd, y - y.mean()
    e, f, ws, ps, qs = a.copy(), b.copy(), [], [], []
    for _ in range(k):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(w), ps.append(p), qs.append(q)
    w, p = np.array(ws).T, np.array(ps).T
    coef = w @ np.linalg.solve(p.T @ w, np.array(qs))
    assert np.allclose(x @ model.coef + model.intercept, a @ coef + y.mean())


def test_pca_scores_and_pca_ridge(spectra):
    df, x, y = spectra
    z = T.fit_pca(df, 3)
    got = np.array([r["x"] for r in T.scores(df, z).orderBy("id").collect()])
    xc = x - x.mean(0)
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(xc @ vt[:3].T))
    model = So.pca_ridge(gram(df)[None], 3, 5.0, scale=False)
    sc = xc @ vt[:3].T
    want = sc @ np.linalg.solve(sc.T @ sc + 5 * np.eye(3), sc.T @ (y - y.mean())) + y.mean()
    assert np.allclose(x @ model.coef + model.intercept, want)


def test_elastic_net_meets_its_conditions(spectra):
    df, x, y = spectra
    alpha, l1 = 0.3, 0.4
    m = So.elastic_net(gram(df)[None], alpha, l1)
    z = (x - x.mean(0)) / x.std(0)
    w = m.coef * x.std(0)
    grad = z.T @ (y - y.mean() - z @ w) / len(y) - alpha * (1 - l1) * w
    for g, c in zip(grad, w):
        assert abs(g - alpha * l1 * np.sign(c)) < 1e-6 if c else abs(g) <= alpha * l1 + 1e-9


def test_bayes_ridge_and_ard_are_close_to_least_squares(spectra):
    df, x, y = spectra
    g = gram(df)[None]
    ols = np.linalg.lstsq(np.c_[x, np.ones(len(y))], y, rcond=None)[0]
    for m in (So.bayes_ridge(g), So.ard(g)):
        assert np.sqrt(np.mean((x @ m.coef + m.intercept - np.c_[x, np.ones(len(y))] @ ols) ** 2)) < 0.3


def test_ridge_by_leave_one_out(spectra):
    df, x, y = spectra
    g = gram(df)[None]
    bands = So.top_bands(g, 4)
    errors = {}
    for a in (3.0, 10.0, 30.0, 100.0, 300.0, 1000.0):
        z = (x[:, bands] - x[:, bands].mean(0)) / x[:, bands].std(0)
        h = 1 / len(y) + np.einsum("ij,jk,ik->i", z, np.linalg.inv(z.T @ z + a * np.eye(4)), z)
        m = So.ridge(g, a, bands)
        errors[a] = (((y - x @ m.coef - m.intercept) / (1 - h)) ** 2).sum()
    assert Fi.ridge_loo(df, 4).info["alpha"] == min(errors, key=errors.get)


def test_quantile_fit_leaves_the_right_share_above(spectra):
    df, x, y = spectra
    for q, m in zip((0.5, 0.75), Fi.quantile_fits(df, [0, 1, 2], (0.5, 0.75))):
        below = np.mean(y <= x @ m.coef + m.intercept)
        assert abs(below - q) < 0.05


def test_constant_band_and_constant_target(spark):
    df = spark.createDataFrame([(k, 0, [1.0, float(k)], 3.0) for k in range(6)], "id long, grp long, x array<double>, y double")
    assert all(abs(r["y_pred"] - 3) < 1e-12 for r in Fi.one_band(df, df).collect())
    assert G.metrics(df.withColumn("y_pred", F.col("y") + 1), true="y").first()["r2"] == 0.0


def test_quantile_table_equals_numpy(skewed):
    got = T.quantile_table(skewed.where("grp in (0, 5)"), "v", 11, ["grp"]).toPandas()
    pdf = skewed.toPandas()
    for g, part in got.groupby("grp"):
        assert np.allclose(part.sort_values("j").q, np.quantile(pdf[pdf.grp == g].v, np.linspace(0, 1, 11)))


def test_power_target_is_near_the_best_lambda(spark):
    z = RNG.normal(size=400)
    df = spark.createDataFrame([(float(np.exp(v)),) for v in z], "y double")
    assert abs(T.best_lambda(df, "y", "box_cox")) < 0.15
    with pytest.raises(ValueError):
        T.PowerTarget.fit(df.withColumn("y", F.col("y") - 1), family="box_cox")


def test_group_folds(spectra):
    df, _, _ = spectra
    folded = Cv.group_kfold(df, 4)
    assert folded.groupBy("grp").agg(F.countDistinct("fold_id").alias("n")).where("n > 1").count() == 0
    assert folded.select("fold_id").distinct().count() == 4
    assert Cv.assign(df, "none") is None
    with pytest.raises(ValueError):
        Cv.assign(df, "nope")


# ---- corrections and comparison --------------------------------------------------------


def test_blend_with_weight_zero_is_the_base(skewed):
    out = skewed.select("v", C.blend(F.col("v"), F.col("id") * 1.0, 0.0).alias("o"))
    assert out.where("v <> o").count() == 0


def test_vanishing_signal_gives_no_correction(skewed):
    df = skewed.withColumn("s", F.lit(0.0)).withColumn("r", F.col("v"))
    assert C.beta(df, "s", "r") == 0.0


def test_interpolation_equals_numpy(spark):
    points = [(0.0, 1.0), (2.0, 5.0), (3.0, -1.0)]
    xs = [-1.0, 0.0, 0.5, 2.0, 2.9, 3.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in xs], "v double").select(C.interpolate(F.col("v"), points)).collect()]
    assert np.allclose(got, np.interp(xs, *zip(*points)))


def test_correlation_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(G.safe_corr("a", "b")).first()[0] == 0.0


def test_ridge_audit_equals_refits(spark):
    x = RNG.normal(size=(14, 3))
    y = x @ [1.0, -2.0, 0.5] + RNG.normal(size=14)
    df = spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y))], "k long, a double, b double, c double, t double")
    for r in K.ridge_audit(df, ["a", "b", "c"], "t", "k").collect():
        keep = np.arange(14) != r["k"]
        m, s = x[keep].mean(0), x[keep].std(0)
        z = (x[keep] - m) / s
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[keep] - y[keep].mean()))
        assert abs(r["estimate"] - (y[keep].mean() + ((x[r["k"]] - m) / s) @ w)) < 1e-9


def test_missing_parts_of_the_composite(spark):
    df = spark.createDataFrame([(10.0, None, 20.0), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(K.composite(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert abs(got[0] - (5.0 + 4.0) / 0.7) < 1e-12 and got[1] is None


def test_cut_weights_have_mean_one(skewed):
    out = W.final_weights(W.cap_groups(skewed.withColumn("w", F.col("v") / 7), "w", 1.1), "w")
    assert abs(out.agg(F.avg("w")).first()[0] - 1) < 1e-9


def test_alignment_refuses_ids_repeated_on_both_sides(spark):
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "id long, v double")
    once = spark.createDataFrame([(1, 1.0), (2, 3.0)], "id long, w double")
    with pytest.raises(ValueError):
        U.align(twice, twice.withColumnRenamed("v", "w"))
    assert U.align(once.withColumnRenamed("w", "v"), once).count() == 2
    assert [tuple(r) for r in U.unmatched(once, once.where("id = 1")).collect()] == [(2, "left")]


def test_rows_without_target_or_spectrum_do_not_enter_a_fit(spark):
    rows = [(float(k), [float(k), float(k * k)]) for k in range(6)]
    schema = "y double, x array<double>"
    whole = gram(spark.createDataFrame(rows, schema))[None]
    held = gram(spark.createDataFrame(rows + [(None, [1.0, 2.0]), (3.0, None), (float("nan"), [1.0, 1.0])], schema))[None]
    assert held.n == whole.n and np.allclose(held.sxx, whole.sxx) and np.allclose(held.sxy(), whole.sxy())


def test_silhouette_of_two_tight_clusters(spark):

    rows = [(0, [0.0, 0.0]), (0, [0.0, 1.0]), (1, [10.0, 0.0]), (1, [10.0, 1.0])]
    value = G.silhouette(spark.createDataFrame(rows, "cluster int, x array<double>")).first()[0]
    own, other = 1.0, (100.0 + 101.0) / 2
    assert abs(value - (other - own) / other) < 1e-9


def test_search_in_tiles_equals_one_tile(monkeypatch):
    """Distance tiles stay within their bound and give the neighbours of the whole matrix, ties by id."""
    rng = np.random.default_rng(4)
    q, r = rng.integers(0, 4, (70, 3)).astype(float), rng.integers(0, 4, (900, 3)).astype(float)
    qid, rid = np.arange(70), rng.permutation(900)
    whole = Nb.search(q, qid, r, rid, 7, True)
    monkeypatch.setattr(Nb, "REF_TILE", 50)
    monkeypatch.setattr(Nb, "QUERY_TILE", 16)
    for a, b in zip(whole, Nb.search(q, qid, r, rid, 7, True)):
        assert np.array_equal(a, b)
    dist = np.sqrt(((q[0] - r) ** 2).sum(1)) + np.where(rid == 0, np.inf, 0)
    order = np.lexsort((rid, dist))[:7]
    assert np.array_equal(whole[1][:7], rid[order])
