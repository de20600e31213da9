"""Regression models (MOD): one-band fits, fits on aggregated matrices, MLlib models, local and routed fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import features as X
from ..functions import scalars as S
from . import moments as M
from . import neighbours as Nb
from . import select as P
from . import solvers as So
from . import targets as T
from .folds import predict, predict_by, predict_many, solve
from .groups import centroids
from .moments import Gram, gram, gram_table, spectra_matrix
from .ordered import join_on, quantile_values

# ---- one band --------------------------------------------------------------------------


def fold_models(df: DataFrame, fold: str = "fold_id", y: str = "y", bands: DataFrame | None = None) -> DataFrame:
    """(fold, band, slope, intercept, corr) of the best band of every train side (ties: low band)."""
    rest = M.complement(M.band_moments(df, [fold], y), fold)
    fitted = rest.select(fold, "band", M.pearson().alias("corr"), M.slope().alias("slope"), M.intercept().alias("intercept"))
    return P.top_bands(fitted, 1, [fold], ties="low").drop("pos")


def one_band_oof(df: DataFrame, fold: str = "fold_id", y: str = "y", name: str = "y_pred") -> DataFrame:
    models = fold_models(df, fold, y).select(fold, "band", "slope", "intercept")
    out = join_on(df, models, [fold])
    return out.withColumn(name, F.col("intercept") + F.col("slope") * F.get("x", F.col("band")))


def group_rmse_by_band(df: DataFrame, group: str = "grp", y: str = "y") -> DataFrame:
    """Leave-one-group-out rmse of every band. The held-out error is a polynomial in the group's own
    sums, so the rows are read once."""
    own = M.band_moments(df, [group], y)
    rest = M.complement(own, group).select(group, "band", M.slope().alias("b"), M.intercept().alias("a"), F.col("n").alias("n_fit"))
    a, b = F.col("a"), F.col("b")
    sse = (
        F.col("syy") - a * F.col("sy") * 2 - b * F.col("sxy") * 2
        + F.col("n") * a * a + a * b * F.col("sx") * 2 + b * b * F.col("sxx")
    )
    both = own.join(rest, [group, "band"]).where(F.col("n_fit") >= 2)
    return both.groupBy("band").agg(F.sqrt(F.sum(F.greatest(sse, F.lit(0.0))) / F.sum("n")).alias("rmse"))


def choose_band(df: DataFrame, how: str, fixed: int = 616, row_no: str = "id", pool: int = 30, y: str = "y") -> int:
    """Band by rule: best, second, fixed, stable, consensus, loo_rmse or msc."""
    if how == "fixed":
        d = df.select(F.size("x").alias("d")).first()["d"]
        return min(fixed, d - 1)
    if how == "consensus":
        picks = fold_models(df, "grp", y).groupBy("band").agg(F.count("*").alias("v"))
        return picks.orderBy(F.col("v").desc(), "band").first()["band"]
    if how == "stable":
        return P.stable_top_bands(df, 1, row_no).first()["band"]
    src = df
    if how == "msc":
        src = df.withColumn("x", A.scatter_correct(F.col("x"), A.doubles(M.mean_spectrum(df))))
    m = M.band_moments(src, [], y).select("band", "n", M.pearson().alias("corr"))
    if how in ("best", "msc"):
        return P.top_bands(m, 1, ties="low").first()["band"]
    if how == "second":
        return P.top_bands(m, 2).where("pos = 2").first()["band"]
    if how == "loo_rmse":
        cand = P.top_bands(m, pool).select("band", "pos")
        return group_rmse_by_band(df, "grp", y).join(F.broadcast(cand), "band").orderBy("rmse", "pos").first()["band"]
    raise ValueError(f"unknown rule {how}")


def fit_band(df: DataFrame, band: int, y: str = "y") -> tuple[float, float]:
    """(slope, intercept) on one band."""
    row = df.select(F.get("x", F.lit(band)).alias("v"), F.col(y).alias("y")).agg(*M.moment_aggs()).select(
        M.slope().alias("b"), M.intercept().alias("a")
    ).first()
    return row["b"], row["a"]


def y_range(df: DataFrame, y: str = "y") -> tuple[float, float]:
    r = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    return r["lo"], r["hi"]


def one_band(fit: DataFrame, df: DataFrame, how: str = "best", clip: bool = False, name: str = "y_pred", **rule) -> DataFrame:
    band = choose_band(fit, how, **rule)
    b, a = fit_band(fit, band)
    value = F.lit(a) + F.get("x", F.lit(band)) * b
    if clip:
        value = S.clip(value, *y_range(fit))
    return df.withColumn(name, value)


def median_of_three(fit: DataFrame, df: DataFrame, bands: Sequence[int] | None = None, name: str = "y_pred") -> DataFrame:
    """Middle of three one-band predictions; without bands the three best are used."""
    m = M.band_moments(fit, [])
    if bands is None:
        usable = m.where(M.m_xx() / F.greatest(F.col("n") - 1, F.lit(1)) >= 1e-6).withColumn("corr", M.pearson())
        bands = [r["band"] for r in P.top_bands(usable, 3).orderBy("pos").collect()]
    lines = {r["band"]: r for r in m.where(F.col("band").isin(list(bands))).select("band", M.slope().alias("b"), M.intercept().alias("a")).collect()}
    p = [F.lit(lines[k]["a"]) + F.get("x", F.lit(int(k))) * lines[k]["b"] for k in bands]
    return df.withColumn(name, S.clip(A.median3(*p), *y_range(fit)))


def group_band_models(fit: DataFrame) -> DataFrame:
    """(grp, band, slope, intercept): each train group with its own best band."""
    per = M.band_moments(fit, ["grp"]).select(
        "grp", "band", M.pearson().alias("corr"), M.slope().alias("slope"), M.intercept().alias("intercept")
    )
    return P.top_bands(per, 1, ["grp"], ties="low").select("grp", "band", "slope", "intercept")


def nearest_group_map(fit: DataFrame, df: DataFrame) -> DataFrame:
    """(test_grp, train_grp) by cosine of mean spectra."""
    return Nb.nearest_groups(centroids(df), centroids(fit), 1).select("test_grp", "train_grp")


def nearest_group_fit(fit: DataFrame, df: DataFrame, name: str = "y_pred") -> DataFrame:
    """Every test group predicted by the model of its nearest train group, clipped."""
    models = group_band_models(fit).withColumnRenamed("grp", "train_grp")
    table = nearest_group_map(fit, df).join(models, "train_grp").withColumnRenamed("test_grp", "grp")
    out = join_on(df, table, ["grp"])
    value = F.col("intercept") + F.col("slope") * F.get("x", F.col("band"))
    return out.withColumn(name, S.clip(value, *y_range(fit)))


def binned_slopes(
    fit: DataFrame, df: DataFrame, by: str = "y", bins: int = 4, min_rows: int = 40, shrink: float = 80.0, name: str = "y_pred"
) -> DataFrame:
    """One band, a line per quantile bin of the target or of the global prediction (``proxy``, shrunk
    by n / (n + shrink)); rows are binned by the global prediction."""
    band = choose_band(fit, "best")
    b, a = fit_band(fit, band)
    line = F.lit(a) + F.get("x", F.lit(band)) * b
    src = fit.select("y", F.get("x", F.lit(band)).alias("v"), line.alias("proxy"))
    edges = quantile_values(src, by, [k / bins for k in range(1, bins)])
    per = src.withColumn("bin", S.bin_by_edges(F.col(by), edges)).groupBy("bin").agg(*M.moment_aggs())
    per = per.select("bin", "n", M.slope().alias("b"), M.intercept().alias("a")).collect()
    lines = {k: (b, a) for k in range(bins)}
    for r in per:
        if r["n"] < min_rows:
            continue
        w = 1.0 if by == "y" else r["n"] / (r["n"] + shrink)
        lines[r["bin"]] = ((1 - w) * b + w * r["b"], (1 - w) * a + w * r["a"])
    at = S.bin_by_edges(line, edges)
    value = F.lit(None).cast("double")
    for k, (sl, ic) in lines.items():
        value = F.when(at == k, F.lit(ic) + F.get("x", F.lit(band)) * sl).otherwise(value)
    return df.withColumn(name, S.clip(value, *y_range(fit)))


# ---- matrix fits -----------------------------------------------------------------------


def fit_linear(fit: DataFrame, rule: Callable[[Gram], So.Linear], weight: str | None = None, y: str = "y") -> So.Linear:
    return rule(gram(fit, None, [y], weight)[None])


def top_ridge(k: int, alpha: float) -> Callable[[Gram], So.Linear]:
    return lambda g: So.ridge(g, alpha, So.top_bands(g, k))


def weighted_top_ridge(fit: DataFrame, k: int, alpha: float, high: float, q: float) -> So.Linear:
    """Rows at or over a target quantile count ``high`` times; scaling ignores the weights."""
    edge = quantile_values(fit, "y", [q])[0]
    plain = gram(fit)[None]
    bands = So.top_bands(plain, k)
    heavy = gram(fit.withColumn("w", F.when(F.col("y") >= edge, F.lit(high)).otherwise(1.0)), None, ["y"], "w")[None]
    sd = So.scales(plain.take(bands))
    s = heavy.take(bands)
    w = np.linalg.solve(s.sxx / np.outer(sd, sd) + alpha * np.eye(s.d), s.sxy() / sd)
    return So.expand(heavy, bands, w / sd, 0)


def average(models: Sequence[So.Linear]) -> So.Linear:
    return So.Linear(np.mean([m.coef for m in models], axis=0), float(np.mean([m.intercept for m in models])))


# Fixed values: (bands, alpha) of the ridge ensemble.
ENSEMBLE = ((3, 100.0), (5, 30.0), (5, 100.0), (6, 100.0), (8, 300.0))


def clipped_mean(fit: DataFrame, df: DataFrame, rules: Sequence[Callable[[Gram], So.Linear]], name: str = "y_pred") -> DataFrame:
    """Mean of several models, each clipped to the target range first; all from one matrix."""
    g = gram(fit)[None]
    lo, hi = y_range(fit)
    out, total = df, None
    for k, rule in enumerate(rules):
        out = predict(out, rule(g), f"__p{k}")
        p = S.clip(F.col(f"__p{k}"), lo, hi)
        total = p if total is None else total + p
    return out.withColumn(name, total / len(rules)).drop(*[f"__p{k}" for k in range(len(rules))])


def ridge_loo(fit: DataFrame, k: int, alphas: Sequence[float] = (3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)) -> So.Linear:
    """Alpha by leave-one-out error: one pass for the matrix, one for residuals and leverages of all
    alphas at once."""
    g = gram(fit)[None]
    bands = So.top_bands(g, k)
    s = g.take(bands)
    sd = So.scales(s)
    xx = s.sxx / np.outer(sd, sd)
    models = [So.ridge(g, a, bands) for a in alphas]
    inv = [np.linalg.inv(xx + a * np.eye(s.d)) for a in alphas]
    shared = fit.sparkSession.sparkContext.broadcast((s.mean, sd, inv, [(m.coef[bands], m.intercept) for m in models], g.n))

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, invs, lines, n = shared.value
        sums = np.zeros(len(invs))
        for b in batches:
            if b.num_rows == 0:
                continue
            x, y = spectra_matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False)
            z = (x - mean) / scale
            for j, (iv, (w, c)) in enumerate(zip(invs, lines)):
                h = 1.0 / n + np.einsum("ij,jk,ik->i", z, iv, z)
                sums[j] += (((y - x @ w - c) / np.maximum(1 - h, 1e-12)) ** 2).sum()
        yield pa.RecordBatch.from_pydict({"j": np.arange(len(sums)), "s": sums}, schema=pa.schema([("j", pa.int64()), ("s", pa.float64())]))

    cols = fit.select("y", A.pick(F.col("x"), bands).alias("x"))
    table = cols.mapInArrow(errors, "j long, s double").groupBy("j").agg(F.sum("s").alias("s")).collect()
    best = min(table, key=lambda r: (r["s"], r["j"]))["j"]
    models[best].info["alpha"] = alphas[best]
    return models[best]


def quantile_fits(fit: DataFrame, bands: Sequence[int], qs: Sequence[float], rounds: int = 25, eps: float = 1e-3) -> list[So.Linear]:
    """Quantile regressions on a few bands by re-weighted least squares (smoothed pinball loss). One
    pass per round serves all quantiles with a handful of sums."""
    k = len(bands)
    src = fit.select("y", *[F.get("x", F.lit(int(b))).alias(f"v{j}") for j, b in enumerate(bands)])
    terms = [F.lit(1.0), *[F.col(f"v{j}") for j in range(k)], F.col("y")]
    pairs = [(a, b) for a in range(k + 2) for b in range(a, k + 2)]
    coefs: list[np.ndarray | None] = [None] * len(qs)
    for _ in range(rounds):
        aggs = []
        for c, q in zip(coefs, qs):
            if c is None:
                w = F.lit(1.0)
            else:
                r = F.col("y") - sum((F.col(f"v{j}") * float(c[j + 1]) for j in range(k)), F.lit(float(c[0])))
                w = F.when(r >= 0, F.lit(q)).otherwise(F.lit(1 - q)) / F.greatest(F.abs(r), F.lit(eps))
            aggs += [F.sum(w * terms[a] * terms[b]) for a, b in pairs]
        sums = list(src.agg(*aggs).first())
        step = 0.0
        for n in range(len(qs)):
            m = np.zeros((k + 2, k + 2))
            for (a, b), v in zip(pairs, sums[n * len(pairs) : (n + 1) * len(pairs)]):
                m[a, b] = m[b, a] = v
            new = np.linalg.lstsq(m[: k + 1, : k + 1], m[: k + 1, k + 1], rcond=None)[0]
            step = max(step, np.inf if coefs[n] is None else float(np.abs(new - coefs[n]).max() / (1 + np.abs(new).max())))
            coefs[n] = new
        if step < 1e-4:
            break
    d = fit.select(F.size("x").alias("d")).first()["d"]
    out = []
    for c in coefs:
        full = np.zeros(d)
        full[list(bands)] = c[1:]
        out.append(So.Linear(full, float(c[0])))
    return out


def quantile_blend(fit: DataFrame, df: DataFrame, k: int = 6, name: str = "y_pred") -> DataFrame:
    """0.65 median + 0.35 upper quartile on the top bands, clipped."""
    bands = So.top_bands(gram(fit)[None], k)
    mid, up = quantile_fits(fit, bands, (0.5, 0.75))
    both = So.Linear(0.65 * mid.coef + 0.35 * up.coef, 0.65 * mid.intercept + 0.35 * up.intercept)
    return predict(df, both, name).withColumn(name, S.clip(F.col(name), *y_range(fit)))


# ---- MLlib -----------------------------------------------------------------------------


def vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x"))


def huber(fit: DataFrame, df: DataFrame, alpha: float = 1e-4, epsilon: float = 1.35, weight: str | None = None, name: str = "y_pred") -> DataFrame:
    """Huber loss on scaled bands; ``regParam = alpha / n``."""
    mean, sd = T.standardise_fit(fit)
    scaled = lambda d: vectors(d.withColumn("x", T.standardise(F.col("x"), mean, sd)))
    lr = LinearRegression(
        loss="huber", epsilon=epsilon, regParam=alpha / max(fit.count(), 1), standardization=False,
        featuresCol="features", labelCol="y", maxIter=100,
    )
    if weight:
        lr = lr.setWeightCol(weight)
    model = lr.fit(scaled(fit))
    w = np.asarray(model.coefficients.toArray()) / sd
    return predict(df, So.Linear(w, float(model.intercept - w @ mean)), name)


def tweedie(fit: DataFrame, df: DataFrame, k: int, power: float = 1.5, alpha: float = 0.1, name: str = "y_pred") -> DataFrame:
    """Log-link Tweedie model on scaled PCA scores."""
    z = T.fit_pca(fit, k, whiten=True)
    glm = GeneralizedLinearRegression(
        family="tweedie", variancePower=power, linkPower=0.0, regParam=alpha, featuresCol="features", labelCol="y", maxIter=50
    )
    model = glm.fit(vectors(T.scores(fit, z)))
    line = So.through(z, So.Linear(np.asarray(model.coefficients.toArray()), float(model.intercept)))
    return predict(df, line, name).withColumn(name, F.exp(name))


def _tree_fit(model, fit: DataFrame, df: DataFrame, name: str) -> DataFrame:
    fitted = model.setFeaturesCol("features").setLabelCol("y").setPredictionCol(name).fit(vectors(fit))
    return fitted.transform(vectors(df)).drop("features")


def boosted(fit: DataFrame, df: DataFrame, bands: Sequence[int], rounds: int = 160, step: float = 0.04, name: str = "y_pred") -> DataFrame:
    cut_ = lambda d: d.withColumn("__x", F.col("x")).withColumn("x", A.pick(F.col("x"), bands))
    gbt = GBTRegressor(maxDepth=3, stepSize=step, maxIter=rounds, minInstancesPerNode=20, seed=42)
    out = _tree_fit(gbt, cut_(fit).drop("__x"), cut_(df), name)
    return out.withColumn("x", F.col("__x")).drop("__x")


def boosted_on_pls(fit: DataFrame, df: DataFrame, k: int, rounds: int = 160, step: float = 0.04, name: str = "y_pred") -> DataFrame:
    z = So.pls_latent(gram(fit)[None], k)
    gbt = GBTRegressor(maxDepth=3, stepSize=step, maxIter=rounds, minInstancesPerNode=20, seed=42)
    return _tree_fit(gbt, T.scores(fit, z), T.scores(df, z), name)


def forest(fit: DataFrame, df: DataFrame, trees: int = 200, depth: int = 8, leaf: int = 8, name: str = "y_pred") -> DataFrame:
    return _tree_fit(RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=42), fit, df, name)


def cluster(fit: DataFrame, df: DataFrame, k: int, method: str = "kmeans", seed: int = 42, name: str = "cluster") -> DataFrame:
    """Cluster number of every row. The rows of the fit are clustered; ``df`` is assigned."""
    cls = {"kmeans": KMeans, "mixture": GaussianMixture}[method]
    model = cls(k=k, seed=seed, featuresCol="features", predictionCol=name).fit(vectors(fit))
    return model.transform(vectors(df)).drop("features", "probability").withColumn(name, F.col(name).cast("long"))


# ---- local fits ------------------------------------------------------------------------


def local_line(x: np.ndarray, y: np.ndarray, w: np.ndarray, model: str, comps: int, alpha: float) -> So.Linear:
    """Weighted fit on the few rows of one neighbourhood."""
    rows = np.hstack([np.ones((len(x), 1)), x, y[:, None]])
    g = Gram((rows * w[:, None]).T @ rows, np.zeros(x.shape[1]), 1)
    if model == "pls":
        return So.pls(g, min(comps, len(x) - 1))
    return So.pca_ridge(g, min(comps, len(x) - 1), alpha, scale=False)


def local_fit(
    fit: DataFrame, df: DataFrame, k: int, model: str = "ridge", comps: int = 4, alpha: float = 1.0,
    distance_comps: int = 10, name: str = "y_pred", value: str = "y",
) -> DataFrame:
    """Each query fitted on its k nearest train rows (distance weights); neighbours are found on scaled
    PCA scores. A group holds k rows, so groups stay small however many queries there are."""
    z = T.fit_pca(fit, distance_comps, scale=True)
    near = Nb.knn(T.scores(df, z), T.scores(fit, z), k)
    rows = Nb.with_ref(near, fit.withColumn("__v", F.col(value).cast("double")), "x", "__v")
    asked = df.select(F.col("id").alias("qid"), F.col("x").alias("qx"))
    w = 1.0 / F.greatest(F.col("d"), F.lit(1e-6))
    packed = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", w.alias("w"), F.col("__v").alias("y"), "x"))).alias("near"))
    both = packed.join(asked, "qid").select(
        "qid", "qx", F.transform("near", lambda r: r["w"]).alias("w"), F.transform("near", lambda r: r["y"]).alias("y"),
        F.flatten(F.transform("near", lambda r: r["x"])).alias("x"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, y, x, q in zip(pdf["w"], pdf["y"], pdf["x"], pdf["qx"]):
                y, w = np.asarray(y), np.asarray(w)
                m = local_line(np.asarray(x).reshape(len(y), -1), y, w * len(w) / w.sum(), model, comps, alpha)
                out.append(float(np.asarray(q) @ m.coef + m.intercept))
            yield pd.DataFrame({"id": pdf["qid"], name: out})

    return both.mapInPandas(run, f"id long, {name} double")


def prototype_fit(
    fit: DataFrame, df: DataFrame, clusters: int, k: int, reliability: str | None = None, keep: float = 0.8,
    comps: int = 4, alpha: float = 1.0, distance_comps: int = 10, name: str = "y_pred",
) -> DataFrame:
    """Queries clustered; each centre takes its k nearest reliable train rows, is fitted once, and
    predicts its cluster."""
    z = T.fit_pca(fit, distance_comps, scale=True)
    pool = fit
    if reliability:
        edge = quantile_values(fit, reliability, [1 - keep])[0]
        pool = fit.where(F.col(reliability) >= edge)
    asked = cluster(T.scores(df, z), T.scores(df, z), clusters)
    centres = asked.select("cluster", F.posexplode("x").alias("b", "v")).groupBy("cluster", "b").agg(F.avg("v").alias("v"))
    centres = centres.groupBy(F.col("cluster").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda s: s["v"]).alias("x")
    )
    rows = Nb.with_ref(Nb.knn(centres, T.scores(pool, z), k), pool, "x", "y").withColumn("w", 1.0 / F.greatest(F.col("d"), F.lit(1e-6)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["w"].to_numpy()
        m = local_line(np.vstack(pdf["x"].to_numpy()), pdf["y"].to_numpy(), w * len(w) / w.sum(), "ridge", comps, alpha)
        return pd.DataFrame({"cluster": [int(pdf["qid"].iloc[0])], "w": [list(m.coef)], "b": [m.intercept]})

    lines = rows.select("qid", "x", "y", "w").groupBy("qid").applyInPandas(run, "cluster long, w array<double>, b double")
    where = asked.select("id", "cluster").join(lines, "cluster")
    out = df.join(where, "id")
    return out.withColumn(name, A.dot(F.col("x"), F.col("w")) + F.col("b")).drop("w", "b")


# ---- routed fits -----------------------------------------------------------------------


def routed_fit(
    fit: DataFrame, df: DataFrame, clusters: int, rule: Callable[[Gram], So.Linear], comps: int = 5,
    min_rows: int = 40, transductive: bool = False, name: str = "y_pred",
) -> DataFrame:
    """A model per cluster with enough rows, else the global one. Clusters come from scaled PCA scores
    of the fit rows, or of both sides (``transductive``)."""
    both = fit.select("id", "x").unionByName(df.select("id", "x")) if transductive else fit
    z = T.fit_pca(both, comps, scale=True)
    model = KMeans(k=clusters, seed=42, featuresCol="features", predictionCol="cluster").fit(vectors(T.scores(both, z)))

    def label(part: DataFrame) -> DataFrame:
        placed = model.transform(vectors(T.scores(part, z, "__z").withColumn("__x", F.col("x")).withColumn("x", F.col("__z"))))
        return placed.withColumn("x", F.col("__x")).drop("features", "__x", "__z")

    table = gram_table(label(fit), "cluster")
    models = solve(table, {"": rule}, min_rows=min_rows)
    # A cluster without fit rows has no matrix; it gets the global model too.
    whole = rule(table.total())
    return predict_by(label(df), models, "cluster", "__own").transform(lambda d: predict(d, whole, "__all")).withColumn(name, F.coalesce("__own", "__all")).drop("__own", "__all")


def routed_selection(
    fit: DataFrame, cluster_col: str, rules: dict[str, Callable[[Gram], So.Linear]], inner: str = "fold_id",
    group: str = "grp", min_rows: int = 40,
) -> dict[str, tuple[str, So.Linear]]:
    """Per cluster the rule with the lowest rmse + 0.02 max |group bias| over inner folds. Errors of
    all rules come from one scan; matrices from another."""
    key = F.concat_ws("|", F.col(cluster_col).cast("string"), F.col(inner).cast("string"))
    keyed = fit.withColumn("__k", key)
    parts = gram_table(keyed, "__k")
    models = _inner_models(parts, rules, min_rows)
    long = predict_many(keyed, models, "__k", [cluster_col, group, "y"])
    long = long.withColumnsRenamed({"spec": "rule", "y_pred": "p"})
    e = F.col("p") - F.col("y")
    per = long.groupBy(cluster_col, "rule", group).agg(F.sum(e * e).alias("sse"), F.sum(e).alias("se"), F.count("*").alias("n"))
    table = per.groupBy(cluster_col, "rule").agg(
        (F.sqrt(F.sum("sse") / F.sum("n")) + F.max(F.abs(F.col("se") / F.col("n"))) * 0.02).alias("penalty")
    )
    best = table.groupBy(cluster_col).agg(F.min_by("rule", F.struct("penalty", "rule")).alias("rule"))
    # One row per cluster: its chosen rule, and the models of all rules on all its rows.
    whole = solve(gram_table(fit, cluster_col), rules)
    chosen = best.join(whole, best[cluster_col].cast("string") == whole["k"]).select(F.col("k"), "rule", F.filter("m", lambda m: m["spec"] == F.col("rule"))[0].alias("m"))
    return {r["k"]: (r["rule"], So.Linear(np.asarray(r["m"]["w"]), r["m"]["b"])) for r in chosen.collect()}


def _inner_models(parts: M.GramTable, rules: dict[str, Callable[[Gram], So.Linear]], min_rows: int) -> DataFrame:
    """Models for every (cluster | fold) key: on the cluster's other folds, or, where these have fewer than
    ``min_rows`` rows, on all other rows. A cluster's folds are solved in one task: their number is that of inner folds."""
    everything = parts.total()
    about, targets = parts.about, parts.targets
    held = parts.rows.sparkSession.sparkContext.broadcast(everything)

    def of_cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("spec", pa.string()), ("w", pa.list_(pa.float64())), ("b", pa.float64()), ("info", pa.string())]))

        def solved(group: list[tuple[str, Gram]]) -> Iterator[pa.RecordBatch]:
            whole = M.total(dict(group))
            for k, own in group:
                rest = whole - own
                g = rest if rest.n >= min_rows else held.value - own
                made = [{"spec": name, "w": (m := rule(g)).coef.tolist(), "b": float(m.intercept), "info": None} for name, rule in rules.items()]
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([g.n]), pa.array([made], kind)], names=["k", "n", "m"])

        group: list[tuple[str, Gram]] = []
        for k, g in M.each_gram(batches, about, targets):
            if group and group[0][0].split("|")[0] != k.split("|")[0]:
                yield from solved(group)
                group = []
            group.append((k, g))
        if group:
            yield from solved(group)

    cluster_of = F.substring_index("k", "|", 1)
    return parts.rows.repartition(cluster_of).sortWithinPartitions(cluster_of, "k").mapInArrow(of_cluster, "k string, n double, m array<struct<spec: string, w: array<double>, b: double, info: string>>")


def soft_clusters(
    fit: DataFrame, df: DataFrame, clusters: int, rule: Callable[[Gram], So.Linear], comps: int = 5, min_rows: int = 30, name: str = "y_pred"
) -> DataFrame:
    """Models per cluster mixed by the softmax of minus the distance to the centres."""
    z = T.fit_pca(fit, comps, scale=True)
    km = KMeans(k=clusters, seed=42, featuresCol="features", predictionCol="cluster").fit(vectors(T.scores(fit, z)))
    placed = km.transform(vectors(T.scores(fit, z, "__z").withColumn("__x", F.col("x")).withColumn("x", F.col("__z"))))
    table = gram_table(placed.withColumn("x", F.col("__x")).drop("features"), "cluster")
    own = {r["k"]: So.Linear(np.asarray(r["m"][0]["w"]), r["m"][0]["b"]) for r in solve(table, {"": rule}, min_rows=min_rows).collect()}
    models = [own[str(c)] if str(c) in own else rule(table.total()) for c in range(clusters)]
    scored = T.scores(df, z, "__z")
    centres = [[float(v) for v in c] for c in km.clusterCenters()]
    dist = F.array(*[-F.sqrt(A.total(F.zip_with("__z", A.doubles(c), lambda a, b: (a - b) * (a - b)))) for c in centres])
    scored = scored.withColumn("__w", S.softmax_array(dist))
    for c, m in enumerate(models):
        scored = predict(scored, m, f"__p{c}")
    value = A.dot(F.col("__w"), F.array(*[F.col(f"__p{c}") for c in range(clusters)]))
    return scored.withColumn(name, value).drop("__z", "__w", *[f"__p{c}" for c in range(clusters)])


def noise_average(
    fit: DataFrame, df: DataFrame, rule: Callable[[Gram], So.Linear], noise: Sequence[float] = (0.0, 0.003, 0.006, 0.010), name: str = "y_pred"
) -> DataFrame:
    """Mean of fits on perturbed copies; the copies of all scales are added up in one pass."""
    copies = None
    for k, s in enumerate(noise):
        part = fit if s == 0 else fit.withColumn("x", X.perturb(F.col("x"), F.col("id"), s, k))
        part = part.select("x", "y", F.lit(str(k)).alias("copy"))
        copies = part if copies is None else copies.unionByName(part)
    # One row per scale.
    models = [So.Linear(np.asarray(r["m"][0]["w"]), r["m"][0]["b"]) for r in solve(gram_table(copies, "copy"), {"": rule}).orderBy("k").collect()]
    return predict(df, average(models), name)
