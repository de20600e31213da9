"""Target and feature transforms fitted on data (TGT)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import features as X
from ..functions import scalars as S
from . import solvers as So
from .groups import centroids
from .moments import Gram, gram, spectra_matrix
from .ordered import join_on, ordinal, value_counts, with_stats

POWER_FAMILIES = {
    "yeo_johnson": (S.yeo_johnson, S.yeo_johnson_inverse),
    "box_cox": (S.box_cox, S.box_cox_inverse),
}


# ---- target ----------------------------------------------------------------------------


class PowerTarget:
    """Power transform of the target by maximum likelihood (or with a given lambda), standardised."""

    def __init__(self, family: str, lam: float, mean: float, sd: float):
        self.family, self.lam, self.mean, self.sd = family, lam, mean, sd

    @classmethod
    def fit(cls, df: DataFrame, y: str = "y", family: str = "yeo_johnson", lam: float | None = None) -> "PowerTarget":
        forward = POWER_FAMILIES[family][0]
        if family == "box_cox" and df.where(F.col(y) <= 0).limit(1).count():
            raise ValueError("Box-Cox needs a positive target")
        if lam is None:
            lam = best_lambda(df, y, family)
        row = df.agg(
            F.avg(forward(F.col(y), lam)).alias("m"), F.stddev_pop(forward(F.col(y), lam)).alias("s")
        ).first()
        return cls(family, lam, row["m"], row["s"] or 1.0)

    def apply(self, y: Column) -> Column:
        return (POWER_FAMILIES[self.family][0](y, self.lam) - self.mean) / self.sd

    def invert(self, t: Column) -> Column:
        return POWER_FAMILIES[self.family][1](t * self.sd + self.mean, self.lam)


def best_lambda(df: DataFrame, y: str, family: str, lo: float = -2.0, hi: float = 4.0, rounds: int = 5, reach: float = 512.0) -> float:
    """The lambda of the highest likelihood: a grid in one aggregate per round. While the best one lies at an end of
    the interval, the interval doubles beyond that end, up to ``reach``; then it narrows around the best."""
    forward = POWER_FAMILIES[family][0]
    c = F.col(y)
    jac = F.signum(c) * F.log1p(F.abs(c)) if family == "yeo_johnson" else F.log(c)
    narrowed = 0
    while True:
        grid = np.linspace(lo, hi, 13)
        row = df.agg(
            F.count(y).alias("n"),
            F.sum(jac).alias("j"),
            *[F.var_pop(forward(c, float(v))).alias(f"v{k}") for k, v in enumerate(grid)],
        ).first()
        like = [_likelihood(row["n"], row["j"], row[f"v{k}"], v) for k, v in enumerate(grid)]
        best, width = int(np.argmax(like)), hi - lo
        if not narrowed and best == 12 and hi < reach:
            lo, hi = hi - width / 12, min(hi + 2 * width, reach)
            continue
        if not narrowed and best == 0 and lo > -reach:
            lo, hi = max(lo - 2 * width, -reach), lo + width / 12
            continue
        narrowed += 1
        # A wider interval takes more rounds to come down to the same step.
        if narrowed >= rounds and width / 12 <= 6.0 / 12 / 6 ** (rounds - 1) * 1.001:
            return float(grid[best])
        step = grid[1] - grid[0]
        lo, hi = grid[best] - step, grid[best] + step


def _likelihood(n: int, jacobian: float, variance: float | None, lam: float) -> float:
    """Profile likelihood; a transform that overflows, or that leaves no spread, cannot be the best."""
    if variance is None or not math.isfinite(variance) or variance <= 0:
        return -math.inf
    return -0.5 * n * math.log(variance) + (lam - 1) * jacobian


def log_target(y: Column) -> Column:
    return F.log1p(y)


def log_target_inverse(t: Column) -> Column:
    return F.expm1(t)


def sqrt_target(y: Column) -> Column:
    return F.sqrt(F.greatest(y, F.lit(0.0)))


def sqrt_target_inverse(t: Column) -> Column:
    return F.pow(F.greatest(t, F.lit(0.0)), F.lit(2.0))


# ---- quantile normal -------------------------------------------------------------------

CUT = 1e-7


def quantile_table(df: DataFrame, value: str, m: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, j, q): m evenly spaced exact quantiles per key. The ranks needed are joined to the
    ranked rows by number."""
    ranked = ordinal(df.select(*keys, F.col(value).alias("__v")), keys, ["__v"], "__r")
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("__n"))
    need = sizes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn(
        "__h", (F.col("__n") - 1) * F.col("j") / float(m - 1)
    )
    need = need.withColumn("__part", F.col("__h") - F.floor("__h")).withColumn(
        "__r", F.explode(F.array_distinct(F.array(F.floor("__h"), F.ceil("__h"))))
    )
    hit = need.join(ranked, [*keys, "__r"])
    lo, hi = F.min("__v"), F.max("__v")
    return hit.groupBy(*keys, "j").agg((lo + (hi - lo) * F.max("__part")).alias("q"))


def interpolator(table: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """Place of values among the quantiles of a row of ``table``; ties take the middle of their run."""
    ref = np.linspace(0.0, 1.0, table.shape[1])

    def place(v: np.ndarray, row: int) -> np.ndarray:
        q = table[row]
        up = np.interp(v, q, ref)
        down = np.interp(-v, -q[::-1], -ref[::-1])
        return np.clip(0.5 * (up - down), CUT, 1 - CUT)

    return place


def quantile_normal_target(df: DataFrame, y: str, name: str, m: int | None = 1000) -> DataFrame:
    """Normal scores of a value's place among ``m`` quantiles of all rows. With None every row is a quantile: the
    place is then a count of rows up to the last equal one, joined by value, and no list of values is held."""
    if m is None:
        held = df.where(F.col(y).isNotNull())
        n = held.count()
        share = F.when(F.col("__vu") == F.col("__vn"), 0.0).otherwise((F.col("__vu") - 1) / float(max(n - 1, 1)))
        places = value_counts(held, y).select(y, S.clip(share, CUT, 1 - CUT).alias("__p"))
        return join_on(df, places, [y]).withColumn(name, S.normal_quantile(F.col("__p"))).drop("__p")
    m = int(min(m, df.count()))
    rows = quantile_table(df, y, m).orderBy("j").collect()
    table = np.asarray([[r["q"] for r in rows]])

    @F.pandas_udf("double")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(interpolator(table)(v.to_numpy(float), 0))

    return df.withColumn(name, S.normal_quantile(place(y)))


def quantile_normal_bands(fit: DataFrame, df: DataFrame, m: int = 1000) -> DataFrame:
    """Every band mapped through the quantiles of the fit rows to normal scores."""
    m = int(min(m, fit.count()))
    long = fit.select(F.posexplode("x").alias("band", "v"))
    rows = quantile_table(long, "v", m, ["band"]).collect()
    d = max(r["band"] for r in rows) + 1
    table = np.zeros((d, m))
    for r in rows:
        table[r["band"], r["j"]] = r["q"]
    shared = df.sparkSession.sparkContext.broadcast(table)
    others = [c for c in df.columns if c != "x"]

    @F.pandas_udf("array<double>")
    def place(xs: pd.Series) -> pd.Series:
        mat = np.vstack(xs.to_numpy())
        fn = interpolator(shared.value)
        return pd.Series(list(np.column_stack([fn(mat[:, b], b) for b in range(mat.shape[1])])))

    return df.select(*others, place("x").alias("x")).withColumn("x", F.transform("x", S.normal_quantile))


# ---- features --------------------------------------------------------------------------


def standardise(x: Column, mean: Sequence[float], sd: Sequence[float]) -> Column:
    centred = F.zip_with(x, A.doubles(mean), lambda a, b: a - b)
    return F.zip_with(centred, A.doubles(sd), lambda a, b: a / b)


def standardise_fit(df: DataFrame, ddof: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation per band (floored at 1e-12 of variance for ddof 1, 1 for a constant else)."""
    n1 = F.stddev_samp("v") if ddof else F.stddev_pop("v")
    rows = df.select(F.posexplode("x").alias("band", "v")).groupBy("band").agg(F.avg("v").alias("m"), n1.alias("s")).collect()
    rows.sort(key=lambda r: r["band"])
    sd = np.asarray([r["s"] for r in rows], dtype=float)
    sd = np.maximum(sd, 1e-6) if ddof else np.where(sd < 1e-12, 1.0, sd)
    return np.asarray([r["m"] for r in rows]), sd


def scores(df: DataFrame, z: So.Latent, name: str = "x", x: str = "x") -> DataFrame:
    """Latent scores of every row, one matrix product per Arrow batch."""
    mat, off = np.ascontiguousarray(z.matrix), z.offset
    shared = df.sparkSession.sparkContext.broadcast((mat, off))
    return _map_rows(df, lambda v: v @ shared.value[0] + shared.value[1], name, x)


def _map_rows(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], name: str, x: str) -> DataFrame:
    """Replace or add an array column computed from the matrix of a batch."""
    kept = [c for c in df.columns if c != name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name)
    ddl = f"{schema}, `{name}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            out = np.ascontiguousarray(fn(spectra_matrix(b.column(x))))
            flat = pa.array(out.reshape(-1), pa.float64())
            offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
            arrays = [b.column(c) for c in kept] + [pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, name])

    return df.select(*df.columns).mapInArrow(run, ddl)


def fit_pca(df: DataFrame, k: int, scale: bool = False, whiten: bool = False) -> So.Latent:
    return So.pca(gram(df, None, [])[None], k, scale, whiten)


def pca_scores(fit: DataFrame, df: DataFrame, k: int, scale: bool = False, whiten: bool = False, name: str = "x") -> DataFrame:
    return scores(df, fit_pca(fit, k, scale, whiten), name)


def latent_shape(fit: DataFrame, df: DataFrame, n_bands: int, k: int = 18, weight: float = 0.5, anchor: str | None = None) -> DataFrame:
    """PCA scores joined with scaled shape features times ``weight``, optionally the anchor prediction."""
    shape = lambda d: d.withColumn("x", X.shape_features(F.col("x"), n_bands, 14))
    mean, sd = standardise_fit(shape(fit))
    out = df.withColumn("__s", X.shape_features(F.col("x"), n_bands, 14))
    out = scores(out, fit_pca(fit, k), "__z")
    extra = F.transform(standardise(F.col("__s"), mean, sd), lambda v: v * weight)
    parts = [F.col("__z"), extra] + ([F.array(anchor)] if anchor else [])
    return out.withColumn("x", F.concat(*parts)).drop("__s", "__z")


def multiview_pca(fit: DataFrame, df: DataFrame, views: dict[str, Callable[[Column], Column]], comps: int = 4) -> DataFrame:
    """Each view scaled and reduced to a few components, then joined."""
    out = df
    names = []
    for name, fn in views.items():
        z = fit_pca(fit.withColumn("x", fn(F.col("x"))), comps, scale=True)
        out = scores(out.withColumn("__v", fn(F.col("x"))), z, f"__z_{name}", x="__v").drop("__v")
        names.append(f"__z_{name}")
    return out.withColumn("x", F.concat(*names)).drop(*names)


# ---- removing components ---------------------------------------------------------------


def project_out(directions: np.ndarray) -> np.ndarray:
    """Map x - sum (x.l) l for orthonormal columns l."""
    return np.eye(directions.shape[0]) - directions @ directions.T


def remove(df: DataFrame, directions: np.ndarray, mean: np.ndarray, name: str = "x", x: str = "x") -> DataFrame:
    """Components taken out of the centred spectrum, the mean put back."""
    mat = project_out(directions)
    shared = df.sparkSession.sparkContext.broadcast((mat, mean))
    return _map_rows(df, lambda v: (v - shared.value[1]) @ shared.value[0] + shared.value[1], name, x)


def orthogonal_directions(g: Gram, k: int, drop: int) -> np.ndarray:
    """The ``drop`` of k principal components least correlated with the target."""
    z = So.pca(g, k)
    corr = np.abs(So.band_corr(So.latent_gram(g, z)))
    return z.loadings[:, np.argsort(corr, kind="stable")[:drop]]


def domain_directions(df: DataFrame, known: Column, k: int, drop: int, mode: str = "shift", group: str = "grp") -> tuple[np.ndarray, np.ndarray]:
    """(Directions, mean of all rows): components by domain shift between the rows that are ``known`` and the others,
    by shift over target correlation, by spread of group centroids, or the domain mean direction itself."""
    sides = gram(df, known)
    a, b = sides["true"], sides["false"]
    gap = b.mean - a.mean
    if mode == "mean":
        return (gap / max(np.linalg.norm(gap), 1e-12))[:, None], (a + b).mean
    z = So.pca(a + b, k)
    sd = np.sqrt(np.maximum(z.variance, 1e-12))
    shift = np.abs(gap @ z.loadings) / sd
    if mode == "ratio":
        score = shift / np.maximum(np.abs(So.band_corr(So.latent_gram(a, z))), 1e-3)
    elif mode == "centroid":
        # Centroids are scored where they are; their spread is one number per component.
        scored = scores(centroids(df, [group]), z)
        spread = scored.select(F.posexplode("x").alias("c", "v")).groupBy("c").agg(F.stddev_pop("v").alias("s")).collect()
        score = np.asarray([r["s"] for r in sorted(spread, key=lambda r: r["c"])]) / sd
    elif mode == "shift":
        score = shift
    else:
        raise ValueError(f"unknown mode {mode}")
    return z.loadings[:, np.argsort(-score, kind="stable")[:drop]], (a + b).mean


# ---- random features -------------------------------------------------------------------


def random_features(df: DataFrame, d: int, width: int, seed: int, kind: str = "fourier", gamma: float = 0.1) -> DataFrame:
    """Seeded hidden layer: cosine of a Gaussian projection, or tanh of a scaled one."""
    rng = np.random.default_rng(seed)
    if kind == "fourier":
        w = rng.normal(0.0, math.sqrt(2 * gamma), size=(d, width))
        b = rng.uniform(0.0, 2 * math.pi, size=width)
    elif kind == "tanh":
        w = rng.normal(0.0, 1.0 / math.sqrt(d), size=(d, width))
        b = rng.normal(0.0, 0.5, size=width)
    else:
        raise ValueError(f"unknown kind {kind}")
    shared = df.sparkSession.sparkContext.broadcast((w, b))

    def layer(v: np.ndarray) -> np.ndarray:
        h = v @ shared.value[0] + shared.value[1]
        return math.sqrt(2.0 / width) * np.cos(h) if kind == "fourier" else np.tanh(h)

    return _map_rows(df, layer, "x", "x")


def random_feature_fit(
    fit: DataFrame, df: DataFrame, width: int, alpha: float, seeds: Sequence[int], kind: str = "fourier", gamma: float = 0.1, id_col: str = "id"
) -> DataFrame:
    """Ridge on seeded random features of scaled bands, predictions averaged over the seeds."""
    from .folds import predict

    mean, sd = standardise_fit(fit)
    d = len(mean)
    scaled = lambda part: part.withColumn("x", standardise(F.col("x"), mean, sd))
    fit_s, df_s = scaled(fit), scaled(df)
    out = None
    for s in seeds:
        model = So.ridge(gram(random_features(fit_s, d, width, s, kind, gamma))[None], alpha, scale=False)
        part = predict(random_features(df_s, d, width, s, kind, gamma), model).select(id_col, F.lit(s).alias("seed"), "y_pred")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(id_col).agg(F.avg("y_pred").alias("y_pred"), F.stddev_pop("y_pred").alias("seed_sd"))
