"""Hard-case detectors and outlier scores (DET)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import cut
from . import neighbours as Nb
from . import targets as T
from .folds import out_of_fold_refit
from .moments import spectra_matrix
from .ordered import percent_rank, quantile_values
from .weights import classify


def hard_labels(df: DataFrame, y: str = "y", pred: str = "y_pred") -> DataFrame:
    """Label columns: top residual, positive hard, high target, under-predicted high."""
    r = F.col(y) - F.col(pred)
    base = df.withColumn("__a", F.abs(r))
    e70, e80 = quantile_values(base, "__a", [0.70, 0.80])
    y80, p70 = quantile_values(base, y, [0.80])[0], quantile_values(base, pred, [0.70])[0]
    return base.withColumns(
        {
            "hard80": (F.col("__a") >= e80).cast("int"),
            "poshard70": ((r > 0) & (F.col("__a") >= e70)).cast("int"),
            "high80": (F.col(y) >= y80).cast("int"),
            "under_high": ((r > 0) & (F.col(pred) >= p70)).cast("int"),
        }
    ).drop("__a")


def branch_win(df: DataFrame, y: str = "y", anchor: str = "anchor", branch: str = "branch", name: str = "win") -> DataFrame:
    """1 where the branch beats the anchor by more than max(1.0, 8 % of the anchor error)."""
    a, b = F.abs(F.col(y) - F.col(anchor)), F.abs(F.col(y) - F.col(branch))
    return df.withColumn(name, (b + F.greatest(F.lit(1.0), a * 0.08) < a).cast("int"))


def detector_features(df: DataFrame, pred: str, signals: Sequence[str], tie: str = "id") -> DataFrame:
    """Array ``x`` of prediction, signals, their sizes and percentile ranks."""
    out = percent_rank(df, pred, tie, "__rp")
    cols = [F.col(pred), F.abs(pred), F.col("__rp")]
    sizes = []
    for s in signals:
        out = percent_rank(out.withColumn(f"__abs_{s}", F.abs(s)), f"__abs_{s}", tie, f"__rank_{s}")
        cols += [F.col(s), F.col(f"__abs_{s}"), F.col(f"__rank_{s}")]
        sizes.append(F.col(f"__abs_{s}"))
    cols.append(F.greatest(*sizes) if len(sizes) > 1 else sizes[0])
    cols.append(sum(sizes) / len(sizes))
    out = out.withColumn("x", F.array(*cols))
    return out.drop("__rp", *[f"__abs_{s}" for s in signals], *[f"__rank_{s}" for s in signals])


def detector_scores(fit: DataFrame, df: DataFrame | None, label: str, fold: str = "fold_id", model: str = "logistic", name: str = "score") -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold score of the fit rows and full score of ``df``, on standardised features."""

    def fit_predict(a: DataFrame, b: DataFrame) -> DataFrame:
        mean, sd = T.standardise_fit(a)
        scaled = lambda d: d.withColumn("x", T.standardise(F.col("x"), mean, sd))
        return classify(scaled(a), scaled(b), label, model, name, c=0.2)

    return out_of_fold_refit(fit, fit_predict, fold), None if df is None else fit_predict(fit, df)


# ---- outliers --------------------------------------------------------------------------


def pca_residual(fit: DataFrame, df: DataFrame, k: int, name: str = "q_resid") -> DataFrame:
    """Squared distance of the scaled spectrum to the latent plane."""
    z = T.fit_pca(fit, k, scale=True)
    shared = df.sparkSession.sparkContext.broadcast((z.mean, z.scale, z.loadings))

    def left(v: np.ndarray) -> np.ndarray:
        mean, sd, load = shared.value
        s = (v - mean) / sd
        r = s - (s @ load) @ load.T
        return (r * r).sum(1, keepdims=True)

    return T._map_rows(df, left, "__q", "x").withColumn(name, F.get("__q", F.lit(0))).drop("__q")


def local_outlier_factor(fit: DataFrame, df: DataFrame, k: int = 35, name: str = "lof") -> DataFrame:
    """(id, lof): density of the neighbours over own density, from three neighbour joins. ``fit`` rows
    are the population; queries are scored against it."""
    own = cut(Nb.knn(fit, fit, k, no_self=True))
    reach = own.groupBy("qid").agg(F.max("d").alias("kd"))
    kd = reach.select(F.col("qid").alias("rid"), "kd")

    def density(pairs: DataFrame) -> DataFrame:
        r = F.greatest(F.col("d"), F.col("kd"))
        return pairs.join(kd, "rid").groupBy("qid").agg((1.0 / (F.avg(r) + 1e-10)).alias("lrd"))

    lrd = cut(density(own))
    asked = cut(Nb.knn(df, fit, k))
    mine = density(asked).withColumnRenamed("lrd", "own")
    around = asked.join(lrd.select(F.col("qid").alias("rid"), "lrd"), "rid").groupBy("qid").agg(F.avg("lrd").alias("near"))
    return mine.join(around, "qid").select(F.col("qid").alias("id"), (F.col("near") / F.col("own")).alias(name))


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One isolation tree as rows (feature, cut, left, right, length of a leaf)."""
    nodes: list[tuple] = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(())
        part = x[idx]
        lo, hi = part.min(0), part.max(0)
        live = np.flatnonzero(hi > lo)
        if depth >= limit or len(idx) <= 1 or len(live) == 0:
            nodes[me] = (-1, 0.0, -1, -1, depth + average_path(len(idx)))
            return me
        f = int(rng.choice(live))
        c = float(rng.uniform(lo[f], hi[f]))
        go = part[:, f] < c
        a, b = build(idx[go], depth + 1), build(idx[~go], depth + 1)
        nodes[me] = (f, c, a, b, 0.0)
        return me

    build(np.arange(len(x)), 0)
    return nodes


def isolation_score(fit: DataFrame, df: DataFrame, trees: int = 250, sample: int = 256, seed: int = 42, name: str = "iso") -> DataFrame:
    """Isolation forest: every tree is grown in its own group from its own sample of ``sample`` rows, and
    the trees (a bounded table) are broadcast to score all rows."""
    n = fit.count()
    size = min(sample, n)
    # a tree takes the rows whose hash for that tree is lowest among an expected few times its size
    share = min(1.0, 4.0 * size / max(n, 1))
    h = lambda t: F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    tree_ids = F.sequence(F.lit(0), F.lit(trees - 1))
    picked = fit.select("id", "x", F.explode(F.filter(tree_ids, lambda t: h(t) < share)).alias("tree"))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("id")
        rng = np.random.default_rng([seed, t])
        take = rng.permutation(len(pdf))[:size]
        x = np.vstack(pdf["x"].to_numpy()[take])
        nodes = grow(x, rng, int(np.ceil(np.log2(max(size, 2)))))
        cols = list(zip(*nodes))
        return pd.DataFrame(
            {"tree": t, "f": [list(map(int, cols[0]))], "c": [list(map(float, cols[1]))], "l": [list(map(int, cols[2]))], "r": [list(map(int, cols[3]))], "v": [list(map(float, cols[4]))]}
        )

    ddl = "tree int, f array<int>, c array<double>, l array<int>, r array<int>, v array<double>"
    forest = picked.groupBy("tree").applyInPandas(plant, ddl).orderBy("tree").collect()
    shared = df.sparkSession.sparkContext.broadcast(
        [tuple(np.asarray(row[k]) for k in ("f", "c", "l", "r", "v")) for row in forest]
    )
    norm = average_path(size)

    def run(v: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(v))
        for f, c, left, right, length in shared.value:
            at = np.zeros(len(v), dtype=int)
            while True:
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = v[np.arange(len(v)), np.where(inner, f[at], 0)] < c[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            depth += length[at]
        return np.power(2.0, -depth / len(shared.value) / max(norm, 1e-12))[:, None]

    return T._map_rows(df, run, "__i", "x").withColumn(name, F.get("__i", F.lit(0))).drop("__i")


def outlier_score(fit: DataFrame, df: DataFrame, k: int = 20, neighbours: int = 20, lof_k: int = 35, trees: int = 250, name: str = "outlier") -> DataFrame:
    """(id, parts, outlier): mean percentile rank of PCA residual, neighbour distance, local outlier
    factor and isolation score."""
    z = T.fit_pca(fit, k, scale=True)
    low_fit, low = cut(T.scores(fit.select("id", "x"), z)), cut(T.scores(df.select("id", "x"), z))
    out = pca_residual(fit, df.select("id", "x"), k).select("id", "q_resid")
    near = Nb.mean_distance(Nb.knn(low, low_fit, neighbours), "nn_dist").withColumnRenamed("qid", "id")
    lof = local_outlier_factor(low_fit, low, lof_k)
    iso = isolation_score(low_fit, low, trees).select("id", "iso")
    out = cut(out.join(near, "id").join(lof, "id").join(iso, "id"))
    parts = ("q_resid", "nn_dist", "lof", "iso")
    for p in parts:
        out = percent_rank(out, p, "id", f"__r_{p}")
    value = sum(F.col(f"__r_{p}") for p in parts) / len(parts)
    return out.withColumn(name, value).drop(*[f"__r_{p}" for p in parts])
