"""Sample weights and domain scores (WGT)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from . import neighbours as Nb
from . import solvers as So
from . import targets as T
from .fits import cluster, vectors
from .folds import out_of_fold, predict
from .groups import centroids
from .moments import gram, total
from .ordered import percent_rank, quantile_values, quantiles, rank_position, tie_rank, with_stats
from .select import farthest_points

# ---- shapes ----------------------------------------------------------------------------


def mean_one(df: DataFrame, weight: str) -> DataFrame:
    """Divide by the mean weight."""
    return with_stats(df, [], F.avg(weight).alias("__wm")).withColumn(weight, F.col(weight) / F.col("__wm")).drop("__wm")


# Fixed values: (high edge, high weight, low edge, low weight) by percentile of the target.
PERCENTILE_VARIANTS = {
    "low110_high090": (0.80, 0.9, 0.20, 1.1),
    "low115_high085": (0.80, 0.85, 0.20, 1.15),
    "tail_low110_high080": (0.90, 0.8, 0.10, 1.1),
    "tail_low090_high110": (0.90, 1.1, 0.10, 0.9),
}


def percentile_weights(df: DataFrame, y: str, tie: str, variant: str, name: str = "w") -> DataFrame:
    """Tails of the target up or down, mean one."""
    hi, hi_w, lo, lo_w = PERCENTILE_VARIANTS[variant]
    ranked = percent_rank(df, y, tie, "__p")
    w = F.when(F.col("__p") <= lo, F.lit(lo_w)).when(F.col("__p") >= hi, F.lit(hi_w)).otherwise(1.0)
    return mean_one(ranked.withColumn(name, w).drop("__p"), name)


def tail_ramp(df: DataFrame, score: str, top: float) -> tuple[Column, float, float]:
    edge = quantile_values(df, score, [1.0 - top])[0]
    peak = df.agg(F.max(score).alias("m")).first()["m"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(score) - edge) / max(peak - edge, 1e-12))), edge, peak


def tail_weight(df: DataFrame, score: str, top: float, end: float, gamma: float, name: str = "w") -> DataFrame:
    """1 below the quantile, then a power ramp to ``end`` (below 1 for down, above 1 for up)."""
    if top <= 0:
        return df.withColumn(name, F.lit(1.0))
    ramp, _, _ = tail_ramp(df, score, top)
    return df.withColumn(name, 1.0 + F.pow(ramp, F.lit(gamma)) * (end - 1.0))


# Parts of the reliability score (raw residual, transformed residual, leverage,
# neighbour inconsistency).
RELIABILITY_MIXES = {
    "yj": {"yj": 1.0},
    "yj_lev": {"yj": 0.70, "lev": 0.30},
    "yj_nn20": {"yj": 0.70, "nn20": 0.30},
    "yj_lev_nn20": {"yj": 0.55, "lev": 0.25, "nn20": 0.20},
    "raw_yj_lev": {"raw": 0.35, "yj": 0.45, "lev": 0.20},
    "lev_nn20": {"lev": 0.55, "nn20": 0.45},
}


def reliability_score(df: DataFrame, mix: str, tie: str = "id", name: str = "score") -> DataFrame:
    """Weighted ordinal percentile ranks of the part columns."""
    out, total_ = df, None
    for part, w in RELIABILITY_MIXES[mix].items():
        out = rank_position(out, [], [part, tie], f"__r_{part}")
        term = F.col(f"__r_{part}") * w
        total_ = term if total_ is None else total_ + term
    return out.withColumn(name, total_).drop(*[f"__r_{p}" for p in RELIABILITY_MIXES[mix]])


def leverage(fit: DataFrame, df: DataFrame, k: int = 20, name: str = "lev") -> DataFrame:
    """Sum of squared scaled PCA scores."""
    z = T.fit_pca(fit, k, whiten=True)
    n = fit.count()
    # whitening uses n - 1, the scaling n
    return T.scores(df, z, "__z").withColumn(name, A.sum_squares(F.col("__z")) * n / max(n - 1, 1)).drop("__z")


def transformed_residual(df: DataFrame, fold: str, k: int = 20, alpha: float = 3500.0, name: str = "yj") -> DataFrame:
    """|target - prediction| in power space, out of fold; the power is refitted on every train side."""
    from .folds import out_of_fold_refit

    def fit_predict(fit: DataFrame, held: DataFrame) -> DataFrame:
        p = T.PowerTarget.fit(fit)
        model = So.pca_ridge(gram(fit.withColumn("y", p.apply(F.col("y"))))[None], k, alpha, scale=False)
        out = predict(held, model, "__p")
        return out.withColumn(name, F.abs(p.apply(F.col("y")) - F.col("__p"))).drop("__p")

    return out_of_fold_refit(df, fit_predict, fold)


def late_selection_weights(df: DataFrame, k: int, late: float, min_weight: float, gamma: float, name: str = "w") -> DataFrame:
    """Rows chosen late by the max-min order lose weight. The first k places are exact; rows after them
    are placed by their distance to the chosen rows, farthest first."""
    chosen = farthest_points(df, k)
    rows = {r["id"]: list(r["x"]) for r in df.where(F.col("id").isin(chosen)).select("id", "x").collect()}
    points = F.array(*[A.doubles(rows[c]) for c in chosen])
    dist = F.array_min(
        F.transform(points, lambda p: F.sqrt(A.total(F.zip_with("x", p, lambda a, b: (a - b) * (a - b)))))
    )
    place = F.create_map(*[v for j, c in enumerate(chosen) for v in (F.lit(c), F.lit(float(k - j)))])
    early = F.coalesce(place[F.col("id")], F.lit(0.0))
    ranked = rank_position(df.withColumn("__d", -dist).withColumn("__e", -early), [], ["__e", "__d", "id"], "__p")
    tail = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__p") - (1 - late)) / max(late, 1e-12)))
    out = ranked.withColumn(name, 1.0 - F.pow(tail, F.lit(gamma)) * (1 - min_weight)).drop("__d", "__e", "__p")
    return mean_one(out, name)


def balance_groups(df: DataFrame, weight: str, group: str = "grp") -> DataFrame:
    out = with_stats(df, [group], F.avg(weight).alias("__gm"))
    return out.withColumn(weight, F.when(F.col("__gm") > 0, F.col(weight) / F.col("__gm")).otherwise(F.col(weight))).drop("__gm")


def cap_groups(df: DataFrame, weight: str, cap: float, group: str = "grp") -> DataFrame:
    """Groups whose mean weight is over ``cap`` or under 2 - cap are scaled to it."""
    low = max(0.0, 2.0 - cap)
    out = with_stats(df, [group], F.avg(weight).alias("__gm"))
    m = F.col("__gm")
    factor = F.when(m > cap, F.lit(cap) / m)
    if low > 0:
        factor = factor.when(m < low, F.lit(low) / F.greatest(m, F.lit(1e-12)))
    return out.withColumn(weight, F.col(weight) * factor.otherwise(1.0)).drop("__gm")


def final_weights(df: DataFrame, weight: str) -> DataFrame:
    """Clip to [0.50, 1.35], then mean one."""
    return mean_one(df.withColumn(weight, F.greatest(F.least(weight, F.lit(1.35)), F.lit(0.50))), weight)


# ---- domain ----------------------------------------------------------------------------


def domain_classifier(train: DataFrame, test: DataFrame, k: int = 10, model: str = "logistic", name: str = "p_test") -> DataFrame:
    """Train-against-test classifier on latent scores; rows keep id, grp and domain."""
    from .sets import stack_domains

    both = stack_domains(train.select("id", "grp", "x"), test.select("id", "grp", "x"))
    low = T.scores(both, T.fit_pca(both, k, scale=True)).withColumn("label", (F.col("domain") == "test").cast("double"))
    return classify(low, low, "label", model, name).drop("label")


def classify(fit: DataFrame, df: DataFrame, label: str, model: str = "logistic", name: str = "score", c: float = 0.5, trees: int = 80, depth: int = 3, leaf: int = 20) -> DataFrame:
    """Probability of the positive label, classes balanced by weight. The penalty is 1 / (c * rows)."""
    sizes = fit.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
    n, p = sizes["n"], float(sizes["p"] or 0)
    if p in (0.0, float(n)):
        return df.withColumn(name, F.lit(p / max(n, 1)))
    w = F.when(F.col(label) > 0, F.lit(n / (2 * p))).otherwise(F.lit(n / (2 * (n - p))))
    if model == "logistic":
        clf = LogisticRegression(regParam=1.0 / (c * n), weightCol="__cw", maxIter=100)
    elif model == "forest":
        clf = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, weightCol="__cw", seed=42)
    else:
        raise ValueError(f"unknown classifier {model}")
    clf = clf.setFeaturesCol("features").setLabelCol("__y").setProbabilityCol("__prob").setRawPredictionCol("__raw").setPredictionCol("__cls")
    fitted = clf.fit(vectors(fit.withColumn("__cw", w).withColumn("__y", F.col(label).cast("double"))))
    out = fitted.transform(vectors(df))
    return out.withColumn(name, F.get(vector_to_array("__prob"), F.lit(1))).drop("features", "__prob", "__raw", "__cls")


def bounded_rank_weights(df: DataFrame, score: str, tie: str = "id", low: float = 0.65, high: float = 1.65, name: str = "w") -> DataFrame:
    """low .. high by average-tie rank, mean one."""
    out = with_stats(tie_rank(df, score, tie, "__t"), [], F.count("*").alias("__n"))
    out = out.withColumn(name, (F.col("__t") - 1) / F.greatest(F.col("__n") - 1, F.lit(1)) * (high - low) + low)
    return mean_one(out.drop("__t", "__n"), name)


def odds_weights(df: DataFrame, p: str, name: str = "w") -> DataFrame:
    """Odds over their mean, clipped to 0.2 .. 5."""
    safe = F.greatest(F.least(F.col(p), F.lit(1 - 1e-4)), F.lit(1e-4))
    out = with_stats(df.withColumn("__o", safe / (1 - safe)), [], F.avg("__o").alias("__m"))
    return out.withColumn(name, F.greatest(F.least(F.col("__o") / F.col("__m"), F.lit(5.0)), F.lit(0.2))).drop("__o", "__m")


def domain_group_weights(train: DataFrame, test: DataFrame) -> DataFrame:
    """(grp, dist, w): Gaussian of the distance from each train centroid to the nearest test centroid on
    standardised bands, bandwidth = median distance; weights sum to one."""
    both = train.select("x").unionByName(test.select("x"))
    mean, sd = T.standardise_fit(both)
    mid = lambda df: centroids(df).select(F.col("grp").cast("long").alias("id"), T.standardise(F.col("x"), mean, sd).alias("x"))
    near = Nb.knn(mid(train), mid(test), 1).select(F.col("qid").alias("grp"), (F.col("d") / len(mean) ** 0.5).alias("dist"))
    h = max(quantile_values(near, "dist", [0.5])[0], 1e-6)
    raw = near.withColumn("w", F.exp(F.pow(F.col("dist") / h, F.lit(2.0)) * -0.5))
    return with_stats(raw, [], F.sum("w").alias("__s")).withColumn("w", F.col("w") / F.col("__s")).drop("__s")


def domain_weighted_errors(oof: DataFrame, weights: DataFrame, pred: str = "y_pred", true: str = "y") -> DataFrame:
    """Group errors averaged with the group weights, next to the worst group."""
    e = F.col(pred) - F.col(true)
    per = oof.groupBy("grp").agg(F.avg(e * e).alias("mse"), F.avg(e).alias("bias")).join(weights.select("grp", "w"), "grp", "left")
    w = F.coalesce("w", F.lit(0.0))
    return per.agg(
        F.sqrt(F.sum(w * F.col("mse")) / F.sum(w)).alias("domain_rmse"),
        (F.sum(w * F.abs("bias")) / F.sum(w)).alias("domain_abs_bias"),
        F.sqrt(F.max("mse")).alias("worst_rmse"),
        F.max(F.abs("bias")).alias("worst_abs_bias"),
    )


def test_likeness(train: DataFrame, test: DataFrame, mode: str = "knn", k: int = 10, clusters: int = 8, comps: int = 10, name: str = "likeness") -> DataFrame:
    """(id, likeness): rank of nearness to test rows, to the test centroid, or of the test share of the
    row's cluster; ``knn_cluster`` averages two."""
    z = T.fit_pca(train, comps, scale=True)
    tr, te = T.scores(train, z), T.scores(test, z)
    parts = []
    if mode in ("knn", "knn_cluster"):
        parts.append(Nb.test_likeness(tr, te, k).withColumnRenamed("likeness", "s"))
    if mode == "centroid":
        mid = gram(te, None, [])[None].mean
        dist = F.sqrt(A.total(F.zip_with("x", A.doubles(mid), lambda a, b: (a - b) * (a - b))))
        parts.append(tr.select("id", (-dist).alias("s")))
    if mode in ("cluster", "knn_cluster"):
        both = tr.select("id", "x", F.lit(0).alias("t")).unionByName(te.select("id", "x", F.lit(1).alias("t")))
        placed = cluster(both, both, clusters)
        placed = with_stats(placed, ["cluster"], F.avg("t").alias("s"))
        parts.append(placed.where("t = 0").select("id", "s"))
    if not parts:
        raise ValueError(f"unknown mode {mode}")
    ranked = [percent_rank(p, "s", "id", "r").select("id", F.col("r").alias(f"r{j}")) for j, p in enumerate(parts)]
    out = ranked[0]
    for other in ranked[1:]:
        out = out.join(other, "id")
    value = sum(F.col(f"r{j}") for j in range(len(ranked))) / len(ranked)
    return out.select("id", value.alias(name))
