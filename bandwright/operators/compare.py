"""Experiment ranking and estimation of an external score from local ones (CMP)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import weight_from_name
from .groups import safe_corr
from .moments import gram, spectra_matrix
from .ordered import join_on, tie_rank

# Names of the validation strategies, composite weights, denied name parts and the
# weights (leave one group out, group folds, random folds) of the predictor families.
STRATEGIES = ("leave_one_species", "group_species", "random", "target_stratified")
COMPOSITE_WEIGHTS = (0.5, 0.3, 0.2)
DENIED = ("group_curve", "meta_monotonic", "topk_quantile", "clip", "lowtail", "low_tail")
FAMILY_WEIGHTS = {
    "estimated_anchor_snv_diff1": (0.55, 0.25, 0.20),
    "estimated_simple_linear": (0.35, 0.35, 0.30),
    "estimated_complex": (0.15, 0.35, 0.50),
}
ANCHOR_PREDICTORS = (
    "single_feature_linear", "single_feature_loo_consensus_wavelength", "single_feature_loo_rmse_wavelength",
    "single_feature_second_wavelength", "single_feature_linear_oof_intercept", "single_feature_stable_wavelength",
)
COMPLEX_MARKERS = (
    "group_curve", "meta_monotonic", "topk_", "topk6", "topk8", "topk12", "topk24", "pls_", "pls4", "pls6", "hgbdt",
)
PROXY_MIN_ROWS, PROXY_RANGE = 5, (5.0, 50.0)


def weighted_mean(parts: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean over the parts that are present; null when none is."""
    total = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in zip(parts, weights)), F.lit(0.0))
    value = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in zip(parts, weights)), F.lit(0.0))
    return F.when(total > 0, value / total)


def composite(shift: Column, proxy: Column, worst: Column) -> Column:
    return weighted_mean([shift, proxy, worst], COMPOSITE_WEIGHTS)


def latest_scores(log: DataFrame, strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """Latest score per experiment and strategy, one column per strategy."""
    last = log.groupBy("experiment", "strategy").agg(
        F.max_by("mean_score", F.struct("timestamp", "run_id")).alias("score")
    )
    return last.groupBy("experiment").pivot("strategy", list(strategies)).agg(F.first("score"))


def family(name: Column, predictor: Column, preprocessor: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, predictor, preprocessor))
    return (
        F.when(predictor.isin(*ANCHOR_PREDICTORS) & (preprocessor == "spectral_snv_diff1"), "estimated_anchor_snv_diff1")
        .when(predictor == "single_feature_linear", "estimated_simple_linear")
        .when(text.rlike("|".join(COMPLEX_MARKERS)), "estimated_complex")
        .otherwise("estimated_median")
    )


def median3(parts: Sequence[Column]) -> Column:
    """Median of the present values."""
    held = F.array_sort(F.filter(F.array(*parts), lambda v: v.isNotNull()))
    n = F.size(held)
    mid = F.floor(n / 2).cast("int")
    return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, F.get(held, mid)).otherwise(
        (F.get(held, F.greatest(mid - 1, F.lit(0))) + F.get(held, mid)) / 2
    )


def estimate(df: DataFrame) -> DataFrame:
    """Score and its source: measured, else on the quadratic path, else the fitted proxy, else the family
    weights, else the median. Columns measured, quadratic, fitted and family may hold nulls."""
    parts = [F.col("leave_one_species"), F.col("group_species"), F.col("random")]
    by_family = F.lit(None).cast("double")
    for name, weights in FAMILY_WEIGHTS.items():
        by_family = F.when(F.col("family") == name, weighted_mean(parts, weights)).otherwise(by_family)
    by_family = F.when(F.col("family") == "estimated_median", median3(parts)).otherwise(by_family)
    chain = [
        (F.col("measured"), F.lit("measured")),
        (F.col("quadratic"), F.lit("public_feedback_quadratic")),
        (F.col("fitted"), F.lit("fitted")),
        (by_family, F.col("family")),
    ]
    source = F.lit("missing")
    for value, label in reversed(chain):
        source = F.when(value.isNotNull(), label).otherwise(source)
    return df.withColumn("estimate", F.coalesce(*[v for v, _ in chain])).withColumn("source", source)


def quadratic_path(points: DataFrame, weight: str = "w", score: str = "score") -> tuple[float, float, float] | None:
    """(a, b, c) of score^2 = a w^2 + b w + c by least squares; needs three rows."""
    w, s2 = F.col(weight), F.col(score) * F.col(score)
    row = points.agg(
        F.count("*").alias("n"), *[F.sum(F.pow(w, F.lit(float(k)))).alias(f"p{k}") for k in range(1, 5)],
        *[F.sum(F.pow(w, F.lit(float(k))) * s2).alias(f"q{k}") for k in range(3)],
    ).first()
    if row["n"] < 3:
        return None
    p = [float(row["n"]), row["p1"], row["p2"], row["p3"], row["p4"]]
    m = np.array([[p[4], p[3], p[2]], [p[3], p[2], p[1]], [p[2], p[1], p[0]]])
    return tuple(float(v) for v in np.linalg.lstsq(m, np.array([row["q2"], row["q1"], row["q0"]]), rcond=None)[0])


def on_path(weight: Column, coef: tuple[float, float, float] | None) -> Column:
    if coef is None:
        return F.lit(None).cast("double")
    sq = weight * weight * coef[0] + weight * coef[1] + coef[2]
    return F.when(sq > 0, F.sqrt(sq))


def fit_proxy(measured: DataFrame, features: Sequence[str], target: str = "measured") -> list[float] | None:
    """Intercept and coefficients of the measured score on local scores; missing inputs count as 0, and
    rows without any are left out. None under five rows."""
    held = measured.where(F.col(target).isNotNull() & F.coalesce(*[F.col(f) for f in features]).isNotNull())
    x = F.array(*[F.coalesce(F.col(f), F.lit(0.0)) for f in features])
    rows = held.select(x.alias("x"), F.col(target).alias("y"))
    if rows.limit(PROXY_MIN_ROWS).count() < PROXY_MIN_ROWS:
        return None
    g = gram(rows)[None]
    coef = np.linalg.lstsq(g.sxx, g.sxy(), rcond=None)[0]
    return [float(g.y_mean() - coef @ g.mean), *[float(c) for c in coef]]


def proxy_score(model: list[float] | None, features: Sequence[str]) -> Column:
    if model is None:
        return F.lit(None).cast("double")
    value = F.lit(model[0])
    for f, c in zip(features, model[1:]):
        value = value + F.coalesce(F.col(f), F.lit(0.0)) * c
    any_input = F.coalesce(*[F.col(f) for f in features]).isNotNull()
    return F.when(any_input & value.between(*PROXY_RANGE), value)


def denied(name: Column, predictor: Column) -> Column:
    return F.lower(F.concat_ws(" ", name, predictor)).rlike("|".join(DENIED))


def ranked(df: DataFrame, n: int | None = None) -> DataFrame:
    """Denied rows last, then the estimate, then the leave-one-group-out score."""
    out = df.orderBy(
        F.col("denied").cast("int"), F.col("estimate").asc_nulls_last(), F.col("leave_one_species").asc_nulls_last(), "experiment"
    )
    return out if n is None else out.limit(n)


def ridge_audit(df: DataFrame, features: Sequence[str], target: str, key: str, alpha: float = 1.0) -> DataFrame:
    """Leave-one-out estimate of every row by ridge on scaled features: the matrix of all rows less the
    row's own part, solved in the task that holds the row."""
    rows = df.select(F.col(key).alias("k"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(target).cast("double").alias("y"))
    g = gram(rows)[None]
    shared = df.sparkSession.sparkContext.broadcast(g)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = shared.value
        for b in batches:
            if b.num_rows == 0:
                continue
            x, y = spectra_matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False)
            out = np.empty(len(x))
            for j in range(len(x)):
                v = np.concatenate([[1.0], x[j] - whole.about, [y[j]]])
                m = whole.m - np.outer(v, v)
                n, s, t = m[0, 0], m[0, 1:-1], m[0, -1]
                xx = m[1:-1, 1:-1] - np.outer(s, s) / n
                sd = np.sqrt(np.maximum(np.diag(xx) / n, 0.0))
                sd = np.where(sd < 1e-12, 1.0, sd)
                w = np.linalg.solve(xx / np.outer(sd, sd) + alpha * np.eye(len(s)), (m[1:-1, -1] - s * t / n) / sd)
                out[j] = t / n + ((x[j] - whole.about - s / n) / sd) @ w
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), pa.array(out)], names=[key, "measured", "estimate"])

    return rows.mapInArrow(run, f"{key} {kind}, measured double, estimate double").withColumn("error", F.col("estimate") - F.col("measured"))


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("n"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))


def metric_alignment(df: DataFrame, metrics: Sequence[str], target: str = "measured", key: str = "experiment", min_rows: int = 3) -> DataFrame:
    """Pearson and Spearman of each local metric with the measured score, and the mean rank error."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    long = df.where(F.col(target).isNotNull()).select(key, F.col(target).alias("t"), F.explode(pairs).alias("s")).select(key, "t", "s.*").where("v IS NOT NULL")
    ranked_ = tie_rank(tie_rank(long, "v", key, "rv", ["metric"]), "t", key, "rt", ["metric"])
    return ranked_.groupBy("metric").agg(
        F.count("*").alias("n"), safe_corr("v", "t").alias("pearson"), safe_corr("rv", "rt").alias("spearman"),
        F.avg(F.abs(F.col("rv") - F.col("rt"))).alias("rank_error"),
    ).where(F.col("n") >= min_rows)


def recommended_metric(alignment: DataFrame) -> DataFrame:
    """Highest positive correlation; without one, the smallest in size."""
    positive = F.col("pearson") > 0
    key = F.struct((~positive).alias("a"), F.when(positive, -F.col("pearson")).otherwise(F.abs("pearson")).alias("b"), "metric")
    return alignment.agg(F.min_by("metric", key).alias("metric"))
