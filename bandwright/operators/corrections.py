"""Calibration, residual correction (COR) and blends (BLD) of stored predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars as S
from ..session import cut
from . import fits as Fi
from . import neighbours as Nb
from . import targets as T
from .groups import centroids, safe_corr
from .moments import mean_spectrum
from .ordered import join_on, percent_rank, quantile_values, with_stats
from .select import capped_top_fraction, first_rows, top_fraction


def residual(true: str = "y", pred: str = "p") -> Column:
    return F.col(true) - F.col(pred)


def limited(v: Column, clip: float | None) -> Column:
    return v if clip is None else S.clip(v, -clip, clip)


def add_delta(df: DataFrame, pred: str, delta: Column, clip: float | None, centre: bool, name: str, floor: float | None = None) -> DataFrame:
    """pred + clipped delta, the delta less its mean over all rows when asked."""
    out = df.withColumn("__d", limited(delta, clip))
    if centre:
        out = with_stats(out, [], F.avg("__d").alias("__dm")).withColumn("__d", F.col("__d") - F.col("__dm")).drop("__dm")
    value = F.col(pred) + F.col("__d")
    return out.withColumn(name, value if floor is None else F.greatest(value, F.lit(floor))).drop("__d")


# ---- affine and intercept --------------------------------------------------------------


def affine_fit(df: DataFrame, pred: str = "p", true: str = "y") -> tuple[float, float]:
    """(slope, intercept) of the target on the prediction; (1, mean gap) for a constant prediction."""
    r = df.agg(
        F.covar_pop(pred, true).alias("c"), F.var_pop(pred).alias("v"), F.avg(pred).alias("mp"), F.avg(true).alias("mt")
    ).first()
    if r["v"] is None or r["v"] <= 1e-12:
        return 1.0, (r["mt"] or 0.0) - (r["mp"] or 0.0)
    slope = r["c"] / r["v"]
    return slope, r["mt"] - slope * r["mp"]


def shrunk_affine(df: DataFrame, shrink: float, pred: str = "p", true: str = "y") -> tuple[float, float]:
    """Affine pulled towards the identity."""
    a, b = affine_fit(df, pred, true)
    return 1.0 + shrink * (a - 1.0), shrink * b


def intercept_shift(df: DataFrame, pred: str = "p", true: str = "y") -> float:
    return df.agg(F.avg(residual(true, pred)).alias("m")).first()["m"] or 0.0


def affine_delta(fit: DataFrame, df: DataFrame, shrink: float, clip: float | None, centre: bool = True, pred: str = "p", name: str = "out") -> DataFrame:
    """delta = shrink (a + b p - p), clipped, less its mean."""
    b, a = affine_fit(fit, pred)
    return add_delta(df, pred, (F.lit(a) + F.col(pred) * b - F.col(pred)) * shrink, clip, centre, name)


# ---- bins and tails --------------------------------------------------------------------


def bin_residual_table(fit: DataFrame, bins: int, statistic: str = "mean", pred: str = "p", true: str = "y") -> list[tuple[float, float]]:
    """(mean prediction, mean or median residual) per quantile bin of the prediction; a bounded list."""
    edges = sorted(set(quantile_values(fit, pred, [k / bins for k in range(bins + 1)])))
    binned = fit.withColumn("__bin", S.bin_by_edges(F.col(pred), edges[1:-1])).withColumn("__r", residual(true, pred))
    per = binned.groupBy("__bin").agg(F.avg(pred).alias("c"), F.avg("__r").alias("v"))
    if statistic == "median":
        from .ordered import quantiles

        per = per.drop("v").join(quantiles(binned, "__r", [0.5], ["__bin"]).withColumnRenamed("q0", "v"), "__bin")
    return [(r["c"], r["v"]) for r in per.orderBy("c").collect()]


def interpolate(v: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through a short list of points, ends held."""
    value = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points[:-1], points[1:]))):
        value = F.when(v < x1, F.lit(float(y0)) + (v - x0) * ((y1 - y0) / max(x1 - x0, 1e-300))).otherwise(value)
    return F.when(v <= points[0][0], F.lit(float(points[0][1]))).otherwise(value)


def bin_correction(
    fit: DataFrame, df: DataFrame, bins: int, shrink: float, clip: float | None, statistic: str = "mean", centre: bool = False, pred: str = "p", name: str = "out"
) -> DataFrame:
    points = bin_residual_table(fit, bins, statistic, pred)
    delta = interpolate(F.col(pred), points) if len(points) >= 2 else F.lit(intercept_shift(fit, pred))
    return add_delta(df, pred, delta * shrink, clip, centre, name)


def low_tail(fit: DataFrame, df: DataFrame, q: float, factor: float, pred: str = "p", name: str = "out") -> DataFrame:
    """Below a quantile of the fitted predictions the distance to it is stretched."""
    edge = quantile_values(fit, pred, [q])[0]
    p = F.col(pred)
    return df.withColumn(name, F.when(p < edge, (p - edge) * factor + edge).otherwise(p))


def upper_tail(fit: DataFrame, df: DataFrame, q: float, boost: float, lo: float, hi: float, pred: str = "p", name: str = "out") -> DataFrame:
    edge = quantile_values(fit, pred, [q])[0]
    p = F.col(pred)
    return df.withColumn(name, S.clip(F.when(p > edge, p + (p - edge) * boost).otherwise(p), lo, hi))


def mean_shift(df: DataFrame, train_mean: float, ratio: float, lo: float, hi: float, pred: str = "p", name: str = "out") -> DataFrame:
    """All rows moved by a share of the gap between the train mean and the prediction mean."""
    out = with_stats(df, [], F.avg(pred).alias("__m"))
    return out.withColumn(name, S.clip(F.col(pred) + (F.lit(train_mean) - F.col("__m")) * ratio, lo, hi)).drop("__m")


# ---- groups and domains ----------------------------------------------------------------


def nearest_group_bias(fit: DataFrame, df: DataFrame, pred: str = "p", true: str = "y", clip: bool = True, name: str = "out") -> DataFrame:
    """Add the mean residual of the nearest train group (cosine of mean spectra)."""
    bias = fit.groupBy(F.col("grp").alias("train_grp")).agg(F.avg(residual(true, pred)).alias("__bias"))
    table = Fi.nearest_group_map(fit, df).join(bias, "train_grp", "left").select(F.col("test_grp").alias("grp"), "__bias")
    value = F.col(pred) + F.coalesce("__bias", F.lit(0.0))
    if clip:
        value = S.clip(value, *Fi.y_range(fit, true))
    return join_on(df, table, ["grp"]).withColumn(name, value).drop("__bias")


def align_means(fit: DataFrame, df: DataFrame, weight: float) -> DataFrame:
    """Test bands moved by a share of the gap to the train means."""
    a, b = mean_spectrum(fit), mean_spectrum(df)
    shift = A.doubles([weight * (t - r) for r, t in zip(a, b)])
    return df.withColumn("x", F.zip_with("x", shift, lambda v, s: v - s))


def cluster_bias(fit: DataFrame, df: DataFrame, clusters: int, shrink: float, clip: float, value: str = "r", name: str = "corr") -> DataFrame:
    """Shrunk, clipped mean residual of the row's cluster; clusters come from the fit rows."""
    means = Fi.cluster(fit, fit, clusters).groupBy("cluster").agg(F.avg(value).alias("__v"))
    out = join_on(Fi.cluster(fit, df, clusters), means, ["cluster"])
    return out.withColumn(name, S.clip(F.coalesce("__v", F.lit(0.0)) * shrink, -clip, clip)).drop("__v")


def local_residual(fit: DataFrame, df: DataFrame, k: int, kind: str = "mean", value: str = "r", quality: str | None = None, name: str = "signal") -> DataFrame:
    """(id, signal): neighbours' residuals as a weighted mean, a median, or a local ridge or PLS."""
    if kind in ("ridge", "pls"):
        return Fi.local_fit(fit, df, k, kind, name=name, value=value)
    near = Nb.with_ref(Nb.knn(df, fit, k), fit, value, *([quality] if quality else []))
    if kind == "median":
        out = near.groupBy("qid").agg(F.percentile(value, F.lit(0.5)).alias(name))
    else:
        w = 1.0 / F.greatest(F.col("d"), F.lit(1e-6))
        if quality:
            w = w * F.col(quality)
        out = near.groupBy("qid").agg((F.sum(w * F.col(value)) / F.sum(w)).alias(name))
    return out.withColumnRenamed("qid", "id")


# ---- distillation ----------------------------------------------------------------------


def beta(df: DataFrame, signal: str, resid: str, lo: float = -1.0, hi: float = 1.0, gate: Column | None = None, min_rows: int = 0) -> float:
    """s.r / s.s over the gated rows, clipped; 0 for a vanishing signal or too few rows."""
    part = df if gate is None else df.where(gate)
    s, r = F.col(signal), F.col(resid)
    row = part.agg(F.sum(s * r).alias("sr"), F.sum(s * s).alias("ss"), F.count("*").alias("n")).first()
    if row["n"] < max(min_rows, 1) or (row["ss"] or 0.0) < 1e-12:
        return 0.0
    return float(min(max(row["sr"] / row["ss"], lo), hi))


def distil(fit: DataFrame, df: DataFrame, signal: str, resid: str, shrink: float, clip: float, centre: bool = True, pred: str = "p", name: str = "out") -> DataFrame:
    """Move the prediction along a branch signal by the share the residuals support."""
    return add_delta(df, pred, F.col(signal) * (shrink * beta(fit, signal, resid)), clip, centre, name, 0.0)


def distil_two(
    fit: DataFrame, df: DataFrame, first: tuple[str, float, float], second: tuple[str, float, float], resid: str, total_clip: float, pred: str = "p", name: str = "out"
) -> DataFrame:
    """Two clipped corrections (signal, shrink, clip) added, clipped again and centred."""
    total = None
    for signal, shrink, clip in (first, second):
        part = limited(F.col(signal) * (shrink * beta(fit, signal, resid)), clip)
        total = part if total is None else total + part
    return add_delta(df, pred, total, total_clip, True, name, 0.0)


# ---- gates -----------------------------------------------------------------------------


def gate_columns(df: DataFrame, anchor: str, signal: str, iso: str, high_q: float, disagree_q: float, iso_q: float) -> dict[str, Column]:
    """Named gates from three quantile thresholds."""
    sized = df.withColumn("__a", F.abs(signal))
    high = F.col(anchor) >= quantile_values(df, anchor, [high_q])[0]
    disagree = F.abs(signal) >= quantile_values(sized, "__a", [disagree_q])[0]
    isolated = F.col(iso) >= quantile_values(df, iso, [iso_q])[0]
    return {
        "high": high,
        "disagree": disagree,
        "iso": isolated,
        "high_disagree": high & disagree,
        "high_iso": high & isolated,
        "high_or_disagree": high | disagree,
        "high_disagree_iso": high & disagree & isolated,
    }


def limit_gate(df: DataFrame, gate: str, priority: str, tie: str, max_frac: float) -> DataFrame:
    """Keep at most floor(n * max_frac) gated rows, largest priority first."""
    df = cut(df)
    first = first_rows(df.where(gate), priority, tie, max(1, int(df.count() * max_frac)))
    return df.withColumn(gate, F.col(gate) & first)


def gated_correction(
    df: DataFrame, gate: Column, anchor: str, signal: str, resid: str, shrink: float, clip: float, max_frac: float, tie: str = "id", name: str = "out"
) -> DataFrame:
    """Correction on a size-limited gate; the coefficient needs ten gated rows and is not negative."""
    out = limit_gate(df.withColumn("gate", gate), "gate", anchor, tie, max_frac)
    b = beta(out, signal, resid, 0.0, float("inf"), F.col("gate"), 10)
    move = F.when(F.col("gate"), S.clip(F.col(signal) * (shrink * b), -clip, clip)).otherwise(0.0)
    return out.withColumn(name, F.greatest(F.col(anchor) + move, F.lit(0.0)))


def rank_product(df: DataFrame, cols: Sequence[str], tie: str = "id", name: str = "score") -> DataFrame:
    """Product of average-tie percentile ranks."""
    out, value = df, None
    for c in cols:
        out = percent_rank(out, c, tie, f"__k_{c}")
        value = F.col(f"__k_{c}") if value is None else value * F.col(f"__k_{c}")
    return out.withColumn(name, value).drop(*[f"__k_{c}" for c in cols])


# Parts whose percentile ranks are multiplied, by gate mode.
GATE_MODES = {
    "hard_pos_impact": ("hard", "pos", "size"),
    "hard_domain_impact": ("hard", "dom", "size"),
    "pos_domain_impact": ("pos", "dom", "rise"),
    "high_pos_impact": ("high", "pos", "rise"),
    "detector": ("detector",),
    "impact_abs": ("detector", "size"),
    "impact_signed_pos": ("detector", "rise"),
    "signed_pos": ("detector", "signed"),
    "signed_impact_abs": ("detector", "signed", "size"),
    "signed_impact_pos": ("detector", "signed", "rise"),
}


def gate_score(df: DataFrame, mode: str, signal: str, tie: str = "id", name: str = "score") -> DataFrame:
    ready = df.withColumn("size", F.abs(signal)).withColumn("rise", F.greatest(F.col(signal), F.lit(0.0)))
    return rank_product(ready, GATE_MODES[mode], tie, name).drop("size", "rise")


def parse_gate_mode(mode: str) -> tuple[str, int | None, float | None]:
    """``sign_signal[_detNN][_clusterC]`` as sign, cap and detector share."""
    parts = mode.split("_")
    cap = next((int(p[7:]) for p in parts if p.startswith("cluster")), None)
    share = next((int(p[3:]) / 100 for p in parts if p.startswith("det")), None)
    return parts[0], cap, share


def signal_gate(df: DataFrame, signal: str, mode: str, frac: float, label: str, detector: str | None = None, tie: str = "id", name: str = "gate") -> DataFrame:
    sign, cap, share = parse_gate_mode(mode)
    s = F.col(signal)
    score = {"abs": F.abs(s), "positive": F.greatest(s, F.lit(0.0)), "negative": F.greatest(-s, F.lit(0.0))}[sign]
    out = df
    if share is not None:
        if detector is None:
            raise ValueError("this gate mode needs a detector column")
        out = top_fraction(out, detector, tie, share, "__dg")
        score = F.when(F.col("__dg"), score).otherwise(0.0)
    out = out.withColumn("__sc", score)
    if cap is None:
        out = top_fraction(out, "__sc", tie, frac, name)
    else:
        out = capped_top_fraction(out, "__sc", tie, label, frac, cap, name)
    return out.drop("__sc", "__dg")


def capped_candidate(
    df: DataFrame, signal: str, resid: str, mode: str, frac: float, shrink: float, clip: float, label: str, detector: str | None = None, tie: str = "id", name: str = "corr"
) -> DataFrame:
    """Gated, clipped, centred correction whose sign is flipped when it runs against the residuals."""
    b = beta(df, signal, resid)
    gated = signal_gate(df, signal, mode, frac, label, detector, tie)
    raw = F.when(F.col("gate"), S.clip(F.col(signal) * (shrink * b), -clip, clip))
    out = with_stats(gated.withColumn("__raw", raw), [], F.avg("__raw").alias("__m"))
    out = out.withColumn(name, F.coalesce(F.col("__raw") - F.col("__m"), F.lit(0.0))).drop("__raw", "__m")
    agree = out.where("gate").agg(safe_corr(name, resid).alias("c")).first()["c"] or 0.0
    return out.withColumn(name, F.col(name) * (-1.0 if agree < 0 else 1.0))


def soft_correction(
    df: DataFrame, signals: Sequence[str], resid: str, shrink: float, clip: float, signal_power: float, detector: str | None = None,
    detector_power: float = 1.0, agree: bool = False, centre: bool = True, tie: str = "id", name: str = "corr",
) -> DataFrame:
    """All rows move: mean of the branch corrections, weighted by powers of ranks."""
    parts = [F.col(s) * beta(df, s, resid) for s in signals]
    raw = sum(parts[1:], parts[0]) / len(parts)
    if agree and len(parts) > 1:
        signs = [F.signum(p) for p in parts]
        raw = raw * F.abs(sum(signs[1:], signs[0]) / len(parts))
    out = df.withColumn("__raw", raw).withColumn("__size", F.abs(raw))
    out = percent_rank(out, "__size", tie, "__w")
    weight = F.pow("__w", F.lit(signal_power))
    if detector:
        out = percent_rank(out, detector, tie, "__dw")
        weight = weight * F.pow("__dw", F.lit(detector_power))
    out = out.withColumn(name, S.clip(F.col("__raw") * weight * shrink, -clip, clip)).drop("__raw", "__size", "__w", "__dw")
    if centre:
        out = with_stats(out, [], F.avg(name).alias("__m")).withColumn(name, F.col(name) - F.col("__m")).drop("__m")
    live = out.where(F.abs(name) > 0.002).agg(safe_corr(name, resid).alias("c")).first()["c"] or 0.0
    return out.withColumn(name, F.col(name) * (-1.0 if live < 0 else 1.0))


def region_score(
    df: DataFrame, proximity: str, signal: str, prox_power: float, signal_power: float, failed: str | None = None, detector: str | None = None,
    skip: Column | None = None, tie: str = "id", name: str = "score",
) -> DataFrame:
    """proximity^a x rank(|signal|)^b, times (1 - failed)^1.5 and the detector rank when given."""
    out = percent_rank(df.withColumn("__size", F.abs(signal)), "__size", tie, "__r")
    value = F.pow(proximity, F.lit(prox_power)) * F.pow("__r", F.lit(signal_power))
    if failed:
        value = value * F.pow(1.0 - F.col(failed), F.lit(1.5))
    if detector:
        out = percent_rank(out, detector, tie, "__dr")
        value = value * F.col("__dr")
    if skip is not None:
        value = F.when(skip, F.lit(0.0)).otherwise(value)
    return out.withColumn(name, value).drop("__size", "__r", "__dr")


def vote_blend(
    long: DataFrame, min_agree: int, top_n: int, shrink: float, clip: float, median: bool = True, two_sided: bool = False, name: str = "corr"
) -> DataFrame:
    """Rows (candidate, id, diff): sign votes per id, median or mean of the agreeing changes, the best
    ``top_n`` ids with enough votes."""
    d = F.col("diff")
    votes = long.groupBy("id").agg(
        F.sum((d > 1e-12).cast("int")).alias("up"),
        F.sum((d < -1e-12).cast("int")).alias("down"),
        F.percentile(F.when(d > 0, d), F.lit(0.5)).alias("med_up"),
        F.percentile(F.when(d < 0, d), F.lit(0.5)).alias("med_down"),
        F.avg(F.when(d > 0, d)).alias("avg_up"),
        F.avg(F.when(d < 0, d)).alias("avg_down"),
        F.count("*").alias("n"),
    )
    rises = F.col("up") >= F.col("down")
    stat = "med" if median else "avg"
    signal = F.coalesce(F.when(rises, F.col(f"{stat}_up")).otherwise(F.col(f"{stat}_down")), F.lit(0.0))
    agree = F.greatest("up", "down")
    rows = votes.select("id", signal.alias("signal"), agree.alias("agree"), (F.abs(signal) * agree / F.col("n")).alias("score"))
    fit = rows.where(F.col("agree") >= min_agree)

    def best(part: DataFrame, n: int) -> DataFrame:
        return part.orderBy(F.col("score").desc(), "id").limit(n)

    if two_sided:
        half = max(1, top_n // 2)
        chosen = best(fit.where("signal > 1e-12"), half).unionByName(best(fit.where("signal < -1e-12"), top_n - half))
    else:
        chosen = best(fit, top_n)
    return chosen.withColumn(name, S.clip(F.col("signal") * shrink, -clip, clip))


def continuation(a: Column, b: Column, alpha: float) -> Column:
    """Further along the change from a to b."""
    return b + (b - a) * alpha


# ---- blends ----------------------------------------------------------------------------


def blend(base: Column, other: Column, weight: float, lo: float | None = None, hi: float | None = None) -> Column:
    """base + weight (other - base); the weight may be negative."""
    return S.clip(base + (other - base) * weight, lo, hi)


def means_of_variants(long: DataFrame, weights: dict[str, str | None]) -> DataFrame:
    """Rows (variant, id, pred): plain (None) and weighted means per id by name, in one aggregate."""
    aggs = [F.avg("pred") if w is None else F.sum(F.col("pred") * F.col(w)) / F.sum(w) for w in weights.values()]
    return long.groupBy("id").agg(*[a.alias(name) for name, a in zip(weights, aggs)])


def mean_of_variants(long: DataFrame, weight: str | None = None, name: str = "pred") -> DataFrame:
    """Rows (variant, id, pred): plain or weighted mean per id."""
    return means_of_variants(long, {name: weight})
