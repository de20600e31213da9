"""Comparison of prediction sets with an anchor: drift, guards and gates (DRF).

Input is one long table (candidate, id, grp, anchor, pred); every measure is a grouped aggregate over
it, so all candidates are measured in the same scan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import centroids, decile_delta, fold_deltas, safe_corr
from .moments import gram
from .neighbours import nearest_groups
from .ordered import join_on, quantiles

KEY = ["candidate"]


def diff() -> Column:
    return F.col("pred") - F.col("anchor")


def anchor_diff(long: DataFrame, changed: float = 1e-9) -> DataFrame:
    """rmse, largest and mean change, correlation, changed rows, prediction summary, negatives."""
    d, p = diff(), F.col("pred")
    base = long.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(d * d)).alias("diff_rmse"),
        F.max(F.abs(d)).alias("diff_max_abs"),
        F.avg(d).alias("diff_mean"),
        safe_corr("pred", "anchor").alias("corr"),
        F.sum((F.abs(d) > changed).cast("bigint")).alias("changed_rows"),
        F.min(p).alias("pred_min"),
        F.avg(p).alias("pred_mean"),
        F.max(p).alias("pred_max"),
        F.sum((p < 0).cast("bigint")).alias("negative_count"),
    )
    mid = quantiles(long, "pred", [0.5], KEY).withColumnRenamed("q0", "pred_median")
    return join_on(base, mid, KEY)


def _group_sums(long: DataFrame) -> DataFrame:
    return long.groupBy(*KEY, "grp").agg(
        F.count("*").cast("double").alias("n"),
        F.avg("pred").alias("mp"),
        F.avg("anchor").alias("mb"),
        F.var_pop("pred").alias("vp"),
        F.var_pop("anchor").alias("vb"),
        F.var_pop(diff()).alias("vd"),
        F.covar_pop(diff(), F.col("anchor")).alias("c"),
        F.min("pred").alias("lo"),
        F.max("pred").alias("hi"),
        F.sum((F.col("pred") < 0).cast("bigint")).alias("neg"),
    )


def _aligned_mse(vp: Column, vb: Column, vd: Column, c: Column) -> Column:
    """Mean square of (scaled and centred prediction) - (centred anchor). Written with the variance of the
    change and its covariance with the anchor, which stay exact when the change is small."""
    r = F.sqrt(vb) / F.greatest(F.sqrt(vp), F.lit(1e-12))
    return F.greatest(r * r * vd + (r - 1) * (r - 1) * vb + r * (r - 1) * c * 2, F.lit(0.0))


def drift_table(long: DataFrame) -> DataFrame:
    """Difference to the anchor raw and after mean, mean+deviation, group mean and group mean+deviation
    alignment. All follow from one aggregate by candidate and group; no row is read twice."""
    per = _group_sums(long)
    n, w = F.sum("n"), F.col("n")
    whole = per.groupBy(*KEY).agg(
        n.alias("n"),
        (F.sum(w * F.col("mp")) / n).alias("pm"),
        (F.sum(w * F.col("mb")) / n).alias("bm"),
        F.max(F.abs(F.col("mp") - F.col("mb"))).alias("max_group_shift"),
        F.sqrt(F.sum(w * F.col("vd")) / n).alias("group_mean_rmse"),
        F.sqrt(F.sum(w * _aligned_mse(*map(F.col, ("vp", "vb", "vd", "c")))) / n).alias("group_mean_std_rmse"),
        F.min("lo").alias("pred_min"),
        F.max("hi").alias("pred_max"),
        F.sum("neg").alias("pred_neg"),
    )
    both = join_on(per, whole.select(*KEY, F.col("n").alias("n_all"), "pm", "bm"), KEY)
    dp, db = F.col("mp") - F.col("pm"), F.col("mb") - F.col("bm")
    spread = both.groupBy(*KEY).agg(
        (F.sum(w * (F.col("vp") + dp * dp)) / F.max("n_all")).alias("vp"),
        (F.sum(w * (F.col("vb") + db * db)) / F.max("n_all")).alias("vb"),
        (F.sum(w * (F.col("vd") + (dp - db) * (dp - db))) / F.max("n_all")).alias("vd"),
        (F.sum(w * (F.col("c") + (dp - db) * db)) / F.max("n_all")).alias("c"),
    )
    out = join_on(whole, spread, KEY)
    bias = F.col("pm") - F.col("bm")
    flat = (F.col("vp") <= 1e-24) | (F.col("vb") <= 1e-24)
    return out.select(
        *KEY,
        F.sqrt(F.col("vd") + bias * bias).alias("raw_diff_rmse"),
        bias.alias("bias"),
        F.sqrt("vd").alias("mean_rmse"),
        F.sqrt(_aligned_mse(*map(F.col, ("vp", "vb", "vd", "c")))).alias("mean_std_rmse"),
        "group_mean_rmse",
        "group_mean_std_rmse",
        "max_group_shift",
        F.when(~flat, (F.col("c") + F.col("vb")) / F.sqrt(F.col("vp") * F.col("vb"))).alias("corr_to_anchor"),
        F.col("pm").alias("pred_mean"),
        "pred_min",
        "pred_max",
        "pred_neg",
    )


def group_drift(long: DataFrame) -> DataFrame:
    """The by-group table behind it."""
    d = diff()
    return long.groupBy(*KEY, "grp").agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_shift"), F.sqrt(F.avg(d * d)).alias("diff_rmse"),
        F.stddev_pop("pred").alias("pred_sd"), F.stddev_pop("anchor").alias("anchor_sd"),
    )


def reasons(rules: Sequence[tuple[Column, str]], sep: str, none: str) -> Column:
    """Texts of the rules that hold, joined; ``none`` when there are none."""
    text = F.concat_ws(sep, *[F.when(c, F.lit(t)) for c, t in rules])
    return F.when(text == "", F.lit(none)).otherwise(text)


def drift_decision(table: DataFrame) -> DataFrame:
    """Rule decision and rough guard score of a drift table."""
    c = F.col
    rules = [
        (c("raw_diff_rmse") > 10, "reject_raw_drift"),
        (F.abs("bias") > 5, "reject_global_bias"),
        (c("max_group_shift") > 12, "reject_species_shift"),
        (c("group_mean_std_rmse") > 6, "reject_shape_drift"),
        (c("pred_neg") > 0, "warn_negative"),
    ]
    score = (
        c("raw_diff_rmse") * 0.12 + F.abs("bias") * 0.18 + c("max_group_shift") * 0.18 + F.abs("bias") * 0.08 + c("pred_neg") * 0.20 + 16.151771
    )
    return table.withColumn("decision", reasons(rules, ";", "pass_guard")).withColumn("guard_score", score)


def top_moves(long: DataFrame, n: int = 10) -> DataFrame:
    """The n largest moves per candidate (ties: higher id)."""
    w = Window.partitionBy(*KEY).orderBy(F.abs(diff()).desc(), F.col("id").desc())
    return long.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def top_concentration(long: DataFrame, n: int = 10, moved: float | None = None) -> DataFrame:
    """Most rows of one group among the n largest moves."""
    top = top_moves(long, n)
    if moved is not None:
        top = top.where(F.abs(diff()) > moved)
    return top.groupBy(*KEY, "grp").agg(F.count("*").alias("c")).groupBy(*KEY).agg(F.max("c").alias("top_group_count"))


def failure_guard(long: DataFrame, bad: DataFrame, order: str = "id") -> DataFrame:
    """Likeness of a change to a known bad change ``bad`` (id, bad_diff), decile gap, range, concentration,
    reject reasons and risk."""
    both = long.join(bad, "id").withColumn("d", diff())
    d = F.col("d")
    base = both.groupBy(*KEY).agg(
        F.sqrt(F.avg(d * d)).alias("diff_rmse"),
        F.max(F.abs(d)).alias("diff_max_abs"),
        safe_corr("d", "bad_diff").alias("bad_corr"),
        safe_corr("d", order).alias("order_corr"),
        ((F.max("pred") - F.min("pred")) / (F.max("anchor") - F.min("anchor"))).alias("range_ratio"),
        F.sum((F.col("pred") < 0).cast("bigint")).alias("negative_count"),
    )
    shift = long.groupBy(*KEY, "grp").agg(F.avg(diff()).alias("m")).groupBy(*KEY).agg(F.max(F.abs("m")).alias("group_shift"))
    gap = decile_delta(long, "anchor", "pred", KEY).select(*KEY, (F.col("top_delta") - F.col("bottom_delta")).alias("decile_gap"))
    out = base
    for other in (shift, gap, top_concentration(long)):
        out = join_on(out, other, KEY)
    c = F.col
    off_range = (c("range_ratio") < 0.92) | (c("range_ratio") > 1.08)
    rules = [
        (c("diff_rmse") < 0.03, "near_anchor"),
        (c("diff_rmse") > 1.00, "anchor_diff_gt1"),
        (c("diff_max_abs") > 3.00, "max_diff_gt3"),
        (c("group_shift") > 0.35, "species_shift_gt0p35"),
        (c("bad_corr") > 0.60, "bad_alpha3000_corr_gt0p60"),
        (F.abs("decile_gap") > 0.50, "decile_gap_gt0p50"),
        (c("top_group_count") >= 5, "top10_species_concentration"),
        (off_range, "range_shift"),
        (c("negative_count") > 0, "negative"),
    ]
    risk = (
        F.greatest(c("bad_corr"), F.lit(0.0)) * 2.0 + F.abs("decile_gap") * 0.8 + F.abs("order_corr") * 0.7 + c("group_shift") * 0.8
        + c("diff_max_abs") * 0.08 + F.when(c("top_group_count") >= 5, 0.5).otherwise(0.0) + F.when(off_range, 0.4).otherwise(0.0)
    )
    return out.withColumn("reject_reasons", reasons(rules, "|", "pass")).withColumn("risk", risk)


# Thresholds of the correction gate.
Q5_GATE = {
    "changed": (16, 28), "rmse": (0.006, 0.020), "max_diff": 0.16, "group_shift": 0.008, "per_group": 6, "top10": 3,
    "oof": -0.0035, "groups": 9, "gate_corr": 0.30, "new_rows": 6, "increment_corr": 0.80, "overlap": 0.65, "prior_corr": 0.75,
}


def candidate_diagnostics(test: DataFrame, oof: DataFrame, clip: float, prior: str = "prior", increment: str = "increment") -> DataFrame:
    """One wide aggregate per candidate. ``test`` holds (candidate, id, grp, anchor, pred, prior, increment)
    with the earlier correction and the earlier increment of the row; ``oof`` holds (candidate, grp,
    y_true, anchor, pred) of the fit rows."""
    d = diff()
    t = test.withColumn("d", d).withColumn("moved", F.abs(d) > 1e-12)
    m, p, q = F.col("moved"), F.abs(prior) > 1e-12, F.abs(increment) > 1e-12

    def count(c: Column) -> Column:
        return F.sum(c.cast("bigint"))

    n = F.greatest(count(m), F.lit(1))
    dd = F.col("d")
    base = t.groupBy(*KEY).agg(
        count(m).alias("changed_count"),
        count(F.col("pred") < 0).alias("negative_count"),
        F.sqrt(F.avg(dd * dd)).alias("diff_rmse"),
        F.max(F.abs(dd)).alias("diff_max_abs"),
        count(m & ~p).alias("new_changed_count"),
        count(m & p).alias("repeated_changed_count"),
        (count(m & p) / n).alias("prior_overlap_frac"),
        safe_corr("d", prior).alias("prior_corr"),
        safe_corr("d", increment).alias("increment_corr"),
        (count(m & q) / n).alias("increment_overlap_frac"),
        count(m & ~q).alias("increment_new_count"),
        F.coalesce(F.avg(F.when(m & p, F.abs(dd))), F.lit(0.0)).alias("prior_rows_mean_abs"),
        F.coalesce(F.avg(F.when(m & ~p, F.abs(dd))), F.lit(0.0)).alias("new_rows_mean_abs"),
        (count(m & (F.abs(dd) >= clip - 1e-12)) / n).alias("clip_saturation_frac"),
        F.coalesce(F.avg(F.when(m, (dd > 0).cast("double"))), F.lit(0.0)).alias("positive_frac"),
    )
    per = t.groupBy(*KEY, "grp").agg(F.avg("d").alias("s"), count(m).alias("c")).groupBy(*KEY).agg(
        F.max(F.abs("s")).alias("group_shift"), F.max("c").alias("group_max_count")
    )
    fit = oof.withColumn("pred", F.greatest("pred", F.lit(0.0)))
    e = lambda c: F.sqrt(F.avg((F.col(c) - F.col("y_true")) * (F.col(c) - F.col("y_true"))))
    gate = F.abs(diff()) > 1e-12
    quality = fit.withColumn("__g", F.when(gate, diff())).withColumn("__r", F.when(gate, F.col("y_true") - F.col("anchor")))
    quality = quality.groupBy(*KEY).agg(
        e("pred").alias("oof_rmse"), (e("pred") - e("anchor")).alias("oof_delta"), safe_corr("__g", "__r").alias("gate_corr")
    )
    folds = fold_deltas(fit, KEY).select(*KEY, "improved_count", "group_count", "worst_delta")
    out = base
    for other in (per, top_concentration(test), quality, folds):
        out = join_on(out, other, KEY)
    return out


def candidate_gate(table: DataFrame, limits: dict = Q5_GATE) -> DataFrame:
    """Reject reasons and pass/reject from a table of thresholds."""
    c, g = F.col, limits
    rules = [
        (c("negative_count") > 0, "negative"),
        (~c("changed_count").between(*g["changed"]), "changed_count"),
        (~c("diff_rmse").between(*g["rmse"]), "slot1_diff_range"),
        (c("diff_max_abs") > g["max_diff"], "max_diff"),
        (c("group_shift") > g["group_shift"], "species_shift"),
        (c("group_max_count") > g["per_group"], "species_concentration"),
        (c("top_group_count") > g["top10"], "top10_species"),
        (c("clip_saturation_frac") > 0, "clip_saturation"),
        (c("oof_delta") > g["oof"], "weak_oof"),
        (c("improved_count") < g["groups"], "weak_groups"),
        (c("gate_corr") < g["gate_corr"], "bad_signal_corr"),
        (c("increment_new_count") < g["new_rows"], "too_few_q5_new_rows"),
        (F.abs("increment_corr") > g["increment_corr"], "q5_corr"),
        (c("increment_overlap_frac") > g["overlap"], "q5_overlap"),
        (F.abs("prior_corr") > g["prior_corr"], "prior_corr"),
    ]
    out = table.withColumn("reject_reasons", reasons(rules, "|", ""))
    return out.withColumn("submit_gate", F.when(F.col("reject_reasons") == "", "pass").otherwise("reject"))


def candidate_similarity(long: DataFrame, names: Sequence[str], top: int = 20) -> DataFrame:
    """Correlation, Jaccard of changed rows and top overlap for every pair of named candidates. The
    changes of one id become one short array, so pairs come out of a small matrix, not of a self-join."""
    held = long.where(F.col("candidate").isin(list(names))).groupBy("id").agg(
        *[F.max(F.when(F.col("candidate") == n, diff())).alias(f"__{k}") for k, n in enumerate(names)]
    )
    moves = [F.coalesce(f"__{k}", F.lit(0.0)) for k in range(len(names))]
    # Changes and marks of changed rows side by side: one matrix, one reading of the rows.
    k = len(names)
    g = gram(held.select("id", F.array(*moves, *[(F.abs(m) > 1e-12).cast("double") for m in moves]).alias("x")), None, [])[None]
    sd = np.sqrt(np.maximum(np.diag(g.sxx)[:k], 0.0))
    both = (g.m[1:, 1:] + np.outer(g.about, g.m[0, 1:]) + np.outer(g.m[0, 1:], g.about) + g.n * np.outer(g.about, g.about))[k:, k:]
    count = np.diag(both)
    tops = top_moves(long.where(F.col("candidate").isin(list(names))), top).select("candidate", "id")
    common = tops.alias("a").join(tops.alias("b"), "id").groupBy(
        F.col("a.candidate").alias("a"), F.col("b.candidate").alias("b")
    ).agg(F.count("*").alias("c"))
    shared = {(r["a"], r["b"]): r["c"] for r in common.collect()}
    rows = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i == j:
                continue
            flat = sd[i] <= 1e-12 or sd[j] <= 1e-12
            corr = 0.0 if flat else abs(float(g.sxx[i, j] / (sd[i] * sd[j])))
            union = count[i] + count[j] - both[i, j]
            rows.append((a, b, corr, float(both[i, j] / max(union, 1.0)), shared.get((a, b), 0) / top))
    return long.sparkSession.createDataFrame(rows, "a string, b string, corr double, jaccard double, top_overlap double")


def most_similar(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("a").alias("candidate")).agg(
        F.max("corr").alias("max_pairwise_corr"), F.max("jaccard").alias("max_changed_jaccard"), F.max("top_overlap").alias("max_top_overlap")
    )


def range_assessment(pred: DataFrame, test: DataFrame, train: DataFrame, y: str = "y") -> DataFrame:
    """Predicted mean and deviation of each test group against the target of its nearest train group."""
    near = nearest_groups(centroids(test), centroids(train), 1).select("test_grp", "train_grp")
    ref = train.groupBy(F.col("grp").alias("train_grp")).agg(F.avg(y).alias("ref_mean"), F.stddev_pop(y).alias("ref_sd"))
    own = pred.groupBy(F.col("grp").alias("test_grp")).agg(F.count("*").alias("n"), F.avg("y_pred").alias("mean"), F.stddev_pop("y_pred").alias("sd"))
    out = own.join(near, "test_grp").join(ref, "train_grp")
    c = F.col
    label = (
        F.when(c("sd") < c("ref_sd") * 0.85, "compressed")
        .when(c("sd") > c("ref_sd") * 1.15, "expanded")
        .when(F.abs(c("mean") - c("ref_mean")) > F.greatest(c("ref_sd"), F.lit(1.0)) * 0.15, "mean_shift")
        .otherwise("aligned")
    )
    return out.select(
        "test_grp", "train_grp", "n", (c("mean") - c("ref_mean")).alias("mean_shift"),
        (c("sd") / F.greatest(c("ref_sd"), F.lit(1e-12))).alias("sd_ratio"), label.alias("assessment"),
    )


def submission_gate(diffs: DataFrame, scores: DataFrame, baseline: float, tolerance: float = 2.0) -> DataFrame:
    """0 < diff rmse < 10 and the stratified CV rmse within ``tolerance`` of the baseline."""
    both = diffs.select("candidate", "diff_rmse").join(scores.select("candidate", "cv_rmse"), "candidate", "left")
    drift_ok = F.col("diff_rmse").isNotNull() & (F.col("diff_rmse") > 0) & (F.col("diff_rmse") < 10)
    cv_ok = F.coalesce(F.col("cv_rmse") <= baseline + tolerance, F.lit(False))
    return both.withColumns({"pass_diff": drift_ok, "pass_cv": cv_ok, "pass_both": drift_ok & cv_ok})
