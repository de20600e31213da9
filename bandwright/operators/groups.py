"""Group statistics and error tables (AGG)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import moments as M
from ..session import cut
from .ordered import (
    equal_bins, join_on, ordinal, previous, quantiles, running_sum, tie_rank, with_quantiles, with_stats,
)
from .select import top_fraction


def err(pred: str = "y_pred", true: str = "y_true") -> Column:
    return F.col(pred) - F.col(true)


def metric_aggs(pred: str = "y_pred", true: str = "y_true") -> list[Column]:
    """n, rmse, mae, r2 (0 when the target is constant)."""
    e = err(pred, true)
    n = F.count(F.lit(1))
    ss = F.var_pop(true) * n
    return [
        n.alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(ss <= 1e-12, F.lit(0.0)).otherwise(1 - F.sum(e * e) / ss).alias("r2"),
    ]


def metrics(df: DataFrame, keys: Sequence[str] = (), pred: str = "y_pred", true: str = "y_true") -> DataFrame:
    return df.groupBy(*keys).agg(*metric_aggs(pred, true))


def fold_summary(oof: DataFrame, fold: str = "fold_id") -> DataFrame:
    """Mean and population deviation of the fold scores, next to the pooled score."""
    folds = metrics(oof, [fold])
    per_fold = folds.agg(
        F.count("*").alias("folds"), F.avg("rmse").alias("mean_score"), F.stddev_pop("rmse").alias("std_score")
    )
    pooled = metrics(oof).select(
        F.col("rmse").alias("oof_rmse"), F.col("mae").alias("oof_mae"), F.col("r2").alias("oof_r2")
    )
    return join_on(per_fold, pooled, [])


def group_errors(df: DataFrame, group: str = "grp", pred: str = "y_pred", true: str = "y_true") -> DataFrame:
    e = err(pred, true)
    return df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
        F.avg(true).alias("mean_true"),
        F.avg(pred).alias("mean_pred"),
    )


def worst_group(df: DataFrame, keys: Sequence[str] = (), group: str = "grp", pred: str = "y_pred", true: str = "y_true") -> DataFrame:
    """Group with the largest rmse (ties: smallest name) and its bias."""
    e = err(pred, true)
    per = df.groupBy(*keys, group).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
    first = F.min_by(
        F.struct(group, "rmse", "bias"), F.struct((-F.col("rmse")).alias("k"), F.col(group).alias("g"))
    ).alias("w")
    return per.groupBy(*keys).agg(first).select(
        *keys,
        F.col(f"w.{group}").alias("worst_group"),
        F.col("w.rmse").alias("worst_rmse"),
        F.col("w.bias").alias("worst_bias"),
    )


def range_table(df: DataFrame, group: str = "grp", pred: str = "y_pred", true: str = "y_true") -> DataFrame:
    out = df.groupBy(group).agg(
        F.min(true).alias("true_min"),
        F.max(true).alias("true_max"),
        F.min(pred).alias("pred_min"),
        F.max(pred).alias("pred_max"),
    )
    true_range, pred_range = F.col("true_max") - F.col("true_min"), F.col("pred_max") - F.col("pred_min")
    return out.withColumns(
        {"true_range": true_range, "pred_range": pred_range, "range_gap": pred_range - true_range}
    )


def binned_errors(
    df: DataFrame, bins: int, order: Sequence[str], keys: Sequence[str] = (), pred: str = "y_pred", true: str = "y_true"
) -> DataFrame:
    """Metrics in equal-count bins cut at floor(n * i / bins)."""
    e = err(pred, true)
    return equal_bins(df, keys, order, bins, "bin").groupBy(*keys, "bin").agg(
        F.count("*").alias("n"),
        F.min(true).alias("bin_min"),
        F.max(true).alias("bin_max"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
    )


def cell_errors(
    df: DataFrame, bins: int, worst: int, group: str = "grp", pred: str = "y_pred", true: str = "y_true"
) -> DataFrame:
    """Errors by group and target quantile bin; the report keeps the ``worst`` cells.
    Here the bias is true - pred."""
    probs = [b / bins for b in range(bins + 1)]
    edged = with_quantiles(df, true, probs, prefix="e")
    bin_no = F.lit(0)
    for b in range(1, bins):
        bin_no = bin_no + F.when(F.col(true) >= F.col(f"e{b}"), 1).otherwise(0)
    e = F.col(true) - F.col(pred)
    cells = edged.withColumn("bin", bin_no).groupBy(group, "bin").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")
    )
    return cells.orderBy(F.col("rmse").desc(), group, "bin").limit(worst)


def numeric_summary(df: DataFrame, value: str, keys: Sequence[str] = (), median: str = "interp") -> DataFrame:
    """min, max, mean, population deviation, count and median. ``median='upper'`` takes the upper
    middle value of an even count."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )
    if median == "interp":
        mid = quantiles(df, value, [0.5], keys).withColumnRenamed("q0", "median")
    else:
        present = df.where(F.col(value).isNotNull()).select(*keys, value)
        ranked = with_stats(ordinal(present, keys, [value], "__r"), keys, F.count("*").alias("__n"))
        mid = ranked.where(F.col("__r") == F.floor(F.col("__n") / 2)).select(*keys, F.col(value).alias("median"))
    return join_on(base, mid, list(keys))


def centroids(df: DataFrame, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Mean spectrum per group as an array ``x``; what is collected per group is d numbers."""
    long = df.select(*keys, F.posexplode("x").alias("band", "v"))
    per = long.groupBy(*keys, "band").agg(F.avg("v").alias("m"))
    pairs = F.array_sort(F.collect_list(F.struct("band", "m")))
    return per.groupBy(*keys).agg(F.transform(pairs, lambda p: p["m"]).alias("x"))


# ---- correlation profiles --------------------------------------------------------------


def band_correlation(df: DataFrame, keys: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Pearson correlation of every band with the target, per key."""
    m = M.band_moments(df, keys, y)
    return m.select(*keys, "band", "n", M.pearson().alias("corr"))


def spearman_bands(long: DataFrame, y: str = "y", flavour: str = "average") -> DataFrame:
    """Correlation of ranks per band over rows (id, band, v, y). ``ordinal`` ranks break ties by id."""
    if flavour == "average":
        ranked = tie_rank(long, "v", "id", "rv", ["band"])
        targets = tie_rank(long.select("id", y).distinct(), y, "id", "ry")
    else:
        ranked = ordinal(long, ["band"], ["v", "id"], "rv")
        targets = ordinal(long.select("id", y).distinct(), [], [y, "id"], "ry")
    both = ranked.join(targets.select("id", "ry"), "id")
    return both.groupBy("band").agg(safe_corr("rv", "ry").alias("rho"))


def safe_corr(a: str, b: str) -> Column:
    """Correlation, 0 when a side is constant. Spark's own ``corr`` fails on a constant in ANSI mode."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    sa, sb = F.stddev_pop(F.when(both, F.col(a))), F.stddev_pop(F.when(both, F.col(b)))
    flat = sa.isNull() | (sa <= 1e-12) | (sb <= 1e-12)
    return F.when(flat, F.lit(0.0)).otherwise(F.covar_pop(a, b) / (sa * sb))


def group_strength(df: DataFrame, min_rows: int = 8) -> DataFrame:
    """Mean over groups of |corr| per band; groups under ``min_rows`` rows are skipped."""
    per = band_correlation(df, ["grp"]).where(F.col("n") >= min_rows)
    return per.groupBy("band").agg(F.avg(F.abs("corr")).alias("group_abs_corr"), F.count("*").alias("groups"))


def binned_mutual_information(long: DataFrame, bins: int = 8, y: str = "y") -> DataFrame:
    """Mutual information (nats) of each feature with the target from a 2-D equal-count histogram.
    Rows are (id, feature, v, y)."""
    cut = equal_bins(long, ["feature"], ["v", "id"], bins, "bv")
    targets = equal_bins(long.select("id", y).distinct(), [], [y, "id"], bins, "by")
    both = cut.join(targets.select("id", "by"), "id")
    cells = both.groupBy("feature", "bv", "by").agg(F.count("*").alias("c"))
    w = Window.partitionBy("feature")
    px = F.sum("c").over(Window.partitionBy("feature", "bv"))
    py = F.sum("c").over(Window.partitionBy("feature", "by"))
    n = F.sum("c").over(w)
    cells = cells.withColumn("t", F.col("c") / n * F.log(F.col("c") * n / (px * py)))
    return cells.groupBy("feature").agg(F.sum("t").alias("mutual_info"))


# ---- windows: transfer and usable score ------------------------------------------------


def transfer_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per feature over rows (feature, grp, v): test shift, mean distance of each test group to the
    nearest train group (both in train standard deviations), and test between/within ratio."""
    fit = train.groupBy("feature").agg(
        F.avg("v").alias("m"), F.greatest(F.stddev_pop("v"), F.lit(1e-12)).alias("s")
    )
    z = (F.col("v") - F.col("m")) / F.col("s")
    tr = train.join(fit, "feature").groupBy("feature", "grp").agg(F.avg(z).alias("c"))
    te = test.join(fit, "feature").withColumn("z", z)
    shift = te.groupBy("feature").agg(F.avg("z").alias("test_global_shift"))
    groups = te.groupBy("feature", "grp").agg(F.avg("z").alias("c"), F.var_pop("z").alias("v"))
    # Nearest train group: both kinds of group means in one order, the train mean before and after carried over.
    line = groups.select("feature", "grp", "c", "v", F.lit(None).cast("double").alias("t")).unionByName(tr.select("feature", "grp", "c", F.lit(None).cast("double").alias("v"), F.col("c").alias("t")))
    order = Window.partitionBy("feature").orderBy("c")
    below = F.last("t", True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    above = F.first("t", True).over(order.rangeBetween(0, Window.unboundedFollowing))
    near = line.withColumn("dist", F.least(F.col("c") - below, above - F.col("c"))).where("t IS NULL")
    per = near.groupBy("feature").agg(
        F.avg("dist").alias("mean_nearest_distance"),
        F.when(F.count("*") <= 1, F.lit(0.0))
        .otherwise(F.var_pop("c") / F.greatest(F.avg("v"), F.lit(1e-12)))
        .alias("test_separation"),
    )
    return shift.join(per, "feature")


def usable_score(
    pearson: Column, spearman: Column, group: Column, separation: Column, mi: Column, shift: Column, distance: Column
) -> Column:
    """Weighted usefulness of a window feature, less a penalty for domain shift."""
    penalty = F.least(F.lit(2.5), F.abs(shift)) + F.least(F.lit(3.0), F.abs(distance)) * 0.35
    return (
        F.abs(pearson) * 0.42
        + F.abs(spearman) * 0.22
        + group * 0.18
        + F.least(F.lit(1.0), separation) * 0.10
        + F.least(F.lit(1.0), mi) * 0.08
        - penalty * 0.08
    )


def region_table(scored: DataFrame, keep: int = 10) -> DataFrame:
    """Windows bucketed by centre (nearest 25, half to even); means over the ``keep`` best."""
    centre = F.floor((F.col("win_start") + F.col("win_end")) / 2)
    bucketed = scored.withColumn("bucket", (F.bround(centre / 25.0) * 25).cast("bigint"))
    w = Window.partitionBy("view", "stat", "bucket").orderBy(F.col("usable").desc(), "win_start", "win_end")
    support = bucketed.groupBy("view", "stat", "bucket").agg(F.count("*").alias("n_support"))
    top = bucketed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    per = top.groupBy("view", "stat", "bucket").agg(
        F.min("win_start").alias("start_min"),
        F.max("win_end").alias("end_max"),
        F.max("usable").alias("best_usable"),
        F.avg("usable").alias("mean_top_usable"),
    )
    return per.join(support, ["view", "stat", "bucket"])


# ---- sequences -------------------------------------------------------------------------


def sequence_profile(df: DataFrame, keys: Sequence[str], seq: str = "seq", value: str = "value") -> DataFrame:
    """Per group: correlations with order, slope, share of falls, adjacent deltas, first and last."""
    cols = list(dict.fromkeys([*keys, seq, value]))
    ranked = ordinal(df.select(*cols), keys, [seq], "__o")
    ranked = tie_rank(ranked, value, "__o", "__rv", keys)
    stepped = previous(ranked, keys, "__o", value, "__p").withColumn("__d", F.col(value) - F.col("__p"))
    base = stepped.groupBy(*keys).agg(
        F.count("*").alias("n"),
        safe_corr(seq, value).alias("pearson"),
        safe_corr("__o", "__rv").alias("spearman"),
        F.coalesce(F.regr_slope(value, seq), F.lit(0.0)).alias("slope"),
        F.coalesce(F.avg(F.when(F.col("__d") < 0, 1.0).when(F.col("__d") >= 0, 0.0)), F.lit(0.0)).alias("decrease_rate"),
        F.coalesce(F.avg("__d"), F.lit(0.0)).alias("mean_delta"),
        F.min_by(value, seq).alias("first_value"),
        F.max_by(value, seq).alias("last_value"),
    )
    mid = quantiles(stepped, "__d", [0.5], keys).withColumnRenamed("q0", "median_delta")
    out = join_on(base, mid, list(keys))
    return out.withColumn("median_delta", F.coalesce("median_delta", F.lit(0.0)))


def error_audit(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson of error and |error| with each feature column, and Spearman with |error|."""
    e = err()
    base = df.select(*features, e.alias("__e"), F.abs(e).alias("__a"))
    long = tie_rank(base, "__a", "__e", "__ra").select(
        "__e",
        "__a",
        "__ra",
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
        ).alias("s"),
    ).select("__e", "__a", "__ra", "s.feature", "s.v")
    ranked = tie_rank(long, "v", "__e", "__rv", ["feature"])
    return ranked.groupBy("feature").agg(
        safe_corr("v", "__e").alias("corr_error"),
        safe_corr("v", "__a").alias("corr_abs_error"),
        safe_corr("__rv", "__ra").alias("rho_abs_error"),
    )


# ---- deltas between predictions --------------------------------------------------------


def decile_delta(df: DataFrame, anchor: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean change where the anchor is at or under its q10 and at or over its q90."""
    edged = with_quantiles(df, anchor, [0.1, 0.9], keys, prefix="__q")
    change = F.col(pred) - F.col(anchor)
    return edged.groupBy(*keys).agg(
        F.avg(F.when(F.col(anchor) <= F.col("__q0"), change)).alias("bottom_delta"),
        F.avg(F.when(F.col(anchor) >= F.col("__q1"), change)).alias("top_delta"),
    )


def fold_deltas(df: DataFrame, keys: Sequence[str] = (), group: str = "grp", pred: str = "pred", anchor: str = "anchor", true: str = "y_true") -> DataFrame:
    """rmse change per group, then improved count, ratio, worst change and deviation."""
    def rmse(c: str) -> Column:
        return F.sqrt(F.avg((F.col(c) - F.col(true)) * (F.col(c) - F.col(true))))

    per = df.groupBy(*keys, group).agg((rmse(pred) - rmse(anchor)).alias("d"))
    improved = F.sum(F.when(F.col("d") < 0, 1).otherwise(0))
    return per.groupBy(*keys).agg(
        improved.alias("improved_count"),
        F.count("*").alias("group_count"),
        (improved / F.count("*")).alias("improved_ratio"),
        F.max("d").alias("worst_delta"),
        F.stddev_pop("d").alias("delta_std"),
    )


def max_group_shift(df: DataFrame, keys: Sequence[str] = (), group: str = "grp", pred: str = "pred", anchor: str = "anchor") -> DataFrame:
    per = df.groupBy(*keys, group).agg(F.avg(F.col(pred) - F.col(anchor)).alias("m"))
    return per.groupBy(*keys).agg(F.max(F.abs("m")).alias("max_group_shift"))


def ess_ratio(weight: str) -> Column:
    """(sum w)^2 / (n sum w^2)."""
    w = F.col(weight)
    return F.sum(w) * F.sum(w) / F.greatest(F.sum(w * w) * F.count(F.lit(1)), F.lit(1e-12))


# ---- detectors -------------------------------------------------------------------------


def detector_quality(df: DataFrame, score: str, label: str, tie: str = "id") -> DataFrame:
    """AUC from tie-averaged ranks and average precision over distinct thresholds."""
    ranked = tie_rank(df.select(tie, score, F.col(label).cast("double").alias("__l")), score, tie, "__t")
    pos, n = F.sum("__l"), F.count("*")
    auc = ranked.agg(
        F.when((pos == 0) | (pos == n), F.lit(None).cast("double"))
        .otherwise((F.sum(F.col("__l") * F.col("__t")) - pos * (pos + 1) / 2) / (pos * (n - pos)))
        .alias("auc")
    )
    steps = df.groupBy(score).agg(
        F.sum(F.col(label).cast("double")).alias("__tp"), F.count("*").cast("double").alias("__n")
    )
    steps = ordinal(steps, [], [F.col(score).desc()], "__o")
    steps = running_sum(running_sum(steps, [], "__o", "__tp", "__ctp"), [], "__o", "__n", "__cn")
    ap = steps.agg((F.sum(F.col("__tp") * F.col("__ctp") / F.col("__cn")) / F.sum("__tp")).alias("ap"))
    return join_on(auc, ap, [])


def precision_at(df: DataFrame, score: str, label: str, size: str, frac: float, tie: str = "id", group: str = "grp") -> DataFrame:
    """Precision and mean-size lift of the top fraction, with the lowest precision over groups."""
    gated = top_fraction(df, score, tie, frac, "__gate")
    yes = F.col(label).cast("double")
    whole = gated.agg(
        F.avg(F.when(F.col("__gate"), yes)).alias("precision"),
        (F.avg(F.when(F.col("__gate"), F.col(size))) / F.greatest(F.avg(size), F.lit(1e-12))).alias("lift"),
        F.sum(F.col("__gate").cast("bigint")).alias("k"),
    )
    low = gated.where("__gate").groupBy(group).agg(F.avg(yes).alias("p")).agg(
        F.coalesce(F.min("p"), F.lit(0.0)).alias("group_precision_min")
    )
    return join_on(whole, low, [])


# ---- clusters --------------------------------------------------------------------------


def silhouette(df: DataFrame, cluster: str = "cluster", x: str = "x") -> DataFrame:
    """One row with the mean silhouette on squared distances. A row's mean squared distance to a cluster follows
    from the cluster's mean, mean squared norm and size, so no pair of rows is formed."""
    norm = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    per_band = df.select(cluster, F.posexplode(x).alias("k", "v")).groupBy(cluster, "k").agg(F.avg("v").alias("m"))
    # One entry per cluster and band: both are parameters of the model, not of the data.
    mean = per_band.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("mu"))
    size = df.groupBy(cluster).agg(F.avg(norm).alias("sq"), F.count("*").alias("n"))
    held = mean.join(size, cluster).agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "mu", "sq", "n")).alias("__all"))
    rows = join_on(df.select(cluster, F.col(x).alias("__x"), norm.alias("__nx")), held, [])
    dot = lambda mu: F.aggregate(F.zip_with("__x", mu, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    away = lambda s: F.col("__nx") - 2 * dot(s["mu"]) + s["sq"]
    own = F.get(F.transform(F.filter("__all", lambda s: s["c"] == F.col(cluster)), lambda s: F.when(s["n"] > 1, away(s) * s["n"] / (s["n"] - 1))), 0)
    other = F.array_min(F.transform(F.filter("__all", lambda s: s["c"] != F.col(cluster)), away))
    rows = rows.select(own.alias("a"), other.alias("b"))
    value = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return rows.agg(F.coalesce(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(value)), F.lit(0.0)).alias("silhouette"))


def cluster_quality(df: DataFrame, min_train: int = 10) -> DataFrame:
    """Rows (cluster, grp, domain, x): purity, concentration, mixed coverage, silhouette and the clean score."""
    counts = df.groupBy("domain", "cluster", "grp").agg(F.count("*").alias("c"))
    test, train = counts.where("domain = 'test'"), counts.where("domain = 'train'")

    def share(part: DataFrame, by: str, name: str) -> DataFrame:
        top = part.groupBy(by).agg(F.max("c").alias("m"), F.sum("c").alias("t"))
        return top.agg((F.sum("m") / F.sum("t")).alias(name))

    sides = df.groupBy("cluster").agg(
        F.sum(F.when(F.col("domain") == "test", 1).otherwise(0)).alias("te"),
        F.sum(F.when(F.col("domain") == "train", 1).otherwise(0)).alias("tr"),
    )
    covered = sides.agg(
        (F.sum(F.when(F.col("tr") >= min_train, F.col("te")).otherwise(0)) / F.greatest(F.sum("te"), F.lit(1))).alias(
            "mixed_coverage"
        )
    )
    out = share(test, "cluster", "test_purity")
    for other in (share(test, "grp", "test_concentration"), share(train, "cluster", "train_purity"), covered, silhouette(df)):
        out = join_on(out, other, [])
    clean = (
        F.col("test_purity") * 0.35
        + F.col("test_concentration") * 0.35
        + F.col("mixed_coverage") * 0.20
        + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("silhouette") + 0.1) / 0.6)) * 0.10
    )
    return out.withColumn("clean_score", clean)


def top_counts(counts: DataFrame, keys: Sequence[str], item: str, count: str, n: int, name: str) -> DataFrame:
    """``a=3; b=2`` text of the n most common items (ties: smaller item)."""
    w = Window.partitionBy(*keys).orderBy(F.col(count).desc(), F.col(item).asc())
    top = counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    pairs = F.array_sort(
        F.collect_list(F.struct("rn", F.concat_ws("=", F.col(item).cast("string"), F.col(count).cast("string")).alias("t")))
    )
    return top.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["t"]), "; ").alias(name))


def cluster_composition(df: DataFrame, n: int = 6) -> DataFrame:
    counts = df.groupBy("cluster", "domain", "grp").agg(F.count("*").alias("c"))
    tr, te = F.col("domain") == "train", F.col("domain") == "test"
    base = counts.groupBy("cluster").agg(
        F.sum("c").alias("n"),
        F.sum(F.when(tr, F.col("c")).otherwise(0)).alias("train_n"),
        F.sum(F.when(te, F.col("c")).otherwise(0)).alias("test_n"),
    ).withColumn("test_ratio", F.col("test_n") / F.greatest(F.col("n"), F.lit(1)))
    for side, cond in (("train", tr), ("test", te)):
        base = base.join(top_counts(counts.where(cond), ["cluster"], "grp", "c", n, f"top_{side}"), "cluster", "left")
    return base.na.fill("", ["top_train", "top_test"])


def dominant_cluster(df: DataFrame, n: int = 6) -> DataFrame:
    """Per test group: its commonest cluster (ties: smaller), share, and who else is in there."""
    counts = df.groupBy("domain", "grp", "cluster").agg(F.count("*").alias("c"))
    test = counts.where("domain = 'test'")
    per = test.groupBy("grp").agg(
        F.sum("c").alias("n"), F.min_by("cluster", F.struct((-F.col("c")).alias("k"), "cluster")).alias("cluster"), F.max("c").alias("top_n")
    )
    per = per.withColumn("top_share", F.col("top_n") / F.col("n"))
    for side in ("train", "test"):
        per = per.join(
            top_counts(counts.where(F.col("domain") == side), ["cluster"], "grp", "c", n, f"{side}_in_cluster"), "cluster", "left"
        )
    return per.na.fill("", ["train_in_cluster", "test_in_cluster"])


# ---- change buckets and null comparison ------------------------------------------------


def change_bucket(own: Column, others: Column) -> Column:
    """Bucket of a row by who changed it."""
    return (
        F.when(own & others, F.lit("both"))
        .when(own, F.lit("own_only"))
        .when(others, F.lit("others_only"))
        .otherwise(F.lit("untouched"))
    )


def bucket_summary(df: DataFrame, keys: Sequence[str], pred: str, score: str, change: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(pred).alias("pred_mean"),
        F.min(pred).alias("pred_min"),
        F.max(pred).alias("pred_max"),
        F.avg(score).alias("score_mean"),
        F.avg(F.abs(change)).alias("abs_change_mean"),
    )


# The draw of shares is exact below this many rows in a node of the tree; above it numpy has none, and a rounded
# normal draw with the same mean and variance stands in, which differs by less than the noise of the repeats.
EXACT_ROWS = 1_000_000_000


def subset_share(before: np.ndarray, at: int, m: int, reps: int, seed: int) -> np.ndarray:
    """Rows of part ``at`` in each of ``reps`` subsets of ``m`` rows; ``before`` holds the parts' cumulative sizes."""
    lo, hi, node = 0, len(before) - 1, 1
    share = np.full(reps, m, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, right = int(before[mid] - before[lo]), int(before[hi] - before[mid])
        rng = np.random.default_rng([seed, node])
        if left + right < EXACT_ROWS:
            got = rng.hypergeometric(left, right, share)
        else:
            n = left + right
            mean = share * (left / n)
            sd = np.sqrt(np.maximum(mean * (right / n) * ((n - share) / (n - 1)), 0))
            got = np.clip(np.rint(rng.normal(mean, sd)).astype(np.int64), np.maximum(0, share - right), np.minimum(share, left))
        lo, hi, node, share = (lo, mid, 2 * node, got) if at < mid else (mid, hi, 2 * node + 1, share - got)
    return share


def subset_null_moments(df: DataFrame, value: str, marked: str) -> DataFrame:
    """What the draws of ``subset_null`` tend to: mean and deviation of the mean of a random subset without replacement."""
    v = F.col(value).cast("double")
    sums = df.where(v.isNotNull()).agg(
        F.avg(F.when(F.col(marked), v)).alias("observed"), F.avg(v).alias("null_mean"), F.var_samp(v).alias("s"), F.count("*").alias("n"), F.sum(F.col(marked).cast("bigint")).alias("m"),
    )
    sd = F.sqrt(F.col("s") / F.col("m") * (1 - F.col("m") / F.col("n")))
    return sums.select("observed", "null_mean", sd.alias("null_sd"), ((F.col("observed") - F.col("null_mean")) / sd).alias("z"))


def subset_null(df: DataFrame, value: str, marked: str, tie: str = "id", reps: int = 2000, seed: int = 42) -> DataFrame:
    """Mean over the marked rows against ``reps`` random subsets of the same size. How many rows of a subset lie in
    a partition is found by halving the range of partitions: at each of log2(partitions) steps the share of the
    left half is a hypergeometric draw, made from the seed and the place in the tree, so all tasks below agree.
    A task then draws its own rows and returns one sum per repeat. Rows never leave their partition."""
    # Written, so that partitions hold the same rows when they are counted and when they are drawn from.
    base = cut(df.select(F.col(value).cast("double").alias("v"), F.col(marked).alias("m")).where("v IS NOT NULL"))
    counts = {r.p: r.n for r in base.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    head = base.agg(F.count("*").alias("n"), F.sum(F.col("m").cast("bigint")).alias("m"), F.avg(F.when(F.col("m"), F.col("v"))).alias("observed")).first()
    m = head["m"] or 0
    parts = sorted(counts)
    before = np.concatenate([[0], np.cumsum([counts[p] for p in parts])]).astype(np.int64)

    def draw(batches):
        from pyspark import TaskContext

        held = [pdf["v"].to_numpy() for pdf in batches]
        p = TaskContext.get().partitionId()
        if not held or p not in counts:
            return
        v = np.concatenate(held)
        share = subset_share(before, parts.index(p), m, reps, seed)
        sums = np.empty(reps)
        for rep in range(reps):
            own = np.random.default_rng([seed, rep, p])
            sums[rep] = v[own.choice(len(v), size=share[rep], replace=False, shuffle=False)].sum()
        yield pd.DataFrame({"rep": np.arange(reps), "s": sums})

    means = base.mapInPandas(draw, "rep long, s double").groupBy("rep").agg((F.sum("s") / max(m, 1)).alias("m"))
    means = cut(means)
    edges = quantiles(means, "m", [0.05, 0.95]).select(F.col("q0").alias("null_p05"), F.col("q1").alias("null_p95"))
    null = means.agg(F.avg("m").alias("null_mean"), F.stddev_pop("m").alias("null_sd"))
    out = join_on(null, edges, []).withColumn("observed", F.lit(head["observed"]))
    return out.withColumn(
        "z", (F.col("observed") - F.col("null_mean")) / F.greatest(F.col("null_sd"), F.lit(1e-12))
    )



def seed_spread(df: DataFrame, id_col: str = "id", pred: str = "pred") -> DataFrame:
    """Deviation over seeds per row, then mean and largest."""
    per = df.groupBy(id_col).agg(F.stddev_pop(pred).alias("s"))
    return per.agg(F.avg("s").alias("spread_mean"), F.max("s").alias("spread_max"))


def weight_report(df: DataFrame, weight: str, removed: Column, group: str = "grp") -> DataFrame:
    gone = F.sum(F.when(removed, 1).otherwise(0))
    return df.groupBy(group).agg(
        F.count("*").alias("n"),
        gone.alias("removed"),
        (gone / F.count("*")).alias("removed_rate"),
        F.avg(weight).alias("weight_mean"),
        F.min(weight).alias("weight_min"),
    )
