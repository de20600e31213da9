"""DRF, CMP and WGT/DET: drift of candidates, ranking of experiments, weights and detectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import compare as K
from ..operators import corrections as C
from ..operators import detectors as De
from ..operators import drift as D
from ..operators import fits as Fi
from ..operators import folds as Cv
from ..operators import targets as T
from ..operators import weights as W
from ..operators.ordered import join_on
from ..session import cut
from .fixtures import CAND_SQL, PAIR_SQL, RUNS_SQL, SPECTRA_SQL, TRAIN_SQL, candidates, pred_pair, runs, spectra, test, train
from .q_fits import LOGO_SQL
from .q_neighbours import CENT_SQL, pair_sql
from .q_stats import AVG_RANK
from .registry import d, i, query

# ---- DRF -------------------------------------------------------------------------------


@query(
    "DRF-1",
    f"""WITH {CAND_SQL} SELECT candidate, {i('count(*)', 'n')}, {d('sqrt(avg((pred - anchor) ** 2))', 'diff_rmse', 4)}, {d('max(abs(pred - anchor))', 'diff_max_abs', 4)},
  {d('avg(pred - anchor)', 'diff_mean', 4)}, {d('corr(pred, anchor)', 'corr', 4)}, {i('sum((abs(pred - anchor) > 1e-9)::INT)', 'changed_rows')},
  {d('min(pred)', 'pred_min', 4)}, {d('avg(pred)', 'pred_mean', 4)}, {d('median(pred)', 'pred_median', 4)}, {d('max(pred)', 'pred_max', 4)},
  {i('sum((pred < 0)::INT)', 'negative_count')} FROM cand GROUP BY candidate""",
    digits=4,
)
def drf_1(spark, sf):
    return D.anchor_diff(candidates(spark, sf))


ALIGN_SQL = CAND_SQL + """,
al AS (SELECT *, pred - anchor AS df, avg(pred) OVER c AS pm, stddev_pop(pred) OVER c AS ps, avg(anchor) OVER c AS bm, stddev_pop(anchor) OVER c AS bs,
  avg(pred) OVER g AS gpm, stddev_pop(pred) OVER g AS gps, avg(anchor) OVER g AS gbm, stddev_pop(anchor) OVER g AS gbs
  FROM cand WINDOW c AS (PARTITION BY candidate), g AS (PARTITION BY candidate, grp)),
dt AS (SELECT candidate, sqrt(avg(df ** 2)) AS raw_diff_rmse, avg(df) AS bias, sqrt(avg((df - (pm - bm)) ** 2)) AS mean_rmse,
  sqrt(avg(((pred - pm) / greatest(ps, 1e-12) * bs + bm - anchor) ** 2)) AS mean_std_rmse, sqrt(avg((df - (gpm - gbm)) ** 2)) AS group_mean_rmse,
  sqrt(avg(((pred - gpm) / greatest(gps, 1e-12) * gbs + gbm - anchor) ** 2)) AS group_mean_std_rmse, max(abs(gpm - gbm)) AS max_group_shift,
  corr(pred, anchor) AS corr_to_anchor, avg(pred) AS pred_mean, min(pred) AS pred_min, max(pred) AS pred_max, sum((pred < 0)::INT) AS pred_neg FROM al GROUP BY candidate)"""
DRIFT_COLS = (
    "raw_diff_rmse", "bias", "mean_rmse", "mean_std_rmse", "group_mean_rmse", "group_mean_std_rmse", "max_group_shift",
    "corr_to_anchor", "pred_mean", "pred_min", "pred_max",
)
DRIFT_SELECT = "candidate, " + ", ".join(d(c, c, 3) for c in DRIFT_COLS) + ", " + i("pred_neg", "pred_neg")


@query("DRF-2", f"WITH {ALIGN_SQL} SELECT {DRIFT_SELECT} FROM dt", digits=3)
def drf_2(spark, sf):
    return D.drift_table(candidates(spark, sf))


@query(
    "DRF-2-groups",
    f"""WITH {CAND_SQL} SELECT candidate, grp, {i('count(*)', 'n')}, {d('avg(pred - anchor)', 'mean_shift', 4)}, {d('sqrt(avg((pred - anchor) ** 2))', 'diff_rmse', 4)},
  {d('stddev_pop(pred)', 'pred_sd', 4)}, {d('stddev_pop(anchor)', 'anchor_sd', 4)} FROM cand GROUP BY candidate, grp""",
    digits=4,
)
def drf_2_groups(spark, sf):
    return D.group_drift(candidates(spark, sf))


@query(
    "DRF-3",
    f"""WITH {ALIGN_SQL}, sc AS (SELECT candidate, sqrt(avg((pred - y_true) ** 2)) AS s FROM cand GROUP BY candidate)
SELECT dt.candidate, {d('raw_diff_rmse', 'raw_diff_rmse', 3)}, {d('group_mean_std_rmse', 'group_mean_std_rmse', 3)}, {d('s', 'measured', 3)} FROM dt JOIN sc USING (candidate)""",
    digits=3,
)
def drf_3(spark, sf):
    """Drift of every candidate next to its measured score."""
    long = candidates(spark, sf)
    e = F.col("pred") - F.col("y_true")
    score = long.groupBy("candidate").agg(F.sqrt(F.avg(e * e)).alias("measured"))
    return D.drift_table(long).join(score, "candidate", "left").select("candidate", "raw_diff_rmse", "group_mean_std_rmse", "measured")


@query(
    "DRF-4",
    f"""WITH {ALIGN_SQL}
SELECT candidate, CASE WHEN t = '' THEN 'pass_guard' ELSE t END AS decision, {d('g', 'guard_score', 3)} FROM (
  SELECT candidate, concat_ws(';', CASE WHEN raw_diff_rmse > 10 THEN 'reject_raw_drift' END, CASE WHEN abs(bias) > 5 THEN 'reject_global_bias' END,
    CASE WHEN max_group_shift > 12 THEN 'reject_species_shift' END, CASE WHEN group_mean_std_rmse > 6 THEN 'reject_shape_drift' END,
    CASE WHEN pred_neg > 0 THEN 'warn_negative' END) AS t,
    16.151771 + 0.12 * raw_diff_rmse + 0.18 * abs(bias) + 0.18 * max_group_shift + 0.08 * abs(bias) + 0.2 * pred_neg AS g FROM dt)""",
    digits=3,
)
def drf_4(spark, sf):
    return D.drift_decision(D.drift_table(candidates(spark, sf))).select("candidate", "decision", "guard_score")


@query(
    "DRF-5",
    f"""WITH {CAND_SQL}, bad AS (SELECT id, pred - anchor AS bd FROM cand WHERE candidate = 'gain'), l AS (SELECT cand.*, pred - anchor AS df, bd FROM cand JOIN bad USING (id)),
b AS (SELECT candidate, sqrt(avg(df ** 2)) AS rm, max(abs(df)) AS mx, CASE WHEN stddev_pop(df) <= 1e-9 THEN 0 ELSE coalesce(corr(df, bd), 0) END AS bc, CASE WHEN stddev_pop(df) <= 1e-9 THEN 0 ELSE coalesce(corr(df, id), 0) END AS oc,
  (max(pred) - min(pred)) / (max(anchor) - min(anchor)) AS rr, sum((pred < 0)::INT) AS ng FROM l GROUP BY candidate),
s AS (SELECT candidate, max(abs(m)) AS sh FROM (SELECT candidate, grp, avg(df) AS m FROM l GROUP BY ALL) GROUP BY candidate),
q AS (SELECT candidate, quantile_cont(anchor, 0.1) AS lo, quantile_cont(anchor, 0.9) AS hi FROM l GROUP BY candidate),
g AS (SELECT candidate, avg(CASE WHEN anchor >= hi THEN df END) - avg(CASE WHEN anchor <= lo THEN df END) AS gp FROM l JOIN q USING (candidate) GROUP BY candidate),
t AS (SELECT candidate, max(c) AS tc FROM (SELECT candidate, grp, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY abs(df) DESC, id DESC) AS rn FROM l) WHERE rn <= 10 GROUP BY ALL) GROUP BY candidate)
SELECT candidate, {d('bc', 'bad_corr', 4)}, {d('rr', 'range_ratio', 4)}, {d('sh', 'group_shift', 4)}, {d('gp', 'decile_gap', 4)}, {i('tc', 'top_group_count')},
  {d('2 * greatest(bc, 0) + 0.8 * abs(gp) + 0.7 * abs(oc) + 0.8 * sh + 0.08 * mx + CASE WHEN tc >= 5 THEN 0.5 ELSE 0 END + CASE WHEN rr < 0.92 OR rr > 1.08 THEN 0.4 ELSE 0 END', 'risk', 4)}
FROM b JOIN s USING (candidate) JOIN g USING (candidate) JOIN t USING (candidate)""",
    digits=4,
)
def drf_5(spark, sf):
    long = candidates(spark, sf)
    bad = long.where("candidate = 'gain'").select("id", F.expr("pred - anchor").alias("bad_diff"))
    out = D.failure_guard(long, bad)
    return out.select("candidate", "bad_corr", "range_ratio", "group_shift", "decile_gap", "top_group_count", "risk")


def drf_6_tables(spark, sf):
    long = candidates(spark, sf)
    prior = F.when(F.col("id") % 3 == 0, 100.0).otherwise(0.0)
    inc = F.when(F.col("id") % 5 == 0, F.col("anchor") / 1000).otherwise(0.0)
    return long.withColumn("prior", prior).withColumn("increment", inc), long


@query(
    "DRF-6",
    f"""WITH {CAND_SQL}, t AS (SELECT *, pred - anchor AS df, abs(pred - anchor) > 1e-12 AS m, id % 3 = 0 AS p, id % 5 = 0 AS q FROM cand),
b AS (SELECT candidate, sum(m::INT) AS changed_count, sum((m AND NOT p)::INT) AS new_changed_count, sum((m AND p)::INT) / greatest(sum(m::INT), 1) AS prior_overlap_frac,
  sum((m AND NOT q)::INT) AS increment_new_count, sum((m AND abs(df) >= 1000 - 1e-12)::INT) / greatest(sum(m::INT), 1) AS clip_saturation_frac,
  coalesce(avg(CASE WHEN m THEN (df > 0)::INT END), 0) AS positive_frac, sqrt(avg((greatest(pred, 0) - y_true) ** 2)) - sqrt(avg((anchor - y_true) ** 2)) AS oof_delta FROM t GROUP BY candidate),
g AS (SELECT candidate, max(abs(s)) AS group_shift, max(c) AS group_max_count, sum((dl < 0)::INT) AS improved_count FROM (SELECT candidate, grp, avg(df) AS s, sum(m::INT) AS c,
  sqrt(avg((greatest(pred, 0) - y_true) ** 2)) - sqrt(avg((anchor - y_true) ** 2)) AS dl FROM t GROUP BY candidate, grp) GROUP BY candidate)
SELECT candidate, {i('changed_count', 'changed_count')}, {i('new_changed_count', 'new_changed_count')}, {d('prior_overlap_frac', 'prior_overlap_frac', 4)}, {i('increment_new_count', 'increment_new_count')},
  {d('clip_saturation_frac', 'clip_saturation_frac', 4)}, {d('positive_frac', 'positive_frac', 4)}, {d('oof_delta', 'oof_delta', 4)}, {d('group_shift', 'group_shift', 4)}, {i('group_max_count', 'group_max_count')}, {i('improved_count', 'improved_count')}
FROM b JOIN g USING (candidate)""",
    digits=4,
)
def drf_6(spark, sf):
    out = D.candidate_diagnostics(*drf_6_tables(spark, sf), clip=1000.0)
    return out.select(
        "candidate", "changed_count", "new_changed_count", "prior_overlap_frac", "increment_new_count", "clip_saturation_frac",
        "positive_frac", "oof_delta", "group_shift", "group_max_count", "improved_count",
    )


@query("DRF-6-gate", digits=4)
def drf_6_gate(spark, sf):
    out = D.candidate_gate(D.candidate_diagnostics(*drf_6_tables(spark, sf), clip=1000.0))
    return out.select("candidate", "gate_corr", "increment_corr", "prior_corr", "reject_reasons", "submit_gate")


NAMES = ("gain", "offset", "both", "group_a")


@query(
    "DRF-7",
    f"""WITH {CAND_SQL}, l AS (SELECT candidate, id, pred - anchor AS df FROM cand WHERE candidate <> 'same'),
st AS (SELECT candidate, stddev_pop(df) AS sd FROM l GROUP BY candidate),
p AS (SELECT a.candidate AS a, b.candidate AS b, CASE WHEN max(sa.sd) <= 1e-9 OR max(sb.sd) <= 1e-9 THEN 0 ELSE abs(covar_pop(a.df, b.df) / (max(sa.sd) * max(sb.sd))) END AS c,
  sum((abs(a.df) > 1e-12 AND abs(b.df) > 1e-12)::INT) / greatest(sum((abs(a.df) > 1e-12 OR abs(b.df) > 1e-12)::INT), 1) AS j
  FROM l a JOIN l b ON a.id = b.id AND a.candidate <> b.candidate JOIN st sa ON sa.candidate = a.candidate JOIN st sb ON sb.candidate = b.candidate GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY abs(df) DESC, id DESC) AS rn FROM l) WHERE rn <= 20),
o AS (SELECT a.candidate AS a, b.candidate AS b, count(*) / 20 AS o FROM t a JOIN t b ON a.id = b.id AND a.candidate <> b.candidate GROUP BY ALL)
SELECT p.a AS candidate, {d('max(c)', 'max_pairwise_corr', 4)}, {d('max(j)', 'max_changed_jaccard', 4)}, {d('max(coalesce(o, 0))', 'max_top_overlap', 4)} FROM p LEFT JOIN o ON p.a = o.a AND p.b = o.b GROUP BY p.a""",
    digits=4,
)
def drf_7(spark, sf):
    return D.most_similar(D.candidate_similarity(candidates(spark, sf), NAMES))


@query(
    "DRF-8",
    f"""WITH {CENT_SQL}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_grp ORDER BY cosine DESC, train_grp) AS pos FROM cosine) WHERE pos = 1),
r AS (SELECT grp, avg(y) AS rm, stddev_pop(y) AS rs FROM spectra WHERE grp <= 6 GROUP BY grp),
o AS (SELECT grp, count(*) AS n, avg(60 + 40 * x[6]) AS m, stddev_pop(60 + 40 * x[6]) AS s FROM spectra WHERE grp > 6 GROUP BY grp)
SELECT test_grp, train_grp, {i('n', 'n')}, {d('m - rm', 'mean_shift')}, {d('s / greatest(rs, 1e-12)', 'sd_ratio')},
  CASE WHEN s < 0.85 * rs THEN 'compressed' WHEN s > 1.15 * rs THEN 'expanded' WHEN abs(m - rm) > 0.15 * greatest(rs, 1) THEN 'mean_shift' ELSE 'aligned' END AS assessment
FROM k JOIN o ON o.grp = test_grp JOIN r ON r.grp = train_grp""",
)
def drf_8(spark, sf):
    te = test(spark, sf)
    pred = te.withColumn("y_pred", F.get("x", F.lit(5)) * 40 + 60)
    return D.range_assessment(pred, te, train(spark, sf))


@query(
    "DRF-9",
    f"""WITH {CAND_SQL}, a AS (SELECT candidate, sqrt(avg((pred - anchor) ** 2)) / 100 AS r, sqrt(avg((pred - y_true) ** 2)) / 1000 AS c FROM cand GROUP BY candidate)
SELECT candidate, {d('r', 'diff_rmse')}, {d('c', 'cv_rmse')}, r > 0 AND r < 10 AS pass_diff, c <= 21 AS pass_cv, r > 0 AND r < 10 AND c <= 21 AS pass_both FROM a""",
)
def drf_9(spark, sf):
    long = candidates(spark, sf)
    e = F.col("pred") - F.col("y_true")
    cv = long.groupBy("candidate").agg((F.sqrt(F.avg(e * e)) / 1000).alias("cv_rmse"))
    diffs = long.groupBy("candidate").agg((F.sqrt(F.avg(D.diff() * D.diff())) / 100).alias("diff_rmse"))
    return D.submission_gate(diffs, cv, 19.0)


# ---- CMP -------------------------------------------------------------------------------

# Event types stand for validation strategies; sign-ups for the measured score of every third experiment.
STRATEGY_OF = {"view": "leave_one_species", "error": "group_species", "purchase": "random", "click": "target_stratified"}
LOCAL = list(STRATEGY_OF.values())
LATEST_SQL = RUNS_SQL + """,
last_ AS (SELECT experiment, strategy, arg_max(mean_score, (timestamp, run_id)) AS s FROM runs GROUP BY 1, 2),
local_ AS (SELECT experiment, max(CASE WHEN strategy = 'view' THEN s END) AS leave_one_species, max(CASE WHEN strategy = 'error' THEN s END) AS group_species,
  max(CASE WHEN strategy = 'purchase' THEN s END) AS random, max(CASE WHEN strategy = 'click' THEN s END) AS target_stratified,
  CASE WHEN experiment % 3 = 0 THEN max(CASE WHEN strategy = 'signup' THEN s END) END AS measured FROM last_ GROUP BY experiment)"""


def score_log(spark, sf):
    names = F.create_map(*[v for k, s in STRATEGY_OF.items() for v in (F.lit(k), F.lit(s))])
    return runs(spark, sf).withColumn("strategy", F.coalesce(names[F.col("strategy")], F.col("strategy")))


def local_scores(spark, sf):
    wide = K.latest_scores(score_log(spark, sf), [*LOCAL, "signup"])
    return wide.withColumn("measured", F.when(F.col("experiment") % 3 == 0, F.col("signup"))).drop("signup")


@query(
    "CMP-1",
    f"""WITH {LATEST_SQL} SELECT experiment, {d('(coalesce(0.5 * group_species, 0) + coalesce(0.3 * measured, 0) + coalesce(0.2 * random, 0)) / nullif(CASE WHEN group_species IS NULL THEN 0 ELSE 0.5 END + CASE WHEN measured IS NULL THEN 0 ELSE 0.3 END + CASE WHEN random IS NULL THEN 0 ELSE 0.2 END, 0)', 'composite_score')} FROM local_""",
)
def cmp_1(spark, sf):
    return local_scores(spark, sf).select(
        "experiment", K.composite(F.col("group_species"), F.col("measured"), F.col("random")).alias("composite_score")
    )


@query(
    "CMP-2",
    f"""WITH {LATEST_SQL} SELECT experiment, {', '.join(d(c, c) for c in LOCAL)} FROM local_""",
)
def cmp_2(spark, sf):
    return K.latest_scores(score_log(spark, sf))


# The experiment number decides predictor, preprocessor and name, so that every branch is met.
NAMED_SQL = LATEST_SQL + """,
named AS (SELECT *, CASE experiment % 4 WHEN 0 THEN 'single_feature_linear' WHEN 1 THEN 'topk_ridge' WHEN 2 THEN 'mean' ELSE 'single_feature_stable_wavelength' END AS predictor,
  CASE experiment % 4 WHEN 3 THEN 'spectral_snv_diff1' ELSE 'spectral' END AS preprocessor,
  CASE WHEN experiment % 7 = 0 THEN -(experiment % 100) / 100.0 END AS w,
  CASE WHEN experiment % 7 = 0 THEN 'candidate_linear_1f_anti_nn_bias_wm' || lpad(CAST(experiment % 100 AS VARCHAR), 3, '0') WHEN experiment % 11 = 0 THEN 'lowtail_' || experiment ELSE 'exp_' || experiment END AS name FROM local_),
pts AS (SELECT w, measured AS s FROM named WHERE w IS NOT NULL AND measured IS NOT NULL),
pm AS (SELECT count(*)::DOUBLE AS n, sum(w) AS p1, sum(w ** 2) AS p2, sum(w ** 3) AS p3, sum(w ** 4) AS p4, sum(s * s) AS q0, sum(w * s * s) AS q1, sum(w * w * s * s) AS q2 FROM pts),
dt AS (SELECT *, p4 * (p2 * n - p1 * p1) - p3 * (p3 * n - p1 * p2) + p2 * (p3 * p1 - p2 * p2) AS det FROM pm WHERE n >= 3),
qf AS (SELECT (q2 * (p2 * n - p1 * p1) - p3 * (q1 * n - p1 * q0) + p2 * (q1 * p1 - p2 * q0)) / det AS a,
  (p4 * (q1 * n - q0 * p1) - q2 * (p3 * n - p1 * p2) + p2 * (p3 * q0 - q1 * p2)) / det AS b,
  (p4 * (p2 * q0 - p1 * q1) - p3 * (p3 * q0 - p2 * q1) + q2 * (p3 * p1 - p2 * p2)) / det AS c FROM dt)"""


def named_scores(spark, sf):
    e = F.col("experiment")
    name = (
        F.when(e % 7 == 0, F.concat(F.lit("candidate_linear_1f_anti_nn_bias_wm"), F.lpad((e % 100).cast("string"), 3, "0")))
        .when(e % 11 == 0, F.concat(F.lit("lowtail_"), e.cast("string")))
        .otherwise(F.concat(F.lit("exp_"), e.cast("string")))
    )
    pred = F.element_at(F.array(*[F.lit(v) for v in ("single_feature_linear", "topk_ridge", "mean", "single_feature_stable_wavelength")]), (e % 4 + 1).cast("int"))
    df = local_scores(spark, sf).withColumn("name", name).withColumn("predictor", pred)
    df = df.withColumn("preprocessor", F.when(e % 4 == 3, "spectral_snv_diff1").otherwise("spectral"))
    return df.withColumn("w", K.weight_from_name(F.col("name"), "candidate_linear_1f_anti_nn_bias_w"))


@query(
    "CMP-3",
    f"""WITH {NAMED_SQL}, e AS (SELECT experiment, leave_one_species AS l, group_species AS g, random AS r, measured, CASE WHEN w IS NOT NULL THEN CASE WHEN a * w * w + b * w + c > 0 THEN sqrt(a * w * w + b * w + c) END END AS quad,
  CASE WHEN predictor LIKE 'single%' AND preprocessor = 'spectral_snv_diff1' THEN 'estimated_anchor_snv_diff1' WHEN predictor = 'single_feature_linear' THEN 'estimated_simple_linear'
    WHEN predictor = 'topk_ridge' THEN 'estimated_complex' ELSE 'estimated_median' END AS fam FROM named LEFT JOIN qf ON true),
f AS (SELECT *, CASE fam WHEN 'estimated_anchor_snv_diff1' THEN [0.55, 0.25, 0.20] WHEN 'estimated_simple_linear' THEN [0.35, 0.35, 0.30] ELSE [0.15, 0.35, 0.50] END AS k FROM e),
v AS (SELECT *, CASE WHEN fam = 'estimated_median' THEN list_median(list_filter([l, g, r], lambda t: t IS NOT NULL)) ELSE
  (coalesce(k[1] * l, 0) + coalesce(k[2] * g, 0) + coalesce(k[3] * r, 0)) / nullif(CASE WHEN l IS NULL THEN 0 ELSE k[1] END + CASE WHEN g IS NULL THEN 0 ELSE k[2] END + CASE WHEN r IS NULL THEN 0 ELSE k[3] END, 0) END AS fv FROM f)
SELECT experiment, {d('coalesce(measured, quad, fv)', 'estimate', 5)}, CASE WHEN measured IS NOT NULL THEN 'measured' WHEN quad IS NOT NULL THEN 'public_feedback_quadratic' WHEN fv IS NOT NULL THEN fam ELSE 'missing' END AS source FROM v""",
    digits=5,
)
def cmp_3(spark, sf):
    """The cascade without the fitted proxy (see CMP-5)."""
    return estimated(spark, sf).select("experiment", "estimate", "source")


def estimated(spark, sf, proxy=False):
    df = cut(named_scores(spark, sf))
    coef = K.quadratic_path(df.where("w IS NOT NULL AND measured IS NOT NULL"), "w", "measured")
    features = ["leave_one_species", "group_species", "random"]
    fitted = K.proxy_score(K.fit_proxy(df, features) if proxy else None, features)
    ready = df.withColumn("quadratic", K.on_path(F.col("w"), coef)).withColumn("fitted", fitted)
    return K.estimate(ready.withColumn("family", K.family(F.col("name"), F.col("predictor"), F.col("preprocessor"))))


@query("CMP-4", f"WITH {NAMED_SQL} SELECT {d('a', 'a', 2)}, {d('b', 'b', 2)}, {d('c', 'c', 2)} FROM qf", digits=2)
def cmp_4(spark, sf):
    coef = K.quadratic_path(named_scores(spark, sf).where("w IS NOT NULL AND measured IS NOT NULL"), "w", "measured")
    return spark.createDataFrame([] if coef is None else [coef], "a double, b double, c double")


@query("CMP-5", digits=4)
def cmp_5(spark, sf):
    df = local_scores(spark, sf)
    features = ["leave_one_species", "group_species", "random"]
    return df.select("experiment", K.proxy_score(K.fit_proxy(df, features), features).alias("fitted"))


@query("CMP-6", digits=4)
def cmp_6(spark, sf):
    """Ranked table of the full cascade."""
    df = estimated(spark, sf, proxy=True).withColumn("denied", K.denied(F.col("name"), F.col("predictor")))
    return K.ranked(df).select("experiment", "name", "estimate", "source", "denied", "leave_one_species")


@query("CMP-7", digits=4)
def cmp_7(spark, sf):
    df = local_scores(spark, sf).where("measured IS NOT NULL AND leave_one_species IS NOT NULL AND group_species IS NOT NULL AND random IS NOT NULL")
    return K.ridge_audit(df, ["leave_one_species", "group_species", "random"], "measured", "experiment")


@query(
    "CMP-8",
    f"""WITH {LATEST_SQL}, l AS (SELECT experiment, measured AS t, unnest(['leave_one_species', 'group_species', 'random', 'target_stratified']) AS metric,
  unnest([leave_one_species, group_species, random, target_stratified]) AS v FROM local_ WHERE measured IS NOT NULL),
r AS (SELECT *, {AVG_RANK.format(k='PARTITION BY metric', v='v')} AS rv, {AVG_RANK.format(k='PARTITION BY metric', v='t')} AS rt FROM l WHERE v IS NOT NULL)
SELECT metric, {i('count(*)', 'n')}, {d('corr(v, t)', 'pearson')}, {d('corr(rv, rt)', 'spearman')}, {d('avg(abs(rv - rt))', 'rank_error')} FROM r GROUP BY metric HAVING count(*) >= 3""",
)
def cmp_8(spark, sf):
    return K.metric_alignment(local_scores(spark, sf), LOCAL)


# ---- WGT -------------------------------------------------------------------------------


@query(
    "WGT-1",
    f"""WITH {PAIR_SQL}, r AS (SELECT id, ({AVG_RANK.format(k='PARTITION BY 1', v='y_true')}) / count(*) OVER () AS p FROM pair),
w AS (SELECT id, CASE WHEN p <= 0.2 THEN 1.1 WHEN p >= 0.8 THEN 0.9 ELSE 1 END AS w FROM r)
SELECT id, {d('w / avg(w) OVER ()', 'w')} FROM w""",
)
def wgt_1(spark, sf):
    return W.percentile_weights(pred_pair(spark, sf), "y_true", "id", "low110_high090").select("id", "w")


@query(
    "WGT-2",
    f"""WITH {PAIR_SQL}, e AS (SELECT id, abs(y_pred - y_true) AS e FROM pair), q AS (SELECT quantile_cont(e, 0.9) AS q, max(e) AS m FROM e)
SELECT id, {d('1 + (0.7 - 1) * pow(greatest(0, least(1, (e - q) / (m - q))), 2)', 'down')}, {d('1 + (1.3 - 1) * pow(greatest(0, least(1, (e - q) / (m - q))), 0.5)', 'up')} FROM e, q""",
)
def wgt_2(spark, sf):
    df = pred_pair(spark, sf).select("id", F.expr("abs(y_pred - y_true)").alias("e"))
    return W.tail_weight(W.tail_weight(df, "e", 0.1, 0.7, 2.0, "down"), "e", 0.1, 1.3, 0.5, "up").select("id", "down", "up")


@query(
    "WGT-3",
    f"""WITH {PAIR_SQL}, r AS (SELECT id, (row_number() OVER (ORDER BY abs(y_pred - y_true), id) - 1) / (count(*) OVER () - 1) AS a, (row_number() OVER (ORDER BY y_pred, id) - 1) / (count(*) OVER () - 1) AS b FROM pair)
SELECT id, {d('0.7 * a + 0.3 * b', 'score')} FROM r""",
)
def wgt_3(spark, sf):
    df = pred_pair(spark, sf).select("id", F.expr("abs(y_pred - y_true)").alias("yj"), F.col("y_pred").alias("lev"))
    return W.reliability_score(df, "yj_lev").select("id", "score")


@query("WGT-4", digits=5)
def wgt_4(spark, sf):
    """Leverage on all components of all bands."""
    return W.leverage(train(spark, sf), spectra(spark, sf), 64).select("id", "lev")


@query("WGT-5", digits=4)
def wgt_5(spark, sf):
    return W.transformed_residual(Cv.group_kfold(train(spark, sf), 3), "fold_id", 10, 100.0).select("id", "yj")


@query("WGT-6")
def wgt_6(spark, sf):
    return W.late_selection_weights(train(spark, sf), 6, 0.2, 0.7, 1.0).select("id", "w")


@query(
    "WGT-7",
    f"""WITH {PAIR_SQL}, w AS (SELECT id, grp, 0.5 + 10 * discount + CASE WHEN grp = 'A' THEN 0.5 ELSE 0 END AS w FROM pair), g AS (SELECT *, avg(w) OVER (PARTITION BY grp) AS m FROM w)
SELECT id, {d('w / m', 'balanced')}, {d('w * CASE WHEN m > 1.1 THEN 1.1 / m WHEN m < 0.9 THEN 0.9 / m ELSE 1 END', 'capped')} FROM g""",
)
def wgt_7(spark, sf):
    w = F.col("discount") * 10 + 0.5 + F.when(F.col("grp") == "A", 0.5).otherwise(0.0)
    df = pred_pair(spark, sf).select("id", "grp", w.alias("balanced"), w.alias("capped"))
    return W.cap_groups(W.balance_groups(df, "balanced"), "capped", 1.1).select("id", "balanced", "capped")


@query("WGT-8", digits=4)
def wgt_8(spark, sf):
    p = cut(W.domain_classifier(train(spark, sf), test(spark, sf)).where("domain = 'train'").select("id", "p_test"))
    return W.odds_weights(W.bounded_rank_weights(p, "p_test", name="bounded"), "p_test", "odds").select("id", "bounded", "odds")


@query("WGT-8-forest", digits=4)
def wgt_8_forest(spark, sf):
    p = W.domain_classifier(train(spark, sf), test(spark, sf), model="forest")
    return p.select("id", "domain", "p_test")


@query("WGT-9", digits=4)
def wgt_9(spark, sf):
    tr, te = train(spark, sf), test(spark, sf)
    a = W.test_likeness(tr, te, "knn_cluster", 10, 6)
    return a.join(W.test_likeness(tr, te, "centroid", name="centroid"), "id")


# ---- DET -------------------------------------------------------------------------------


def branch_rows(spark, sf):
    """Train rows with folds, an anchor prediction and two branch predictions, all out of fold."""
    df = Cv.group_kfold(train(spark, sf), 3)
    df = Cv.out_of_fold(df, lambda g: Fi.So.one_band(g), name="y_pred")
    df = Cv.out_of_fold(df, lambda g: Fi.So.pls(g, 2), name="b1")
    return df.withColumn("s1", F.col("b1") - F.col("y_pred"))


@query("DET-1", digits=4)
def det_1(spark, sf):
    df = De.hard_labels(branch_rows(spark, sf))
    ready = cut(De.detector_features(df, "y_pred", ["s1"]).select("id", "grp", "fold_id", "x", "hard80", "poshard70", "high80", "under_high"))
    out, _ = De.detector_scores(ready, None, "hard80")
    return out.select("id", "hard80", "poshard70", "high80", "under_high", "score")


@query(
    "DET-1-labels",
    f"""WITH {LOGO_SQL}, e AS (SELECT *, y_true - y_pred AS r, abs(y_true - y_pred) AS a FROM oof),
q AS (SELECT quantile_cont(a, 0.7) AS a70, quantile_cont(a, 0.8) AS a80, quantile_cont(y_true, 0.8) AS y80, quantile_cont(y_pred, 0.7) AS p70 FROM e)
SELECT id, {i('(a >= a80)::INT', 'hard80')}, {i('(r > 0 AND a >= a70)::INT', 'poshard70')}, {i('(y_true >= y80)::INT', 'high80')}, {i('(r > 0 AND y_pred >= p70)::INT', 'under_high')} FROM e, q""",
)
def det_1_labels(spark, sf):
    return De.hard_labels(Fi.one_band_oof(Cv.leave_one_group(train(spark, sf)))).select("id", "hard80", "poshard70", "high80", "under_high")


@query("DET-2", digits=4)
def det_2(spark, sf):
    df = De.branch_win(branch_rows(spark, sf), "y", "y_pred", "b1")
    ready = cut(De.detector_features(df, "y_pred", ["s1"]).select("id", "fold_id", "x", "win"))
    out, _ = De.detector_scores(ready, None, "win", model="logistic")
    return out.select("id", "win", "score")


@query(
    "DET-2-labels",
    f"""WITH {CAND_SQL} SELECT candidate, id, {i('(abs(y_true - pred) + greatest(1, 0.08 * abs(y_true - anchor)) < abs(y_true - anchor))::INT', 'win')} FROM cand""",
)
def det_2_labels(spark, sf):
    return De.branch_win(candidates(spark, sf), "y_true", "anchor", "pred").select("candidate", "id", "win")


LOF_SQL = TRAIN_SQL + """,
pr AS (SELECT a.id AS q, b.id AS r, sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.x[k] - b.x[k]) ** 2))) AS dd FROM train a JOIN train b ON a.id <> b.id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dd, r) AS pos FROM pr) WHERE pos <= 20),
kd AS (SELECT q, max(dd) AS kd FROM nn GROUP BY q), lrd AS (SELECT nn.q, 1 / (avg(greatest(dd, kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.q = nn.r GROUP BY nn.q),
tp AS (SELECT a.id AS q, b.id AS r, sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.x[k] - b.x[k]) ** 2))) AS dd FROM test a, train b),
tn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dd, r) AS pos FROM tp) WHERE pos <= 20)"""


@query(
    "DET-3-lof",
    f"""WITH {LOF_SQL} SELECT tn.q AS id, {d('avg(lrd) / (1 / (avg(greatest(dd, kd)) + 1e-10))', 'lof')} FROM tn JOIN kd ON kd.q = tn.r JOIN lrd ON lrd.q = tn.r GROUP BY tn.q""",
)
def det_3_lof(spark, sf):
    return De.local_outlier_factor(train(spark, sf), test(spark, sf), 20)


@query("DET-3", digits=4)
def det_3(spark, sf):
    return De.outlier_score(train(spark, sf), test(spark, sf))
