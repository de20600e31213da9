"""SRC, SNK, UDF and GRD: sources, sinks, registries and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.preprocessors import get_preprocessor
from ..operators import corrections as C
from ..operators import drift as D
from ..operators import fits as Fi
from ..operators import folds as Cv
from ..operators import grids as Gr
from ..operators import groups as G
from ..operators import moments as M
from ..operators import targets as T
from ..session import cut, scratch_path
from ..sources import logs, predictions, spectra_csv
from . import experiments as E
from .fixtures import CAND_SQL, LONG_SQL, N_BANDS, PAIR_SQL, RUNS_SQL, SPECTRA_SQL, TRAIN_SQL, candidates, pred_pair, runs, spectra, test, train
from .predictors import get_predictor
from .q_arrays import unroll
from .q_compare import NAMES, drf_6_tables
from .q_corrections import BASE_SQL, base
from .q_fits import LOGO_SQL
from .q_stats import SCAN_SQL, scan
from .registry import d, i, query

WAVELENGTHS = [10000.0 - 25.0 * k for k in range(N_BANDS)]


def stored_spectra(spark, sf):
    """The spectra written out as a code page 932 CSV with Japanese column names."""
    path = scratch_path(spark, "spectra-csv")
    df = spectra(spark, sf).withColumn("grp_no", F.col("grp")).withColumn("grp", F.concat(F.lit("樹"), F.col("grp").cast("string")))
    spectra_csv.write_spectra(df, path, WAVELENGTHS)
    return path


# ---- SRC -------------------------------------------------------------------------------


@query(
    "SRC-1",
    f"WITH {SPECTRA_SQL} SELECT id, '樹' || grp AS grp, {i('grp', 'grp_no')}, {d('y', 'y')}, {d('list_sum(x)', 'x_sum')}, {d('x[64]', 'x_last')} FROM spectra",
)
def src_1(spark, sf):
    from ..functions.arrays import total

    df = spectra_csv.read_spectra(spark, stored_spectra(spark, sf))
    return df.select("id", "grp", "grp_no", "y", total(F.col("x")).alias("x_sum"), F.get("x", F.lit(N_BANDS - 1)).alias("x_last"))


@query(
    "SRC-2",
    f"WITH {SPECTRA_SQL} SELECT {i('unnest(range(64))', 'band')}, {d('10000 - 25 * unnest(range(64))', 'wavelength')}, {i('count(*)', 'n_rows')} FROM spectra",
)
def src_2(spark, sf):
    path = stored_spectra(spark, sf)
    cols = spectra_csv.header(spark, path)
    bands = spectra_csv.spectral_columns(cols)
    if bands != spectra_csv.spectral_columns(cols, "numeric"):
        raise ValueError("the two discovery rules disagree")
    n = spectra_csv.raw_scan(spark, path).count()
    return spectra_csv.band_table(spark, bands).withColumn("n_rows", F.lit(n))


@query(
    "SRC-3",
    f"""WITH {TRAIN_SQL}, b AS (SELECT grp, y FROM train UNION ALL SELECT NULL, y FROM train)
SELECT grp, {i('count(*)', 'n')}, {d('min(y)', 'min')}, {d('avg(y)', 'mean')}, {d('max(y)', 'max')}, {d('stddev_pop(y)', 'std')}, {d('median(y)', 'median')} FROM b GROUP BY grp""",
)
def src_3(spark, sf):
    return spectra_csv.profile_targets(train(spark, sf))


@query(
    "SRC-3-groups",
    f"""WITH {TRAIN_SQL} SELECT 'train_groups' AS measure, {i('count(DISTINCT grp)', 'n')} FROM train UNION ALL SELECT 'test_groups', count(DISTINCT grp) FROM test
UNION ALL SELECT 'shared_groups', count(*) FROM (SELECT grp FROM train INTERSECT SELECT grp FROM test)""",
)
def src_3_groups(spark, sf):
    return spectra_csv.profile_groups(train(spark, sf), test(spark, sf))


@query(
    "SRC-3-profile",
    f"""WITH {SPECTRA_SQL}, a AS (SELECT grp, count(*) AS n FROM spectra WHERE grp <= 6 GROUP BY grp), b AS (SELECT grp, count(*) AS n FROM spectra WHERE grp >= 5 GROUP BY grp)
SELECT 'train_rows' AS measure, {i('sum(n)', 'n')}, NULL::DOUBLE AS value FROM a UNION ALL SELECT 'test_rows', sum(n), NULL FROM b
UNION ALL SELECT 'train_columns', 68, NULL UNION ALL SELECT 'test_columns', 67, NULL UNION ALL SELECT 'wavelengths', 64, NULL
UNION ALL SELECT 'wavelength_first', NULL, 10000 UNION ALL SELECT 'wavelength_last', NULL, 10000 - 25 * 63
UNION ALL SELECT 'shared:樹' || a.grp, a.n + b.n, NULL FROM a JOIN b ON a.grp = b.grp""",
)
def src_3_profile(spark, sf):
    """Two stored datasets with the groups 5 and 6 in both; the second has no target column."""
    sides = []
    for name, keep in (("train", F.col("grp") <= 6), ("test", F.col("grp") >= 5)):
        path = scratch_path(spark, f"profile-{name}")
        df = spectra(spark, sf).where(keep).withColumn("grp_no", F.col("grp")).withColumn("grp", F.concat(F.lit("樹"), F.col("grp").cast("string")))
        spectra_csv.write_spectra(df if name == "train" else df.drop("y"), path, WAVELENGTHS)
        sides.append((spectra_csv.read_spectra(spark, path), spectra_csv.raw_scan(spark, path).columns))
    (train_, a), (test_, b) = sides
    return spectra_csv.profile_dataset(train_, test_, a, b)


@query("SRC-4", f"WITH {PAIR_SQL} SELECT id, {d('y_pred', 'pred')} FROM pair")
def src_4(spark, sf):
    """Files with every id twice, first all first lines: the last line counts."""
    path = scratch_path(spark, "predictions")
    df = pred_pair(spark, sf).select("id", F.col("y_pred").alias("pred"))
    twice = df.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    lines = twice.select("id", F.when(F.col("k") == 1, F.col("pred")).otherwise(-1.0).alias("pred"), "k")
    lines.orderBy("k", "id").drop("k").write.csv(path, header=False)
    return predictions.read_predictions(spark, path)


# ---- SNK -------------------------------------------------------------------------------


@query("SNK-1", f"WITH {PAIR_SQL} SELECT id, {d('y_pred', 'pred')} FROM pair")
def snk_1(spark, sf):
    path = scratch_path(spark, "submission")
    predictions.write_predictions(pred_pair(spark, sf).withColumnRenamed("y_pred", "pred"), path)
    return predictions.read_predictions(spark, path)


@query(
    "SNK-2",
    f"""WITH {LOGO_SQL} SELECT 'candidate_linear_1f' AS experiment, 'leave_one_species' AS cv, {i('fold', 'fold_id')}, id, grp, {d('y_true', 'y_true')}, {d('y_pred', 'y_pred')},
  {d('y_pred - y_true', 'error')}, {d('abs(y_pred - y_true)', 'abs_error')} FROM oof""",
)
def snk_2(spark, sf):
    path = scratch_path(spark, "oof")
    oof = Fi.one_band_oof(Cv.leave_one_group(train(spark, sf))).withColumn("y_true", F.col("y"))
    predictions.write_oof(predictions.oof_rows(oof, "candidate_linear_1f", "leave_one_species"), path)
    return spark.read.parquet(path).where("cv = 'leave_one_species'")


@query(
    "SNK-3",
    f"""WITH {PAIR_SQL}, f AS (SELECT id % 5 AS fold_id, sqrt(avg((y_pred - y_true) ** 2)) AS r FROM pair GROUP BY 1)
SELECT 'candidate_linear_1f' AS experiment_name, {i('count(*)', 'n_test')}, {d('min(y_pred)', 'p_min', 3)}, {d('max(y_pred)', 'p_max', 3)}, {d('avg(y_pred)', 'p_mean', 3)},
  (SELECT round(avg(r), 3) FROM f) AS mean_score, {i('count(DISTINCT grp)', 'n_groups')} FROM pair""",
    digits=3,
)
def snk_3(spark, sf):
    path = scratch_path(spark, "runlog")
    oof = pred_pair(spark, sf).withColumn("fold_id", F.col("id") % 5)
    summary = oof.agg(
        F.count("*").alias("n_test"), F.struct(F.min("y_pred").alias("min"), F.max("y_pred").alias("max"), F.avg("y_pred").alias("mean")).alias("prediction_summary")
    )
    fields = {"experiment_name": "candidate_linear_1f", "preprocessor": "spectral", "predictor": "single_feature_linear", "cv_strategy": "random", "submit": False}
    logs.write_run_log(logs.run_record(summary, oof, fields), path)
    p = F.col("prediction_summary")
    return logs.read_run_log(spark, path).select(
        "experiment_name", "n_test", p["min"].alias("p_min"), p["max"].alias("p_max"), p["mean"].alias("p_mean"),
        F.col("cv.mean_score").alias("mean_score"), F.size("cv.oof_by_species").alias("n_groups"),
    )


@query(
    "SNK-4",
    f"""WITH {RUNS_SQL} SELECT CAST(experiment AS VARCHAR) AS experiment_name, strategy AS cv_strategy, {i('count(*)', 'n')}, {d('avg(mean_score)', 'mean_score')} FROM runs GROUP BY 1, 2""",
)
def snk_4(spark, sf):
    """Rows appended in two goes under the fixed schema."""
    path = scratch_path(spark, "leaderboard")
    df = runs(spark, sf).select(F.col("experiment").cast("string").alias("experiment_name"), F.col("strategy").alias("cv_strategy"), "mean_score", "run_id")
    for part in (0, 1):
        logs.append_leaderboard(df.where(F.col("run_id") % 2 == part), path)
    return logs.read_leaderboard(spark, path).groupBy("experiment_name", "cv_strategy").agg(F.count("*").alias("n"), F.avg("mean_score").alias("mean_score"))


@query(
    "SNK-5",
    f"""WITH {PAIR_SQL}, r AS (SELECT id, y_true / 1000 AS m, y_pred / 1000 AS g, discount * 1000 AS l, tax * 1000 AS q FROM pair)
SELECT CAST(id AS VARCHAR) AS experiment_name, CASE WHEN abs(g - m) <= abs(l - m) AND abs(g - m) <= abs(q - m) THEN 'group_species_rmse' WHEN abs(l - m) <= abs(q - m) THEN 'leave_one_species_rmse' ELSE 'random_rmse' END AS best_local_metric,
  {d('abs(m - CASE WHEN abs(g - m) <= abs(l - m) AND abs(g - m) <= abs(q - m) THEN g WHEN abs(l - m) <= abs(q - m) THEN l ELSE q END)', 'local_public_gap')} FROM r""",
)
def snk_5(spark, sf):
    path = scratch_path(spark, "scorelog")
    df = pred_pair(spark, sf).select(
        F.col("id").cast("string").alias("experiment_name"), (F.col("y_true") / 1000).alias("public_score"), (F.col("y_pred") / 1000).alias("group_species_rmse"),
        (F.col("discount") * 1000).alias("leave_one_species_rmse"), (F.col("tax") * 1000).alias("random_rmse"),
    )
    logs.append_score_log(df, path)
    return logs.read_score_log(spark, path).select("experiment_name", "best_local_metric", "local_public_gap")


# ---- UDF -------------------------------------------------------------------------------


@query("UDF-1", digits=4)
def udf_1(spark, sf):
    """Preprocessor contract: fitted on train, applied to test."""
    pre = get_preprocessor("spectral_msc")
    params = pre.fit(train(spark, sf))
    return unroll(pre.transform(test(spark, sf), params))


@query(
    "UDF-2",
    f"""WITH {LONG_SQL}, w AS (SELECT band, corr(v, y) AS c, regr_slope(y, v) AS b, regr_intercept(y, v) AS a FROM bands WHERE grp <= 6 GROUP BY band),
top AS (SELECT * FROM w ORDER BY abs(c) DESC, band LIMIT 1) SELECT id, {d('a + b * x[band + 1]', 'y_pred')} FROM spectra, top WHERE grp > 6""",
)
def udf_2(spark, sf):
    """Predictor contract: fit on train rows, predict test rows."""
    return E.predict_test(train(spark, sf), test(spark, sf), "candidate_linear_1f").select("id", "y_pred")


GRID_NAMES = ("baseline_mean", "pls_snv_c2", "pls_snv_c4", "ridge_snv_alpha100", "pls_diff1_c8", "ridge_diff1_alpha10", "candidate_raw_pca50_ridge100")


@query("UDF-3", digits=4)
def udf_3(spark, sf):
    """Registered experiments by name, evaluated over shared matrices."""
    return E.grid(Cv.leave_one_group(train(spark, sf)), GRID_NAMES)


@query("UDF-3-board", digits=4)
def udf_3_board(spark, sf):
    _, board = E.evaluate(train(spark, sf), "candidate_linear_1f", "leave_one_species")
    return board


# ---- GRD -------------------------------------------------------------------------------

SHRINKS, CLIPS = (0.1, 0.3, 0.5), (500.0, 2000.0)


@query(
    "GRD-1",
    f"""WITH {BASE_SQL}, f AS (SELECT regr_slope(y, p) AS b, regr_intercept(y, p) AS a FROM base),
g AS (SELECT unnest([0.1, 0.3, 0.5]) AS shrink), h AS (SELECT unnest([500.0, 2000.0]) AS clip),
e AS (SELECT shrink, clip, y, p + greatest(least(shrink * (a + b * p - p), clip), -clip) AS q FROM base, f, g, h)
SELECT {d('shrink', 'shrink')}, {d('clip', 'clip')}, {d('sqrt(avg((q - y) ** 2))', 'rmse', 4)}, {d('avg(q - y)', 'bias', 4)} FROM e GROUP BY shrink, clip""",
    digits=4,
)
def grd_1(spark, sf):
    """All settings of an affine correction in one aggregate keyed by setting."""
    df = base(spark, sf)
    b, a = C.affine_fit(df)
    rows = Gr.explode_specs(df.select("y", "p"), Gr.settings(shrink=SHRINKS, clip=CLIPS)).select("y", "p", "spec.shrink", "spec.clip")
    delta = (F.lit(a) + F.col("p") * b - F.col("p")) * F.col("shrink")
    e = F.col("p") + F.greatest(F.least(delta, F.col("clip")), -F.col("clip")) - F.col("y")
    return rows.groupBy("shrink", "clip").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


@query("GRD-2", digits=4)
def grd_2(spark, sf):
    """Cheap scores for all, the best three again with other folds."""
    tr = train(spark, sf)
    cheap = E.grid(Cv.group_kfold(tr, 3), GRID_NAMES).select(F.col("experiment").alias("name"), F.col("rmse").alias("cheap"))
    again = lambda names: E.grid(Cv.leave_one_group(tr), names).select(F.col("experiment").alias("name"), F.col("rmse").alias("nested"))
    return Gr.recheck(cut(cheap), "cheap", 3, again)


@query("GRD-3", digits=4)
def grd_3(spark, sf):
    """Candidates that pass a wide gate and are not too alike."""
    wide = {**D.Q5_GATE, "changed": (1, 10**12), "rmse": (1e-9, 1e9), "max_diff": 1e9, "group_shift": 1e9, "per_group": 10**12, "top10": 10, "oof": 1e9, "groups": 0, "gate_corr": -1.0, "increment_corr": 2.0, "prior_corr": 2.0, "overlap": 2.0}
    table = D.candidate_gate(D.candidate_diagnostics(*drf_6_tables(spark, sf), clip=1e12), wide)
    alike = D.most_similar(D.candidate_similarity(candidates(spark, sf), NAMES))
    out = Gr.keep_worthy(table.join(alike, "candidate"), ["oof_delta", "candidate"], 3, 1.01, 1.01)
    return out.select("candidate", "oof_delta", "submit_gate", "max_pairwise_corr")


@query(
    "GRD-4",
    f"""WITH {BASE_SQL}, f AS (SELECT regr_slope(y, p) AS b, regr_intercept(y, p) AS a FROM base),
s1_ AS (SELECT id, y, s2, p + 0.5 * (a + b * p - p) AS p FROM base, f), bt AS (SELECT greatest(least(sum(s2 * (y - p)) / sum(s2 * s2), 1), -1) AS beta FROM s1_),
s2_ AS (SELECT id, y, p + greatest(least(0.5 * beta * s2, 2000.0::DOUBLE), -2000.0::DOUBLE) AS p FROM s1_, bt)
SELECT id, {d('p', 'p', 3)} FROM s2_""",
    digits=3,
)
def grd_4(spark, sf):
    """Affine step, then distillation on what it leaves."""

    def affine(df):
        return C.affine_delta(df, df, 0.5, None, centre=False, name="q").drop("p").withColumnRenamed("q", "p")

    def branch(df):
        b = C.beta(df, "s2", "r")
        return C.add_delta(df, "p", F.col("s2") * (0.5 * b), 2000.0, False, "q").drop("p").withColumnRenamed("q", "p")

    return Gr.chain(base(spark, sf), [affine, branch]).select("id", "p")


@query(
    "GRD-5",
    f"""WITH {TRAIN_SQL}, dd AS (SELECT sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.x[k] - b.x[k]) ** 2))) AS dist FROM train a JOIN train b ON a.id < b.id)
SELECT {d('1 / median(dist) ** 2', 'gamma')} FROM dd WHERE dist > 1e-12""",
)
def grd_5(spark, sf):
    return spark.createDataFrame([(Gr.bandwidth(train(spark, sf)),)], "gamma double")


@query(
    "GRD-6",
    f"""WITH {SCAN_SQL}, k AS (SELECT * FROM scan WHERE usable >= 0.88 OR usable >= 0.1)
SELECT {i('win_start', 'win_start')}, {i('win_end', 'win_end')}, {d('usable', 'usable')} FROM k ORDER BY usable DESC, win_start, win_end LIMIT 20""",
)
def grd_6(spark, sf):
    """Threshold pick list; the fixture's group score is scaled so that its threshold is 0.1."""
    df = scan(spark, sf).withColumn("group_corr", F.col("usable") * 8.2)
    out = Gr.pick_list(df, "group_corr", "usable", [F.col("usable").desc(), "win_start", "win_end"], 20)
    return out.select("win_start", "win_end", "usable")


@query(
    "GRD-7",
    f"""WITH {CAND_SQL} SELECT candidate AS branch, CASE WHEN grp = 'A' THEN 'test' ELSE 'train' END AS domain, {i('count(*)', 'n')}, {d('avg(pred - anchor)', 'mean_signal', 4)}, {d('max(abs(pred - anchor))', 'max_signal', 4)}
FROM cand WHERE candidate IN ('gain', 'both') GROUP BY 1, 2""",
    digits=4,
)
def grd_7(spark, sf):
    long = candidates(spark, sf).withColumn("domain", F.when(F.col("grp") == "A", "test").otherwise("train"))
    table = Gr.signals({n: long.where(F.col("candidate") == n) for n in ("gain", "both")})
    return table.groupBy("branch", "domain").agg(F.count("*").alias("n"), F.avg("signal").alias("mean_signal"), F.max(F.abs("signal")).alias("max_signal"))
