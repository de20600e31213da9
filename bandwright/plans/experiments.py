"""Named experiments (preprocessor and predictor pairs) and the jobs that evaluate them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.preprocessors import get_preprocessor
from ..operators import folds as Cv
from ..operators import groups as G
from ..operators.compare import composite
from ..operators.moments import gram_table
from ..session import cut
from .predictors import LEFT_OUT, get_predictor

# Experiment name, preprocessor, predictor.
_TABLE = """
baseline_mean spectral mean
candidate_linear_1f spectral single_feature_linear
candidate_linear_1f_rank2 spectral single_feature_second_wavelength
candidate_linear_1f_stable_wavelength spectral single_feature_stable_wavelength
candidate_linear_1f_loo_rmse spectral single_feature_loo_rmse_wavelength
candidate_linear_1f_top3_median spectral single_feature_top3_median
candidate_linear_1f_oof_intercept spectral single_feature_linear_oof_intercept
candidate_linear_1f_msc spectral_msc single_feature_linear
candidate_linear_1f_area spectral_area single_feature_linear
candidate_linear_1f_smooth spectral_smooth single_feature_linear
candidate_linear_1f_detrend spectral_detrend single_feature_linear
candidate_linear_1f_range_cal spectral single_feature_linear_range_calibrated
candidate_linear_1f_lowtail_mild spectral single_feature_linear_low_tail_mild
candidate_linear_1f_moisture_bins spectral moisture_bin_wavelength_linear
candidate_linear_1f_nn_bias spectral nearest_train_species_bias_corrected
candidate_linear_1f_anti_nn_bias_wm025 spectral single_feature_anti_nn_bias_blend_wm025
candidate_linear_1f_anti_nn_bias_wm035 spectral single_feature_anti_nn_bias_blend_wm035
candidate_linear_1f_anti_nn_bias_wm040 spectral single_feature_anti_nn_bias_blend_wm040
candidate_linear_1f_anti_nn_bias_wm045 spectral single_feature_anti_nn_bias_blend_wm045
candidate_linear_1f_anti_nn040_anti_snv025 spectral single_feature_anti_nn_wm040_anti_snv_wm025
candidate_linear_1f_anti_nn040_anti_snv050 spectral single_feature_anti_nn_wm040_anti_snv_wm050
candidate_linear_1f_anti_nn_bias_wm050 spectral single_feature_anti_nn_bias_blend_wm050
candidate_linear_1f_anti_nn_bias_wm075 spectral single_feature_anti_nn_bias_blend_wm075
candidate_linear_1f_moisture_bins_v2 spectral moisture_bin_fixed_wavelength
candidate_linear_1f_msc_select_raw spectral msc_select_raw_linear
candidate_linear_1f_center spectral_center single_feature_linear
candidate_linear_1f_l2norm spectral_l2norm single_feature_linear
candidate_linear_1f_blend_snv25 spectral_blend_snv25 single_feature_linear
candidate_linear_1f_anti_snv25_pred_wm025 spectral anti_snv25_prediction_blend_wm025
candidate_linear_1f_anti_snv25_pred_wm050 spectral anti_snv25_prediction_blend_wm050
candidate_linear_1f_residual_mlp_a005 spectral single_feature_residual_mlp_a005
candidate_linear_1f_residual_mlp_a010 spectral single_feature_residual_mlp_a010
candidate_linear_1f_residual_mlp_a020 spectral single_feature_residual_mlp_a020
candidate_linear_1f_anti_nn040_residual_mlp_a005 spectral anti_nn_wm040_residual_mlp_a005
candidate_linear_1f_anti_nn040_residual_mlp_a010 spectral anti_nn_wm040_residual_mlp_a010
candidate_linear_1f_blend_snv50 spectral_blend_snv50 single_feature_linear
candidate_linear_1f_smooth3 spectral_smooth3 single_feature_linear
candidate_linear_1f_smooth5 spectral_smooth5 single_feature_linear
candidate_linear_idx616_raw spectral single_feature_fixed_index
candidate_linear_idx614_raw spectral single_feature_fixed_index_614
candidate_linear_idx615_raw spectral single_feature_fixed_index_615
candidate_linear_idx617_raw spectral single_feature_fixed_index_617
candidate_linear_idx618_raw spectral single_feature_fixed_index_618
candidate_linear_idx616_winmean3_raw spectral single_feature_index616_window_mean
candidate_linear_idx616_winmedian3_raw spectral single_feature_index616_window_median
candidate_linear_idx616_predmedian3_raw spectral single_feature_index616_prediction_median
candidate_linear_idx616_center spectral_center single_feature_fixed_index
candidate_linear_idx616_blend25 spectral_blend_snv25 single_feature_fixed_index
candidate_linear_idx616_smooth5 spectral_smooth5 single_feature_fixed_index
candidate_band616_pls_c2_smooth5_r2 spectral_smooth5 band616_pls_c2_r2
candidate_band616_pls_c2_smooth5_r3 spectral_smooth5 band616_pls_c2_r3
candidate_band616_pls_c2_smooth5_r5 spectral_smooth5 band616_pls_c2_r5
candidate_band616_pls_c2_smooth5 spectral_smooth5 band616_pls_c2_r5
candidate_band616_pls_c2_smooth5_oof_affine_l010 spectral_smooth5 band616_pls_c2_oof_affine_l010
candidate_band616_pls_c2_smooth5_oof_bias_l005 spectral_smooth5 band616_pls_c2_oof_bias_l005
candidate_band616_pls_c2_smooth5_mean_align_l010 spectral_smooth5 band616_pls_c2_mean_align_l010
candidate_band616_pls_c2_smooth5_mean_align_l020 spectral_smooth5 band616_pls_c2_mean_align_l020
candidate_band616_pls_c2_smooth5_r8 spectral_smooth5 band616_pls_c2_r8
candidate_band616_pls_c2_smooth5_r10 spectral_smooth5 band616_pls_c2_r10
candidate_band616_anchor_r8_blend_w005 spectral_smooth5 band616_r8_blend_w005
candidate_band616_anchor_r8_blend_w010 spectral_smooth5 band616_r8_blend_w010
candidate_band616_anchor_r8_blend_w015 spectral_smooth5 band616_r8_blend_w015
candidate_band616_anchor_r8_blend_w020 spectral_smooth5 band616_r8_blend_w020
candidate_band616_anchor_r10_blend_w003 spectral_smooth5 band616_r10_blend_w003
candidate_band616_anchor_r10_blend_w005 spectral_smooth5 band616_r10_blend_w005
candidate_band616_anchor_r10_blend_w0075 spectral_smooth5 band616_r10_blend_w0075
candidate_band616_anchor_r10_blend_w010 spectral_smooth5 band616_r10_blend_w010
candidate_linear_1f_blend_snv25_nn_bias spectral_blend_snv25 nearest_train_species_bias_corrected
group_curve_blend_spectral_meta spectral_meta group_curve_blend
candidate_linear_1f_snv spectral_snv single_feature_linear
candidate_linear_1f_diff1 spectral_diff1 single_feature_linear
candidate_linear_1f_snv_diff1 spectral_snv_diff1 single_feature_linear
candidate_linear_1f_stable_wavelength_snv_diff1 spectral_snv_diff1 single_feature_stable_wavelength
candidate_linear_1f_loo_consensus_snv_diff1 spectral_snv_diff1 single_feature_loo_consensus_wavelength
candidate_linear_2f_stable_snv_diff1 spectral_snv_diff1 dual_stable_wavelength_ridge
candidate_linear_1f_loo_rmse_snv_diff1 spectral_snv_diff1 single_feature_loo_rmse_wavelength
candidate_linear_1f_rank2_snv_diff1 spectral_snv_diff1 single_feature_second_wavelength
candidate_linear_1f_snv_diff1_oof_intercept spectral_snv_diff1 single_feature_linear_oof_intercept
candidate_linear_top3_median_snv_diff1 spectral_snv_diff1 single_feature_top3_median
candidate_linear_blend_1f_2pct_snv_diff1 spectral_snv_diff1 dual_prep_anchor_raw_blend
candidate_linear_1f_nearest_train_species_snv_diff1 spectral_snv_diff1 nearest_train_species_linear
candidate_linear_1f_snv_diff1_clip spectral_snv_diff1 single_feature_linear_clipped
candidate_linear_1f_snv_diff1_lowtail_mild spectral_snv_diff1 single_feature_linear_low_tail_mild
candidate_linear_1f_snv_diff1_lowtail_strong spectral_snv_diff1 single_feature_linear_low_tail_strong
topk3_ridge_snv_diff1 spectral_snv_diff1 topk3_ridge
topk5_ridge_snv_diff1 spectral_snv_diff1 topk5_ridge
topk4_ridge_snv_diff1 spectral_snv_diff1 topk4_ridge
topk6_ridge_snv_diff1 spectral_snv_diff1 topk6_ridge
topk8_ridge_snv_diff1 spectral_snv_diff1 topk8_ridge
topk5_ridge_a30_snv_diff1 spectral_snv_diff1 topk5_ridge_a30
topk5_ridge_a300_snv_diff1 spectral_snv_diff1 topk5_ridge_a300
topk5_stable_ridge_snv_diff1 spectral_snv_diff1 topk5_stable_ridge
topk_ridge_cv_snv_diff1 spectral_snv_diff1 topk_ridge_cv
topk_elastic_snv_diff1 spectral_snv_diff1 topk_elastic
topk_ridge_ensemble_snv_diff1 spectral_snv_diff1 topk_ridge_ensemble
topk6_weighted_q70_snv_diff1 spectral_snv_diff1 topk6_weighted_q70
topk6_weighted_q80_snv_diff1 spectral_snv_diff1 topk6_weighted_q80
topk8_weighted_q70_snv_diff1 spectral_snv_diff1 topk8_weighted_q70
topk_quantile_blend_snv_diff1 spectral_snv_diff1 topk_quantile_blend
mono_topk6_ridge_snv_diff1 spectral_snv_diff1_meta meta_monotonic_topk6_ridge
mono_topk5_ridge_snv_diff1 spectral_snv_diff1_meta meta_monotonic_topk5_ridge
mono_quantile_blend_snv_diff1 spectral_snv_diff1_meta meta_monotonic_quantile_blend
mono_topk5_ridge_snv_sg_diff1 spectral_snv_sg_diff1_meta meta_monotonic_topk5_ridge
group_curve_quantile_snv_diff1 spectral_snv_diff1_meta group_curve_template_quantile
group_curve_ridge_snv_diff1 spectral_snv_diff1_meta group_curve_template_ridge
group_curve_wide_snv_diff1 spectral_snv_diff1_meta group_curve_template_wide
group_curve_residual_snv_diff1 spectral_snv_diff1_meta group_curve_residual
group_curve_upper_anchor_snv_diff1 spectral_snv_diff1_meta group_curve_upper_anchor
group_curve_range_cal_snv_diff1 spectral_snv_diff1_meta group_curve_range_calibrated
group_curve_blend_snv_diff1 spectral_snv_diff1_meta group_curve_blend
topk12_hgbdt_snv_diff1_meta spectral_snv_diff1_meta topk12_hgbdt
topk24_hgbdt_snv_diff1_meta spectral_snv_diff1_meta topk24_hgbdt
pls4_hgbdt_snv_diff1_meta spectral_snv_diff1_meta pls4_hgbdt
pls6_hgbdt_snv_diff1_meta spectral_snv_diff1_meta pls6_hgbdt
topk6_upper_cal_q70_snv_diff1 spectral_snv_diff1 topk6_upper_cal_q70
topk6_upper_cal_q80_snv_diff1 spectral_snv_diff1 topk6_upper_cal_q80
topk6_mean_shift_snv_diff1 spectral_snv_diff1 topk6_mean_shift
topk12_ridge_snv_diff1 spectral_snv_diff1 topk12_ridge
topk_huber_snv_diff1 spectral_snv_diff1 topk_huber
topk3_ridge_diff1 spectral_diff1 topk3_ridge
topk5_ridge_diff1 spectral_diff1 topk5_ridge
topk_huber_diff1 spectral_diff1 topk_huber
topk5_ridge_snv_diff2 spectral_snv_diff2 topk5_ridge
topk5_ridge_snv_sg_diff1 spectral_snv_sg_diff1 topk5_ridge
topk5_ridge_snv_area_diff1 spectral_snv_area_diff1 topk5_ridge
topk_huber_snv_sg_diff1 spectral_snv_sg_diff1 topk_huber
candidate_linear_topk spectral topk_sgd_linear
candidate_linear_topk_clip spectral topk_sgd_linear_clipped
pls_snv_c8 spectral_snv pls_c8
pls_snv_c2 spectral_snv pls_c2
pls_snv_c4 spectral_snv pls_c4
pls_snv_c6 spectral_snv pls_c6
pls_snv_c12 spectral_snv pls_c12
pls_diff1_c8 spectral_diff1 pls_c8
pls_snv_diff1_c8 spectral_snv_diff1 pls_c8
pls_smooth_diff1_c4 spectral_smooth_diff1 pls_c4
pls_smooth_diff1_c6 spectral_smooth_diff1 pls_c6
pls_smooth_diff1_c8 spectral_smooth_diff1 pls_c8
pls_snv_smooth_diff1_c4 spectral_snv_smooth_diff1 pls_c4
pls_snv_smooth_diff1_c6 spectral_snv_smooth_diff1 pls_c6
pls_snv_smooth_diff1_c8 spectral_snv_smooth_diff1 pls_c8
pls_msc_c4 spectral_msc pls_c4
pls_msc_c6 spectral_msc pls_c6
pls_msc_c8 spectral_msc pls_c8
ridge_snv_alpha10 spectral_snv ridge_alpha10
ridge_diff1_alpha10 spectral_diff1 ridge_alpha10
ridge_snv_alpha100 spectral_snv ridge_alpha100
ridge_snv_alpha1 spectral_snv ridge_alpha1
ridge_snv_alpha1000 spectral_snv ridge_alpha1000
log_ridge_snv_alpha100 spectral_snv log_ridge_alpha100
bayesian_ridge_snv spectral_snv bayesian_ridge
huber_snv spectral_snv huber
pca50_ridge_snv spectral_snv pca50_ridge_alpha100
candidate_multiview_pca25_ridge100 spectral_multiview pca25_ridge_alpha100
candidate_multiview_pca50_ridge100 spectral_multiview pca50_ridge_alpha100
candidate_multiview_pca100_ridge300 spectral_multiview pca100_ridge_alpha300
candidate_multiview_pca150_ridge1000 spectral_multiview pca150_ridge_alpha1000
candidate_raw_pca50_ridge100 spectral pca50_ridge_alpha100
candidate_smooth5_pca50_ridge100 spectral_smooth5 pca50_ridge_alpha100
candidate_raw_gauss_pca25_ridge300 spectral gauss_pca25_ridge_alpha300
candidate_raw_gauss_pca50_ridge300 spectral gauss_pca50_ridge_alpha300
candidate_multiview_gauss_pca50_ridge300 spectral_multiview gauss_pca50_ridge_alpha300
candidate_multiview_gauss_pca100_ridge1000 spectral_multiview gauss_pca100_ridge_alpha1000
candidate_raw_window10pca1_ridge300 spectral window_pca10_c1_ridge_alpha300
candidate_raw_window10pca1_ridge1000 spectral window_pca10_c1_ridge_alpha1000
candidate_raw_window10pca2_ridge1000 spectral window_pca10_c2_ridge_alpha1000
candidate_smooth5_window10pca1_ridge1000 spectral_smooth5 window_pca10_c1_ridge_alpha1000
candidate_raw_window20pca1_ridge1000 spectral window_pca20_c1_ridge_alpha1000
svr_rbf_snv spectral_snv svr_rbf_c10
svr_linear_snv spectral_snv svr_linear_c1
elastic_snv spectral_snv elastic_net
"""


@dataclass(frozen=True)
class Experiment:
    name: str
    preprocessor: str
    predictor: str

    @property
    def available(self) -> bool:
        return self.predictor not in LEFT_OUT


EXPERIMENTS: dict[str, Experiment] = {
    parts[0]: Experiment(*parts) for parts in (line.split() for line in _TABLE.strip().splitlines())
}


def get_experiment(name: str) -> Experiment:
    if name not in EXPERIMENTS:
        raise KeyError(f"unknown experiment {name}")
    return EXPERIMENTS[name]


def out_of_fold(train: DataFrame, name: str, fold: str = "fold_id") -> DataFrame:
    """Held-out predictions of one experiment over the folds of ``train``. A rule on a matrix with a
    row-local preprocessor needs one pass for all folds; anything fitted on rows is refitted per fold."""
    spec = get_experiment(name)
    pre, model = get_preprocessor(spec.preprocessor), get_predictor(spec.predictor)
    if model.rule is not None and not pre.learns_reference and not model.clip:
        return Cv.out_of_fold(pre.transform(train), model.rule, fold)

    def fit_predict(a: DataFrame, b: DataFrame) -> DataFrame:
        params = pre.fit(a)
        return model.run(pre.transform(a, params), pre.transform(b, params))

    return Cv.out_of_fold_refit(train, fit_predict, fold)


def predict_test(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    spec = get_experiment(name)
    pre, model = get_preprocessor(spec.preprocessor), get_predictor(spec.predictor)
    params = pre.fit(train)
    return model.run(pre.transform(train, params), pre.transform(test, params))


def evaluate(train: DataFrame, name: str, strategy: str) -> tuple[DataFrame, DataFrame]:
    """(held-out rows, one leaderboard row) of an experiment under a fold strategy."""
    spec = get_experiment(name)
    oof = out_of_fold(Cv.assign(train, strategy), name).withColumn("y_true", F.col("y"))
    oof = cut(oof.select("fold_id", "id", "grp", "y_true", "y_pred"))
    board = G.fold_summary(oof).join(G.worst_group(oof).select(F.col("worst_rmse").alias("worst_species_rmse")), F.lit(True))
    group_wise = F.col("mean_score") if "species" in strategy else F.lit(None).cast("double")
    board = board.select(
        F.lit(name).alias("experiment_name"), F.lit(strategy).alias("cv_strategy"), F.lit("rmse").alias("primary_metric"),
        "mean_score", "std_score", "oof_rmse", "oof_mae", "oof_r2", group_wise.alias("species_shift_rmse"), "worst_species_rmse",
        composite(group_wise, F.lit(None).cast("double"), F.col("worst_species_rmse")).alias("composite_score"),
        F.lit(spec.preprocessor).alias("preprocessor"), F.lit(spec.predictor).alias("predictor"),
    )
    return oof, board


def grid(train: DataFrame, names: Sequence[str], fold: str = "fold_id") -> DataFrame:
    """(experiment, n, rmse, mae, r2) of several matrix-rule experiments. Experiments that share a
    preprocessor share its matrices and one scoring scan."""
    by_pre: dict[str, list] = {}
    for n in names:
        spec = get_experiment(n)
        if get_predictor(spec.predictor).rule is None or spec.preprocessor == "spectral_msc":
            raise ValueError(f"{n} is fitted on rows; use out_of_fold")
        by_pre.setdefault(spec.preprocessor, []).append(spec)
    out = None
    for pre, specs in by_pre.items():
        rows = get_preprocessor(pre).transform(train)
        models = Cv.solve(gram_table(rows, fold), {s.name: get_predictor(s.predictor).rule for s in specs}, others=True, fallback=False)
        long = Cv.predict_many(rows.withColumn("y_true", F.col("y")), models, fold, ["y_true"]).withColumnRenamed("spec", "experiment")
        part = G.metrics(long, ["experiment"])
        out = part if out is None else out.unionByName(part)
    return out
