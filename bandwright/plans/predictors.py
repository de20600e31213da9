"""Named predictors and experiments as data (UDF-1..3), and the runner that evaluates one.

A predictor is ``fit_predict(fit, df) -> df with y_pred``. Most are a rule on one aggregated matrix and so
can share it; the others say what they need. Names of models without a Spark counterpart (support
vector, neural residual and per-sample gradient fits) are listed as left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars as S
from ..functions.preprocessors import get_preprocessor
from ..operators import corrections as C
from ..operators import fits as Fi
from ..operators import folds as Cv
from ..operators import groups as G
from ..operators import monotone as Mo
from ..operators import solvers as So
from ..operators import targets as T
from ..operators.moments import Gram, gram
from ..operators.ordered import group_position

FitPredict = Callable[[DataFrame, DataFrame], DataFrame]

# Band constants of the 1555-band axis.
CENTRE = 616


@dataclass(frozen=True)
class Predictor:
    name: str
    run: FitPredict
    rule: Callable[[Gram], So.Linear] | None = None
    clip: bool = False


def _linear(rule: Callable[[Gram], So.Linear], clip: bool = False) -> FitPredict:
    def run(fit: DataFrame, df: DataFrame) -> DataFrame:
        out = Cv.predict(df, rule(gram(fit)[None]))
        return out.withColumn("y_pred", S.clip(F.col("y_pred"), *Fi.y_range(fit))) if clip else out

    return run


def _band(how: str, clip: bool = True, **kw) -> FitPredict:
    return lambda fit, df: Fi.one_band(fit, df, how, clip, **kw)


def _clip_to(fit: DataFrame, df: DataFrame) -> DataFrame:
    return df.withColumn("y_pred", S.clip(F.col("y_pred"), *Fi.y_range(fit)))


# ---- pieces ----------------------------------------------------------------------------


def _window_band(kind: str) -> FitPredict:
    """Mean or median of three bands around the centre as the one feature."""

    def run(fit: DataFrame, df: DataFrame) -> DataFrame:
        d = fit.select(F.size("x").alias("d")).first()["d"]
        c = min(max(CENTRE, 1), d - 2)
        three = [F.get("x", F.lit(c + k)) for k in (-1, 0, 1)]
        value = sum(three[1:], three[0]) / 3 if kind == "mean" else A.median3(*three)
        one = lambda part: part.withColumn("__x", F.col("x")).withColumn("x", F.array(value))
        return Cv.predict(one(df), So.one_band(gram(one(fit))[None], 0)).withColumn("x", F.col("__x")).drop("__x")

    return run


def _three_fixed(fit: DataFrame, df: DataFrame) -> DataFrame:
    d = fit.select(F.size("x").alias("d")).first()["d"]
    return Fi.median_of_three(fit, df, [min(CENTRE + k, d - 1 + k - 1) for k in (-1, 0, 1)])


def _low_tail(factor: float) -> FitPredict:
    def run(fit: DataFrame, df: DataFrame) -> DataFrame:
        model = So.one_band(gram(fit)[None])
        return C.low_tail(Cv.predict(fit, model), Cv.predict(df, model), 0.1, factor, "y_pred", "y_pred")

    return run


def _group_oof(fit: DataFrame, rule: Callable[[Gram], So.Linear]) -> DataFrame:
    return Cv.out_of_fold(Cv.leave_one_group(fit), rule, name="p")


def _oof_intercept(fit: DataFrame, df: DataFrame) -> DataFrame:
    model = So.one_band(gram(fit)[None])
    shift = C.intercept_shift(_group_oof(fit, lambda g: So.one_band(g, model.info["band"])))
    return _clip_to(fit, Cv.predict(df, model).withColumn("y_pred", F.col("y_pred") + shift))


def _range_calibrated(fit: DataFrame, df: DataFrame) -> DataFrame:
    model = So.one_band(gram(fit)[None])
    slope, icept = C.affine_fit(_group_oof(fit, lambda g: So.one_band(g, model.info["band"])))
    return _clip_to(fit, Cv.predict(df, model).withColumn("y_pred", F.col("y_pred") * slope + icept))


def band_pls(radius: int) -> Callable[[Gram], So.Linear]:
    def rule(g: Gram) -> So.Linear:
        c = min(CENTRE, g.d - 1)
        return So.pls(g, 2, range(max(0, c - radius), min(g.d, c + radius + 1)))

    return rule


def _pls_affine(shrink: float, bias_only: bool) -> FitPredict:
    def run(fit: DataFrame, df: DataFrame) -> DataFrame:
        oof = _group_oof(fit, band_pls(5))
        scale, shift = (1.0, shrink * C.intercept_shift(oof)) if bias_only else C.shrunk_affine(oof, shrink)
        out = Cv.predict(df, band_pls(5)(gram(fit)[None]))
        return out.withColumn("y_pred", F.col("y_pred") * scale + shift)

    return run


def _pls_aligned(weight: float) -> FitPredict:
    def run(fit: DataFrame, df: DataFrame) -> DataFrame:
        moved = C.align_means(fit, df.withColumn("__x", F.col("x")), weight)
        return Cv.predict(moved, band_pls(5)(gram(fit)[None])).withColumn("x", F.col("__x")).drop("__x")

    return run


def _pls_blend(radius: int, weight: float) -> FitPredict:
    def rule(g: Gram) -> So.Linear:
        a, b = band_pls(5)(g), band_pls(radius)(g)
        return So.Linear(a.coef + weight * (b.coef - a.coef), a.intercept + weight * (b.intercept - a.intercept))

    return _linear(rule)


def _nn_bias(fit: DataFrame, df: DataFrame, name: str = "y_pred", clip: bool = True) -> DataFrame:
    model = So.one_band(gram(fit)[None])
    return C.nearest_group_bias(Cv.predict(fit, model, "p"), Cv.predict(df, model, "p"), clip=clip, name=name)


def _anti_nn(weight: float, snv_weight: float | None = None) -> FitPredict:
    """Base plus a negative share of the nearest-group correction, and of the SNV blend when given."""

    def run(fit: DataFrame, df: DataFrame) -> DataFrame:
        out = _nn_bias(fit, df, "__nn")
        value = F.col("p") + (F.col("__nn") - F.col("p")) * weight
        if snv_weight is not None:
            out = _snv25(fit, out, "__snv")
            value = value + (F.col("__snv") - F.col("p")) * snv_weight
        return _clip_to(fit, out.withColumn("y_pred", value)).drop("p", "__nn", "__snv")

    return run


def _snv25(fit: DataFrame, df: DataFrame, name: str) -> DataFrame:
    mix = lambda part: part.withColumn("__x", F.col("x")).withColumn("x", A.blend_raw_snv(F.col("x"), 0.25))
    out = Cv.predict(mix(df), So.one_band(gram(mix(fit))[None]), name)
    return out.withColumn("x", F.col("__x")).drop("__x")


def _anti_snv(weight: float) -> FitPredict:
    def run(fit: DataFrame, df: DataFrame) -> DataFrame:
        out = _snv25(fit, Cv.predict(df, So.one_band(gram(fit)[None]), "p"), "__snv")
        return _clip_to(fit, out.withColumn("y_pred", F.col("p") + (F.col("__snv") - F.col("p")) * weight)).drop("p", "__snv")

    return run


def _two_views(fit: DataFrame, df: DataFrame) -> DataFrame:
    """0.98 anchor view (SNV, first difference) + 0.02 raw, one band each."""
    view = lambda part: part.withColumn("__x", F.col("x")).withColumn("x", A.difference(A.snv(F.col("x"))))
    out = Cv.predict(view(df), So.one_band(gram(view(fit))[None]), "p").withColumn("x", F.col("__x")).drop("__x")
    out = Cv.predict(out, So.one_band(gram(fit)[None]), "__raw")
    return out.withColumn("y_pred", F.col("p") * 0.98 + F.col("__raw") * 0.02).drop("p", "__raw")


def _stable_ridge(k: int, alpha: float, ddof: int) -> FitPredict:
    def run(fit: DataFrame, df: DataFrame) -> DataFrame:
        bands = [r["band"] for r in Fi.P.stable_top_bands(fit, k, "id").orderBy("pos").collect()]
        return _linear(lambda g: So.ridge(g, alpha, bands, ddof), clip=True)(fit, df)

    return run


def _weighted(k: int, high: float, q: float) -> FitPredict:
    return lambda fit, df: _clip_to(fit, Cv.predict(df, Fi.weighted_top_ridge(fit, k, 100.0, high, q)))


def _upper(q: float, boost: float) -> FitPredict:
    base = _linear(Fi.top_ridge(6, 100.0), clip=True)
    return lambda fit, df: C.upper_tail(base(fit, fit), base(fit, df), q, boost, *Fi.y_range(fit), pred="y_pred", name="y_pred")


def _shifted(fit: DataFrame, df: DataFrame) -> DataFrame:
    base = _linear(Fi.top_ridge(6, 100.0), clip=True)
    return C.mean_shift(base(fit, df), fit.agg(F.avg("y")).first()[0], 0.15, *Fi.y_range(fit), pred="y_pred", name="y_pred")


def _log_ridge(fit: DataFrame, df: DataFrame) -> DataFrame:
    model = So.ridge(gram(fit.withColumn("y", T.log_target(F.col("y"))))[None], 100.0)
    return Cv.predict(df, model).withColumn("y_pred", T.log_target_inverse(F.col("y_pred")))


def _gauss(k: int, alpha: float) -> FitPredict:
    def run(fit: DataFrame, df: DataFrame) -> DataFrame:
        a = T.quantile_normal_bands(fit, fit)
        b = T.quantile_normal_bands(fit, df.withColumn("__x", F.col("x")))
        return Cv.predict(b, So.pca_ridge(gram(a)[None], k, alpha)).withColumn("x", F.col("__x")).drop("__x")

    return run


def strip_meta(df: DataFrame) -> DataFrame:
    """Group number and position taken off the array again (they stay as columns)."""
    return df.withColumn("x", F.slice("x", 1, F.size("x") - 2)) if "position" in df.columns else df


def _with_position(df: DataFrame) -> DataFrame:
    return df if "position" in df.columns else group_position(df, "grp", "seq", "position")


def _monotone(base: FitPredict) -> FitPredict:
    def run(fit: DataFrame, df: DataFrame) -> DataFrame:
        out = base(strip_meta(fit), strip_meta(_with_position(df)))
        out = Mo.isotonic_by_group(out, "grp", ["position", "id"], "y_pred", "__m").withColumn("y_pred", F.col("__m")).drop("__m")
        return _clip_to(fit, out)

    return run


def _curve(base: FitPredict, variant: str) -> FitPredict:
    def run(fit: DataFrame, df: DataFrame) -> DataFrame:
        fit, df = strip_meta(_with_position(fit)), strip_meta(_with_position(df))
        curve, mid, upper = Mo.fit_curve(fit, "grp", "position", "y")
        out = base(fit, df).withColumnRenamed("y_pred", "__base")
        return Mo.curve_template(out, curve, (mid, upper), Fi.y_range(fit), "grp", "position", "__base", "id", variant, "y_pred").drop("__base")

    return run


def _curve_blend(fit: DataFrame, df: DataFrame) -> DataFrame:
    a = PREDICTORS["group_curve_template_ridge"].run(fit, df)
    b = PREDICTORS["group_curve_template_quantile"].run(fit, df).select("id", F.col("y_pred").alias("__q"))
    out = a.join(b, "id").withColumn("__b", F.col("y_pred") * 0.55 + F.col("__q") * 0.45).drop("y_pred", "__q")
    out = Mo.isotonic_by_group(out, "grp", ["position", "id"], "__b", "y_pred").drop("__b")
    return _clip_to(fit, out)


def _curve_residual(fit: DataFrame, df: DataFrame) -> DataFrame:
    curve = _curve(_quantile, "residual")
    fit = strip_meta(_with_position(fit))
    fitted = curve(fit, fit)
    model = Fi.top_ridge(6, 300.0)(gram(fitted.withColumn("y", F.col("y") - F.col("y_pred")))[None])
    out = Cv.predict(curve(fit, df), model, "__r").withColumn("__b", F.col("y_pred") + F.col("__r") * 0.5).drop("y_pred", "__r")
    out = Mo.isotonic_by_group(out, "grp", ["position", "id"], "__b", "y_pred").drop("__b")
    return _clip_to(fit, out)


def _quantile(fit: DataFrame, df: DataFrame) -> DataFrame:
    return Fi.quantile_blend(fit, df)


def _boosted(k: int) -> FitPredict:
    return _monotone(lambda fit, df: _clip_to(fit, Fi.boosted(fit, df, So.top_bands(gram(fit)[None], k), rounds=180)))


def _boosted_pls(k: int) -> FitPredict:
    return _monotone(lambda fit, df: _clip_to(fit, Fi.boosted_on_pls(fit, df, k)))


def _top_huber(fit: DataFrame, df: DataFrame) -> DataFrame:
    bands = So.top_bands(gram(fit)[None], 8)
    pick = lambda part: part.withColumn("__x", F.col("x")).withColumn("x", A.pick(F.col("x"), bands))
    out = Fi.huber(pick(fit).drop("__x"), pick(df), 0.01).withColumn("x", F.col("__x")).drop("__x")
    return _clip_to(fit, out)


def _ensemble(fit: DataFrame, df: DataFrame) -> DataFrame:
    return Fi.clipped_mean(fit, df, [Fi.top_ridge(k, a) for k, a in Fi.ENSEMBLE])


# ---- names -----------------------------------------------------------------------------

_FITS: dict[str, FitPredict] = {
    "single_feature_linear": _band("best", clip=False),
    "single_feature_fixed_index": _band("fixed", clip=False, fixed=CENTRE),
    "single_feature_stable_wavelength": _band("stable", clip=False),
    "single_feature_loo_consensus_wavelength": _band("consensus", clip=False),
    "single_feature_loo_rmse_wavelength": _band("loo_rmse"),
    "single_feature_second_wavelength": _band("second"),
    "msc_select_raw_linear": _band("msc"),
    "single_feature_linear_clipped": _band("best"),
    "single_feature_index616_window_mean": _window_band("mean"),
    "single_feature_index616_window_median": _window_band("median"),
    "single_feature_index616_prediction_median": _three_fixed,
    "single_feature_top3_median": Fi.median_of_three,
    "single_feature_linear_low_tail_mild": _low_tail(1.15),
    "single_feature_linear_low_tail_strong": _low_tail(1.35),
    "single_feature_linear_oof_intercept": _oof_intercept,
    "single_feature_linear_range_calibrated": _range_calibrated,
    "topk6_upper_cal_q70": _upper(0.7, 0.15),
    "topk6_upper_cal_q80": _upper(0.8, 0.25),
    "topk6_mean_shift": _shifted,
    "band616_pls_c2_oof_bias_l005": _pls_affine(0.05, True),
    "band616_pls_c2_oof_affine_l010": _pls_affine(0.10, False),
    "band616_pls_c2_mean_align_l010": _pls_aligned(0.10),
    "band616_pls_c2_mean_align_l020": _pls_aligned(0.20),
    "anti_snv25_prediction_blend_wm025": _anti_snv(-0.25),
    "anti_snv25_prediction_blend_wm050": _anti_snv(-0.50),
    "dual_prep_anchor_raw_blend": _two_views,
    "single_feature_anti_nn_wm040_anti_snv_wm025": _anti_nn(-0.40, -0.25),
    "single_feature_anti_nn_wm040_anti_snv_wm050": _anti_nn(-0.40, -0.50),
    "nearest_train_species_linear": Fi.nearest_group_fit,
    "nearest_train_species_bias_corrected": _nn_bias,
    "moisture_bin_wavelength_linear": lambda fit, df: Fi.binned_slopes(fit, df, "y"),
    "moisture_bin_fixed_wavelength": lambda fit, df: Fi.binned_slopes(fit, df, "proxy"),
    "dual_stable_wavelength_ridge": _stable_ridge(2, 1000.0, 1),
    "topk5_stable_ridge": _stable_ridge(5, 100.0, 0),
    "topk6_weighted_q70": _weighted(6, 2.0, 0.7),
    "topk6_weighted_q80": _weighted(6, 3.0, 0.8),
    "topk8_weighted_q70": _weighted(8, 2.0, 0.7),
    "log_ridge_alpha100": _log_ridge,
    "topk_ridge_cv": lambda fit, df: _clip_to(fit, Cv.predict(df, Fi.ridge_loo(fit, 5))),
    "topk_ridge_ensemble": _ensemble,
    "topk_huber": _top_huber,
    "huber": lambda fit, df: Fi.huber(fit, df, 0.001),
    "topk_quantile_blend": _quantile,
    "meta_monotonic_topk5_ridge": _monotone(_linear(Fi.top_ridge(5, 100.0))),
    "meta_monotonic_topk6_ridge": _monotone(_linear(Fi.top_ridge(6, 100.0))),
    "meta_monotonic_quantile_blend": _monotone(_quantile),
    "group_curve_template_quantile": _curve(_quantile, "quantile"),
    "group_curve_template_ridge": _curve(_linear(Fi.top_ridge(6, 100.0), clip=True), "ridge"),
    "group_curve_template_wide": _curve(_quantile, "wide"),
    "group_curve_upper_anchor": _curve(_quantile, "upper_anchor"),
    "group_curve_range_calibrated": _curve(_linear(Fi.top_ridge(6, 100.0), clip=True), "range_calibrated"),
    "group_curve_blend": _curve_blend,
    "group_curve_residual": _curve_residual,
    "topk12_hgbdt": _boosted(12),
    "topk24_hgbdt": _boosted(24),
    "pls4_hgbdt": _boosted_pls(4),
    "pls6_hgbdt": _boosted_pls(6),
}
for _k in (614, 615, 617, 618):
    _FITS[f"single_feature_fixed_index_{_k}"] = _band("fixed", clip=False, fixed=_k)
for _w in (25, 35, 40, 45, 50, 75):
    _FITS[f"single_feature_anti_nn_bias_blend_wm{_w:03d}"] = _anti_nn(-_w / 100)
for _r, _ws in ((8, ("005", "010", "015", "020")), (10, ("003", "005", "0075", "010"))):
    for _w in _ws:
        _FITS[f"band616_r{_r}_blend_w{_w}"] = _pls_blend(_r, int(_w) / 10 ** (len(_w) - 1))
for _k, _a in ((25, 300.0), (50, 300.0), (100, 1000.0)):
    _FITS[f"gauss_pca{_k}_ridge_alpha{_a:g}"] = _gauss(_k, _a)

_RULES: dict[str, tuple[Callable[[Gram], So.Linear], bool]] = {
    "mean": (So.mean_only, False),
    "topk5_ridge_a30": (Fi.top_ridge(5, 30.0), True),
    "topk5_ridge_a300": (Fi.top_ridge(5, 300.0), True),
    "topk_elastic": (lambda g: So.elastic_net(g, 0.03, 0.2, So.top_bands(g, 5)), True),
    "elastic_net": (lambda g: So.elastic_net(g, 0.001, 0.15), False),
    "bayesian_ridge": (So.bayes_ridge, False),
}
for _k in (3, 4, 5, 6, 8, 12):
    _RULES[f"topk{_k}_ridge"] = (Fi.top_ridge(_k, 100.0), True)
for _a in (1, 10, 100, 1000):
    _RULES[f"ridge_alpha{_a}"] = (lambda g, a=_a: So.ridge(g, float(a)), False)
for _k in (2, 4, 6, 8, 12, 16):
    _RULES[f"pls_c{_k}"] = (lambda g, k=_k: So.pls(g, k), False)
for _r in (2, 3, 5, 8, 10):
    _RULES[f"band616_pls_c2_r{_r}"] = (band_pls(_r), False)
for _k in (25, 50, 100, 150):
    for _a in (100, 300, 1000):
        _RULES[f"pca{_k}_ridge_alpha{_a}"] = (lambda g, k=_k, a=_a: So.pca_ridge(g, k, float(a)), False)
for _w, _c, _a in ((10, 1, 300), (10, 1, 1000), (10, 2, 1000), (20, 1, 1000)):
    _RULES[f"window_pca{_w}_c{_c}_ridge_alpha{_a}"] = (lambda g, w=_w, c=_c, a=_a: So.window_pca_ridge(g, w, c, float(a)), True)

PREDICTORS: dict[str, Predictor] = {n: Predictor(n, fn) for n, fn in _FITS.items()}
PREDICTORS.update({n: Predictor(n, _linear(rule, clip), rule, clip) for n, (rule, clip) in _RULES.items()})

# Names whose models have no Spark counterpart.
LEFT_OUT = (
    "single_feature_residual_mlp_a005", "single_feature_residual_mlp_a010", "single_feature_residual_mlp_a020",
    "anti_nn_wm040_residual_mlp_a005", "anti_nn_wm040_residual_mlp_a010", "svr_rbf_c10", "svr_linear_c1",
    "topk_sgd_linear", "topk_sgd_linear_clipped",
)


def get_predictor(name: str) -> Predictor:
    if name in LEFT_OUT:
        raise KeyError(f"{name} is not available on Spark")
    if name not in PREDICTORS:
        raise KeyError(f"unknown predictor {name}; known: {sorted(PREDICTORS)}")
    return PREDICTORS[name]
