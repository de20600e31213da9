"""Files, logs, registries and experiments."""

import pytest
from pyspark.sql import functions as F

from bandwright.plans import experiments as E
from bandwright.plans import predictors as R
from bandwright.plans.fixtures import test as held_rows
from bandwright.plans.fixtures import train as train_rows
from bandwright.operators import drift as D
from bandwright.operators import folds as Cv
from bandwright.sources import predictions, spectra_csv

SF = "/root/testdata/sf0.001"


def test_registry_sizes_and_errors():
    assert len(E.EXPERIMENTS) == 171 and len(R.PREDICTORS) + len(R.LEFT_OUT) == 130
    assert all(e.predictor in R.PREDICTORS or not e.available for e in E.EXPERIMENTS.values())
    with pytest.raises(KeyError):
        R.get_predictor("nope")
    with pytest.raises(KeyError):
        R.get_predictor("svr_rbf_c10")
    with pytest.raises(KeyError):
        E.get_experiment("nope")


@pytest.mark.parametrize(
    "name",
    [
        "candidate_linear_idx616_winmedian3_raw", "candidate_linear_1f_top3_median", "candidate_linear_1f_range_cal", "candidate_linear_1f_lowtail_mild",
        "candidate_linear_1f_anti_nn040_anti_snv025", "candidate_band616_pls_c2_smooth5_oof_affine_l010", "candidate_band616_pls_c2_smooth5_mean_align_l010",
        "candidate_band616_anchor_r8_blend_w010", "topk5_stable_ridge_snv_diff1", "topk6_upper_cal_q70_snv_diff1", "topk6_mean_shift_snv_diff1",
        "candidate_linear_blend_1f_2pct_snv_diff1", "log_ridge_snv_alpha100", "mono_topk5_ridge_snv_diff1", "topk_huber_snv_diff1", "pls_msc_c4",
    ],
)
def test_experiments_predict_every_test_row(spark, name):
    te = held_rows(spark, SF)
    out = E.predict_test(train_rows(spark, SF), te, name).select("id", "y_pred")
    assert out.where("y_pred IS NOT NULL AND NOT isnan(y_pred)").count() == te.count()


def test_shared_grid_equals_single_runs(spark):
    df = Cv.leave_one_group(train_rows(spark, SF))
    shared = {r["experiment"]: r["rmse"] for r in E.grid(df, ["pls_snv_c2", "ridge_snv_alpha100"]).collect()}
    for name, rmse in shared.items():
        e = F.col("y_pred") - F.col("y")
        assert abs(E.out_of_fold(df, name).agg(F.sqrt(F.avg(e * e))).first()[0] - rmse) < 1e-9


def test_header_rules_and_missing_features():
    cols = ["sample number", "species number", "樹種", "含水率", "9993.77", "9989.9"]
    assert spectra_csv.spectral_columns(cols) == spectra_csv.spectral_columns(cols, "numeric") == cols[4:]
    with pytest.raises(ValueError):
        spectra_csv.check_columns(cols[4:], cols[:5])


def test_cp932_file_written_elsewhere(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_bytes("sample number,species number,樹種,含水率,9993.5,9990\r\n1,2,杉,12.5,0.1,0.2\r\n2,3,檜,,0.3,0.4\r\n".encode("cp932"))
    rows = spectra_csv.read_spectra(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["grp"], r["grp_no"], r["y"], r["x"]) for r in rows] == [(1, "杉", 2, 12.5, [0.1, 0.2]), (2, "檜", 3, None, [0.3, 0.4])]


def test_folder_of_prediction_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2.0\n2,3.0\n1,5.0\n")
    (tmp_path / "b.csv").write_text("1,2.5\n2,3.5\n")
    rows = {(r["candidate"], r["id"]): r["pred"] for r in predictions.read_candidates(spark, str(tmp_path)).collect()}
    assert rows == {("a", 1): 5.0, ("a", 2): 3.0, ("b", 1): 2.5, ("b", 2): 3.5}


def test_zero_and_negative_predictions_count(spark):
    long = spark.createDataFrame([("c", 1, 0, 1.0, 0.0), ("c", 2, 0, 2.0, -1.0), ("c", 3, 1, 3.0, 3.0)], "candidate string, id long, grp long, anchor double, pred double")
    r = D.anchor_diff(long).first()
    assert (r["n"], r["changed_rows"], r["negative_count"]) == (3, 2, 1)
    assert D.drift_decision(D.drift_table(long)).first()["decision"] == "warn_negative"


def test_decision_texts(spark):
    long = spark.createDataFrame([("c", k, k % 2, 10.0 + k, 40.0 + 3 * k) for k in range(8)], "candidate string, id long, grp long, anchor double, pred double")
    text = D.drift_decision(D.drift_table(long)).first()["decision"].split(";")
    assert text == ["reject_raw_drift", "reject_global_bias", "reject_species_shift"]
