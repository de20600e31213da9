"""Run records, leaderboard and external-score log (SNK-3, SNK-4, SNK-5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import utc_stamp

# Column names of the stored logs.
LEADERBOARD = (
    "timestamp string, experiment_name string, cv_strategy string, primary_metric string, mean_score double, std_score double, "
    "oof_rmse double, oof_mae double, oof_r2 double, species_shift_rmse double, public_proxy_rmse double, worst_species_rmse double, "
    "composite_score double, preprocessor string, predictor string, n_features int, submission_path string, log_path string, memo string"
)
SCORE_LOG = (
    "timestamp string, experiment_name string, submission_name string, public_score double, group_species_rmse double, "
    "leave_one_species_rmse double, random_rmse double, best_local_metric string, best_local_score double, local_public_gap double, "
    "submission_path string, memo string"
)
RUN_LOG = (
    "timestamp string, experiment_name string, preprocessor string, predictor string, n_train long, n_test long, n_features int, "
    "prediction_summary struct<min: double, max: double, mean: double>, submission_path string, submit boolean, memo string, "
    "cv struct<strategy: string, mean_score: double, std_score: double, oof_rmse: double, "
    "oof_by_species: array<struct<grp: string, count: long, rmse: double, mae: double, bias: double>>>"
)


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """All columns of the schema in order; missing ones null."""
    fields = [p.split() for p in ddl.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def append_leaderboard(df: DataFrame, path: str) -> None:
    """Append rows; the time of writing is set where none is given."""
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", utc_stamp())
    conform(df, LEADERBOARD).write.mode("append").parquet(path)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEADERBOARD).parquet(path)


LOCAL_METRICS = ("group_species_rmse", "leave_one_species_rmse", "random_rmse")


def with_closest_metric(df: DataFrame, metrics: Sequence[str] = LOCAL_METRICS) -> DataFrame:
    """Local metric nearest to the measured score, its value and the absolute gap."""
    pairs = F.array(*[F.struct(F.abs(F.col(m) - F.col("public_score")).alias("gap"), F.lit(k).alias("k"), F.lit(m).alias("metric"), F.col(m).alias("score")) for k, m in enumerate(metrics)])
    best = F.array_min(F.filter(pairs, lambda s: s["gap"].isNotNull()))
    return df.withColumn("__b", best).withColumns(
        {
            "best_local_metric": F.coalesce(F.col("__b.metric"), F.lit("")),
            "best_local_score": F.col("__b.score"),
            "local_public_gap": F.abs(F.col("public_score") - F.col("__b.score")),
        }
    ).drop("__b")


def append_score_log(df: DataFrame, path: str) -> list[float] | None:
    """Append measured scores and fit the proxy anew on the whole log; None while it has too few rows."""
    from ..operators.compare import fit_proxy

    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", utc_stamp())
    conform(with_closest_metric(df), SCORE_LOG).write.mode("append").parquet(path)
    return fit_proxy(read_score_log(df.sparkSession, path), LOCAL_METRICS, "public_score")


def read_score_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE_LOG).parquet(path)


def run_record(summary: DataFrame, oof: DataFrame | None, fields: dict) -> DataFrame:
    """One nested row: ``summary`` is one row with n_test and the prediction summary, ``oof`` the held-out
    rows the CV part is computed from."""
    from ..operators.groups import fold_summary, group_errors
    from ..operators.ordered import join_on

    out = summary
    if oof is not None:
        per = group_errors(oof).select(F.struct(F.col("grp").cast("string").alias("grp"), F.col("n").alias("count"), "rmse", "mae", "bias").alias("s"))
        out = join_on(out, fold_summary(oof), [])
        out = join_on(out, per.agg(F.array_sort(F.collect_list("s")).alias("oof_by_species")), [])
        cv = F.struct(
            F.lit(fields.get("cv_strategy")).alias("strategy"), "mean_score", "std_score", "oof_rmse", "oof_by_species"
        )
    else:
        cv = F.lit(None)
    out = out.withColumn("cv", cv).withColumn("timestamp", utc_stamp())
    for name, value in fields.items():
        if name != "cv_strategy":
            out = out.withColumn(name, F.lit(value))
    keep = [n for n in ("timestamp", "experiment_name", "preprocessor", "predictor", "n_train", "n_test", "n_features", "prediction_summary", "submission_path", "submit", "memo", "cv")]
    return out.select(*[F.col(n) if n in out.columns else F.lit(None).alias(n) for n in keep])


def write_run_log(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).json(path)
