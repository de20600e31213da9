"""Prediction files: two columns, no header (SRC-4, SNK-1), and out-of-fold tables (SNK-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, pred double"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """id and value of one file (or folder of parts). Of a repeated id the last line counts: lines are
    ordered by file, by where their block starts, and by place in the block."""
    rows = spark.read.csv(path, header=False, schema=SCHEMA).select(
        "id", "pred", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")
    )
    return rows.groupBy("id").agg(F.max_by("pred", F.struct("file_path", "file_block_start", "line")).alias("pred"))


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """(candidate, id, pred) of every file in a folder; the file name is the candidate."""
    rows = spark.read.csv(f"{folder}/*", header=False, schema=SCHEMA).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.csv)?(/part-[^/]*)?$", 1).alias("candidate"),
        "id", "pred", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"),
    )
    return rows.groupBy("candidate", "id").agg(F.max_by("pred", F.struct("file_path", "file_block_start", "line")).alias("pred"))


def write_predictions(df: DataFrame, path: str) -> None:
    """id and prediction in id order, no header; one sorted range per file."""
    df.select(F.col("id").cast("bigint"), F.col("pred").cast("double")).orderBy("id").write.mode("overwrite").csv(path, header=False)


def oof_rows(df: DataFrame, experiment: str, cv: str) -> DataFrame:
    e = F.col("y_pred") - F.col("y_true")
    return df.select(
        F.lit(experiment).alias("experiment"), F.lit(cv).alias("cv"), "fold_id", "id", "grp", "y_true", "y_pred",
        e.alias("error"), F.abs(e).alias("abs_error"),
    )


def write_oof(df: DataFrame, path: str) -> None:
    """One folder per experiment and strategy, so a reader of one run opens only its files."""
    df.write.mode("append").partitionBy("experiment", "cv").parquet(path)
