"""Spectra tables: headered CSV in code page 932, one column per wavelength (SRC-1, SRC-2, SRC-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_number
from ..operators.ordered import join_on, quantiles

# Input column names and code page.
ID, GROUP_NO, GROUP, TARGET = "sample number", "species number", "樹種", "含水率"
META = (ID, GROUP_NO, GROUP)
ENCODING = "windows-31j"


def allow_encoding(spark: SparkSession) -> None:
    """Spark refuses this code page unless told otherwise."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def header(spark: SparkSession, path: str, encoding: str = ENCODING) -> list[str]:
    allow_encoding(spark)
    return spark.read.csv(path, header=True, encoding=encoding, inferSchema=False).columns


def is_number(text: str) -> bool:
    try:
        float(text)
        return True
    except ValueError:
        return False


def spectral_columns(columns: Sequence[str], rule: str = "not_meta") -> list[str]:
    """Feature columns in file order: all but metadata and target, or headers that are numbers."""
    if rule == "not_meta":
        return [c for c in columns if c not in META and c != TARGET]
    if rule == "numeric":
        return [c for c in columns if is_number(c)]
    raise ValueError(f"unknown rule {rule}")


def check_columns(train: Sequence[str], test: Sequence[str]) -> None:
    """The test table must hold every feature of the train table."""
    missing = [c for c in train if c not in set(test)]
    if missing:
        raise ValueError(f"{len(missing)} feature columns are missing from the test table, first {missing[:3]}")


def raw_scan(spark: SparkSession, path: str, encoding: str = ENCODING) -> DataFrame:
    """Every cell as text, under an explicit schema taken from the header line; a file of the folder with other
    columns, or in another order, is an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header(spark, path, encoding)])
    return spark.read.csv(path, header=True, schema=schema, encoding=encoding, enforceSchema=False)


def read_spectra(spark: SparkSession, path: str, encoding: str = ENCODING, features: Sequence[str] | None = None) -> DataFrame:
    """id, grp, grp_no, y (null without a target column) and x. Only the needed columns are parsed."""
    raw = raw_scan(spark, path, encoding)
    bands = list(features or spectral_columns(raw.columns))
    check_columns(bands, raw.columns)
    quoted = lambda c: F.col(f"`{c}`")
    y = parse_number(quoted(TARGET)) if TARGET in raw.columns else F.lit(None).cast("double")
    return raw.select(
        quoted(ID).cast("bigint").alias("id"),
        quoted(GROUP).alias("grp"),
        quoted(GROUP_NO).cast("int").alias("grp_no"),
        y.alias("y"),
        F.array(*[parse_number(quoted(c)) for c in bands]).alias("x"),
    )


def write_spectra(df: DataFrame, path: str, wavelengths: Sequence[float], encoding: str = ENCODING) -> None:
    """The same layout, for tests and for handing tables on."""
    allow_encoding(df.sparkSession)
    cols = [F.col("id").alias(ID), F.col("grp_no").alias(GROUP_NO), F.col("grp").alias(GROUP)]
    if "y" in df.columns:
        cols.append(F.col("y").alias(TARGET))
    cols += [F.get("x", F.lit(k)).alias(f"{w:g}") for k, w in enumerate(wavelengths)]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, encoding=encoding)


def band_table(spark: SparkSession, bands: Sequence[str]) -> DataFrame:
    """band, wavelength: the axis as a small dimension table."""
    return spark.createDataFrame([(k, float(b)) for k, b in enumerate(bands)], "band int, wavelength double")


def profile_targets(train: DataFrame, group: str = "grp", y: str = "y") -> DataFrame:
    """Target summary per group and over all rows (group null)."""
    def block(df: DataFrame, keys: list[str]) -> DataFrame:
        base = df.groupBy(*keys).agg(
            F.count("*").alias("n"), F.min(y).alias("min"), F.avg(y).alias("mean"), F.max(y).alias("max"), F.stddev_pop(y).alias("std")
        )
        return join_on(base, quantiles(df, y, [0.5], keys).withColumnRenamed("q0", "median"), keys)

    whole = block(train, []).withColumn(group, F.lit(None).cast(train.schema[group].dataType))
    return block(train, [group]).unionByName(whole)


def profile_groups(train: DataFrame, test: DataFrame, group: str = "grp") -> DataFrame:
    """Distinct groups on either side and in both."""
    a, b = train.select(group).distinct(), test.select(group).distinct()
    sizes = a.withColumn("s", F.lit("train_groups")).unionByName(b.withColumn("s", F.lit("test_groups")))
    sizes = sizes.unionByName(a.intersect(b).withColumn("s", F.lit("shared_groups")))
    names = train.sparkSession.createDataFrame([(n,) for n in ("train_groups", "test_groups", "shared_groups")], "s string")
    counts = sizes.groupBy("s").agg(F.count("*").alias("n"))
    return names.join(counts, "s", "left").select(F.col("s").alias("measure"), F.coalesce("n", F.lit(0)).alias("n"))


def profile_dataset(train: DataFrame, test: DataFrame, columns: Sequence[str], test_columns: Sequence[str], group: str = "grp") -> DataFrame:
    """measure, n, value: rows and columns of both sides, the number of wavelength columns with the first and the last,
    and the shared groups by name (one row each, with their rows on both sides)."""
    bands = spectral_columns(columns)
    spark = train.sparkSession
    facts = [("train_columns", len(columns), None), ("test_columns", len(test_columns), None), ("wavelengths", len(bands), None), ("wavelength_first", None, float(bands[0])), ("wavelength_last", None, float(bands[-1]))]
    out = spark.createDataFrame(facts, "measure string, n long, value double")
    for side, df in (("train_rows", train), ("test_rows", test)):
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(side).alias("measure"), "n", F.lit(None).cast("double").alias("value")))
    sizes = lambda df, name: df.groupBy(group).agg(F.count("*").alias(name))
    both = sizes(train, "a").join(sizes(test, "b"), group)
    shared = both.select(F.concat(F.lit("shared:"), F.col(group).cast("string")).alias("measure"), (F.col("a") + F.col("b")).alias("n"), F.lit(None).cast("double").alias("value"))
    return out.unionByName(shared)
