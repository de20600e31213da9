"""Alignment of prediction sets by id and set operations on changed rows (JN-1, JN-2, SET)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CHANGED = 1e-12


def side_counts(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """How often each id occurs on either side: ``key, n_left, n_right``, counted in one pass over both."""
    one = lambda df, l, r: df.select(key, F.lit(l).alias("n_left"), F.lit(r).alias("n_right"))
    return one(left, 1, 0).unionByName(one(right, 0, 1)).groupBy(key).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))


def unmatched(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Ids found on one side only, with the side."""
    counts = side_counts(left, right, key).where("n_left = 0 OR n_right = 0")
    return counts.select(key, F.when(F.col("n_left") > 0, F.lit("left")).otherwise(F.lit("right")).alias("side"))


def same_ids(left: DataFrame, right: DataFrame, key: str = "id") -> bool:
    """Whether every id occurs exactly once on either side."""
    return side_counts(left, right, key).where(f"n_left <> 1 OR n_right <> 1 OR `{key}` IS NULL").limit(1).count() == 0


def align(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Inner pairing by id; an id missing on a side, repeated on one or null is an error."""
    if not same_ids(left, right, key):
        raise ValueError("prediction sets do not hold the same ids once each")
    return left.join(right, key)


def attach_group(pred: DataFrame, meta: DataFrame, key: str, group: str) -> DataFrame:
    """Left lookup of the group; a missing one becomes empty text."""
    return pred.join(meta.select(key, group), key, "left").withColumn(
        group, F.coalesce(F.col(group).cast("string"), F.lit(""))
    )


def stack_domains(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("domain", F.lit("train")).unionByName(
        test.withColumn("domain", F.lit("test")), allowMissingColumns=True
    )


def changed(diff: Column, limit: float = CHANGED) -> Column:
    return F.abs(diff) > limit


def set_counts(a: Column, b: Column) -> list[Column]:
    """Sizes of union, intersection and differences of two row sets, and Jaccard."""
    both, either = F.sum((a & b).cast("bigint")), F.sum((a | b).cast("bigint"))
    return [
        either.alias("n_union"),
        both.alias("n_both"),
        F.sum((a & ~b).cast("bigint")).alias("n_only_a"),
        F.sum((~a & b).cast("bigint")).alias("n_only_b"),
        (both / F.greatest(either, F.lit(1))).alias("jaccard"),
    ]


def same_sign(a: Column, b: Column) -> Column:
    return (F.abs(a) > CHANGED) & (F.abs(b) > CHANGED) & (F.signum(a) == F.signum(b))


def opposite_sign(a: Column, b: Column) -> Column:
    return (F.abs(a) > CHANGED) & (F.abs(b) > CHANGED) & (F.signum(a) != F.signum(b))
