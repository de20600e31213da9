"""Monotone post-processing along a sequence inside groups (WIN-4..8).

Pool-adjacent-violators may pool in any order, so a large group is pooled in bounded chunks of
neighbouring blocks, with chunk borders moved every round, until no neighbours are out of order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import carry, join_on, ordinal, previous, quantile_values, with_stats

CHUNK = 50_000


def pool(sums: np.ndarray, weights: np.ndarray, held: list | None = None) -> list[list[float]]:
    """Pooled runs [sum, weight, rows] of a non-decreasing fit; ``held`` continues an earlier call."""
    runs = [] if held is None else held
    for a, b in zip(sums.tolist(), weights.tolist()):
        run = [a, b, 1]
        while runs and runs[-1][0] * run[1] > run[0] * runs[-1][1]:
            last = runs.pop()
            run = [run[0] + last[0], run[1] + last[1], run[2] + last[2]]
        runs.append(run)
    return runs


def _starts(cols: list[pa.Array]) -> np.ndarray:
    """Places in a batch where the key columns differ from the row before."""
    new = np.zeros(len(cols[0]), dtype=bool)
    for c in cols:
        same = pc.equal(c.slice(1), c.slice(0, len(c) - 1))
        both_null = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, len(c) - 1)))
        new[1:] |= ~pc.or_kleene(same, both_null).fill_null(False).to_numpy(zero_copy_only=False)
    return new


def _pool_sorted(keys: Sequence[str]):
    """Task function: rows sorted by (keys, __c, __lo) in, pooled blocks out. One group's runs are held at
    a time, so groups may be many or long."""
    names = [*keys, "__c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: pa.RecordBatch | None = None
        los: list[int] = []
        runs: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not runs:
                return
            at = np.concatenate([[0], np.cumsum([r[2] for r in runs])[:-1]]).astype(int)
            lo = np.concatenate(los)[at]
            cols = [pa.array([key.column(k)[0].as_py()] * len(runs), key.column(k).type) for k in keys]
            cols += [pa.array(lo), pa.array([r[0] for r in runs]), pa.array([r[1] for r in runs])]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "__lo", "__s", "__w"])

        for b in batches:
            if b.num_rows == 0:
                continue
            new = _starts([b.column(k) for k in names])
            first = b.slice(0, 1)
            new[0] = key is None or any(key.column(k)[0].as_py() != first.column(k)[0].as_py() for k in names)
            cuts = np.flatnonzero(np.r_[new, True])
            if not new[0]:
                cuts = np.r_[0, cuts]
            lo, s, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__lo", "__s", "__w"))
            for i, j in zip(cuts[:-1], cuts[1:]):
                if new[i]:
                    yield from flush()
                    key, los, runs = b.slice(i, 1), [], []
                los.append(lo[i:j])
                pool(s[i:j], w[i:j], runs)
        yield from flush()

    return run


def isotonic(
    df: DataFrame, keys: Sequence[str], rank: str, value: str, name: str,
    increasing: bool = True, weight: str | None = None, chunk: int = CHUNK,
) -> DataFrame:
    """Least-squares monotone fit of ``value`` along ``rank`` (0-based, unique in the group)."""
    sign = 1.0 if increasing else -1.0
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(
        *keys,
        F.col(rank).cast("long").alias("__lo"),
        F.col(rank).cast("long").alias("__at"),
        (F.col(value).cast("double") * w * sign).alias("__s"),
        w.alias("__w"),
    )
    schema = rows.drop("__at").schema

    def pooled(blocks: DataFrame, shift: int) -> DataFrame:
        part = blocks.withColumn("__c", F.floor((F.col("__at") + shift) / chunk)).drop("__at")
        spread = part.repartition(*[F.col(k) for k in keys], "__c").sortWithinPartitions(*keys, "__c", "__lo")
        return spread.mapInArrow(_pool_sorted(keys), schema)

    largest = rows.agg(F.max("__at").alias("m")).first()["m"] or 0
    blocks = pooled(rows, 0)
    shift = chunk // 2
    while largest >= chunk:
        ordered = ordinal(blocks, keys, ["__lo"], "__at").withColumn("__mean", F.col("__s") / F.col("__w"))
        broken = previous(ordered, keys, "__at", "__mean", "__before").where(F.col("__before") > F.col("__mean"))
        if not broken.limit(1).count():
            blocks = ordered.drop("__at", "__mean")
            break
        blocks = pooled(ordered.drop("__mean"), shift)
        shift = chunk // 2 - shift
    fits = blocks.select(*keys, F.col("__lo").alias(rank), (F.col("__s") / F.col("__w") * sign).alias("__fit"))
    return carry(join_on(df, fits, [*keys, rank]), keys, rank, "__fit", name).drop("__fit")


def isotonic_by_group(
    df: DataFrame, group: str, order: Sequence[str], value: str, name: str, increasing: bool = False, min_rows: int = 3,
    rank: str | None = None,
) -> DataFrame:
    """Groups under ``min_rows`` rows keep their values; ``rank`` is their place in ``order`` where it is known."""
    ranked = df if rank else ordinal(df, [group], order, "__k")
    fitted = isotonic(ranked, [group], rank or "__k", value, "__iso", increasing)
    sized = with_stats(fitted, [group], F.count("*").alias("__n"))
    return sized.withColumn(
        name, F.when(F.col("__n") < min_rows, F.col(value)).otherwise(F.col("__iso"))
    ).drop("__k", "__iso", "__n")


def sorted_by_group(
    df: DataFrame, group: str, order: Sequence[str], value: str, tie: str, name: str, increasing: bool = False
) -> DataFrame:
    """Values of a group sorted and given out again in sequence order."""
    ranked = ordinal(df, [group], order, "__k")
    by = F.col(value).asc() if increasing else F.col(value).desc()
    given = ordinal(df.select(group, value, tie), [group], [by, tie], "__k")
    given = given.select(group, "__k", F.col(value).alias(name))
    return join_on(ranked, given, [group, "__k"]).drop("__k")


def soft(pred: str, target: str, weight: float) -> Column:
    return F.col(pred) * (1.0 - weight) + F.col(target) * weight


def adjacent(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Difference with the previous row of the group (null on the first)."""
    ranked = ordinal(df, [group], order, "__k")
    return previous(ranked, [group], "__k", value, "__p").withColumn("delta", F.col(value) - F.col("__p")).drop("__p", "__k")


def violations(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    step = adjacent(df, group, order, value)
    return step.groupBy(group).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("delta") < 0, 1).otherwise(0)).alias("falls"),
        F.sum(F.when(F.col("delta") > 0, 1).otherwise(0)).alias("rises"),
    )


# ---- group curve template --------------------------------------------------------------


def fit_curve(train: DataFrame, group: str, position: str, y: str) -> tuple[DataFrame, float, float]:
    """Falling curve of the group-normalised target over position, with the median and upper-quartile
    group ranges. Equal positions are averaged first."""
    scaled = with_stats(train, [group], F.min(y).alias("__lo"), F.max(y).alias("__hi"))
    width = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-12))
    points = scaled.groupBy(F.col(position).alias("p")).agg(
        F.avg((F.col(y) - F.col("__lo")) / width).alias("v"), F.count("*").cast("double").alias("w")
    )
    curve = isotonic(ordinal(points, [], ["p"], "k"), [], "k", "v", "c", increasing=False, weight="w")
    ranges = train.groupBy(group).agg(F.greatest(F.max(y) - F.min(y), F.lit(1e-12)).alias("r"))
    mid, upper = quantile_values(ranges, "r", [0.5, 0.75])
    return curve.select("p", "c"), mid, upper


def read_curve(df: DataFrame, curve: DataFrame, position: str, tie: str, name: str) -> DataFrame:
    """Curve value at each row's position: linear between points, end values outside. Rows and points
    are sorted together, so the curve may be of any length."""
    points = curve.select(
        F.col("p").alias("__p"), F.lit(None).cast(df.schema[tie].dataType).alias(tie), F.struct("p", "c").alias("__s"), F.lit(0).alias("__o")
    )
    asks = df.select(
        F.col(position).alias("__p"), tie, F.lit(None).cast(points.schema["__s"].dataType).alias("__s"), F.lit(1).alias("__o")
    )
    line = ordinal(points.unionByName(asks), [], ["__p", "__o", tie], "__k")
    line = carry(carry(line, [], "__k", "__s", "__a"), [], "__k", "__s", "__z", forward=False)
    line = line.where("__o = 1")
    a, z = F.col("__a"), F.col("__z")
    between = a["c"] + (z["c"] - a["c"]) * (F.col("__p") - a["p"]) / (z["p"] - a["p"])
    value = F.when(z.isNull() | (a["p"] == F.col("__p")), a["c"]).when(a.isNull(), z["c"]).otherwise(between)
    return join_on(df, line.select(tie, value.alias(name)), [tie])


# Base blend, range ratio and range kind of the template variants.
CURVE_VARIANTS = {
    "quantile": (0.65, 0.6, "median"),
    "ridge": (0.65, 0.6, "median"),
    "wide": (0.75, 0.9, "median"),
    "upper_anchor": (0.65, 0.75, "median"),
    "range_calibrated": (0.75, 0.7, "upper"),
    "residual": (1.0, 0.6, "median"),
}


def curve_template(
    df: DataFrame, curve: DataFrame, ranges: tuple[float, float], y_range: tuple[float, float],
    group: str, position: str, base: str, tie: str, variant: str = "quantile", name: str = "pred",
) -> DataFrame:
    """Base prediction pulled towards the curve, re-centred per group and scaled to the larger of its
    own range and a share of the usual group range; falling in sequence; clipped to the target."""
    blend, ratio, kind = CURVE_VARIANTS[variant]
    floor = (ranges[0] if kind == "median" else ranges[1]) * ratio
    at = read_curve(df, curve, position, tie, "__c")
    at = with_stats(
        at, [group],
        F.greatest(F.max(base) - F.min(base), F.lit(1e-12)).alias("__r"), F.avg(base).alias("__m"), F.avg("__c").alias("__cm"),
    )
    drawn = F.col("__m") + (F.col("__c") - F.col("__cm")) * F.greatest(F.col("__r"), F.lit(floor))
    at = at.withColumn("__o", drawn * blend + F.col(base) * (1 - blend)).drop("__c", "__r", "__m", "__cm")
    at = ordinal(at, [group], [position, tie], "__at_k")

    def clipped(c: str) -> Column:
        return F.greatest(F.least(F.col(c), F.lit(y_range[1])), F.lit(y_range[0]))

    out = isotonic_by_group(at, group, [position, tie], "__o", "__f", rank="__at_k").withColumn("__f", clipped("__f"))
    if variant == "upper_anchor":
        out = with_stats(out, [group], (F.max("__f") - F.min("__f")).alias("__r"))
        missing = F.greatest(F.lit(ranges[1] * 0.8) - F.col("__r"), F.lit(0.0))
        lift = F.when(F.col(position) <= 0.45, missing * 0.35 * (1 - F.col(position) / 0.45)).otherwise(0.0)
        out = cut(out.withColumn("__u", F.col("__f") + lift).drop("__r", "__f"))
        out = isotonic_by_group(out, group, [position, tie], "__u", "__f", rank="__at_k").drop("__u").withColumn("__f", clipped("__f"))
    return out.withColumn(name, F.col("__f")).drop("__o", "__f", "__at_k")
