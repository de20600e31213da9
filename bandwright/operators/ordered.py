"""Ranks, quantiles, neighbours in order and running sums that never put one group in one task.

``ordinal`` sorts by range, numbers rows inside each partition and adds per-partition offsets, so a
group with a third of all rows is spread over many tasks. Everything else builds on that number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..session import cut

BLOCK = 100_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join that keeps one copy of the keys."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__{k}")
    if not keys:
        return left.join(renamed, F.lit(True), "inner" if how == "inner" else "left")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def with_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach group aggregates to every row: a partial aggregate and a lookup join. A window over the
    group would move every row of a large group to one task."""
    if not keys:
        row = df.agg(*aggs).first()
        return df.withColumns({n: F.lit(row[n]) for n in row.asDict()})
    return join_on(df, df.groupBy(*keys).agg(*aggs), keys)


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """0-based position within ``keys`` by ``order``; ``order`` must be unique for stable results. The same
    range sort at every size."""
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    numbered = cut(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("__om", F.monotonically_increasing_id())
    )
    numbered = (
        numbered.withColumn("__op", F.shiftright("__om", 33))
        .withColumn("__om", F.col("__om").bitwiseAND((1 << 33) - 1))
    )
    parts = numbered.groupBy("__op", *keys).agg(F.min("__om").alias("__of"), F.count("*").alias("__on"))
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("__op").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "__op",
        *keys,
        (F.coalesce(F.sum("__on").over(before), F.lit(0)) - F.col("__of")).alias("__oo"),
    )
    return (
        join_on(numbered, offsets, ["__op", *keys])
        .withColumn(name, F.col("__om") + F.col("__oo"))
        .drop("__om", "__op", "__oo")
    )


def previous(df: DataFrame, keys: Sequence[str], rank: str, value: str, name: str) -> DataFrame:
    """Value of the row one rank earlier in the group; windows run over bounded blocks of ranks."""
    blocked = df.withColumn("__b", F.floor(F.col(rank) / BLOCK))
    w = Window.partitionBy(*keys, "__b").orderBy(rank)
    edge = df.where(F.col(rank) % BLOCK == BLOCK - 1).select(
        *keys, (F.floor(F.col(rank) / BLOCK) + 1).alias("__b"), F.col(value).alias("__edge")
    )
    out = join_on(blocked.withColumn("__lag", F.lag(value).over(w)), edge, [*keys, "__b"])
    return out.withColumn(
        name, F.when(F.col(rank) % BLOCK == 0, F.col("__edge")).otherwise(F.col("__lag"))
    ).drop("__b", "__lag", "__edge")


def running_sum(df: DataFrame, keys: Sequence[str], rank: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and including the row, in rank order within the group."""
    blocked = df.withColumn("__b", F.floor(F.col(rank) / BLOCK))
    totals = blocked.groupBy(*keys, "__b").agg(F.sum(value).alias("__ord_t"))
    earlier = Window.partitionBy(*keys, F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__b", F.coalesce(F.sum("__ord_t").over(earlier), F.lit(0.0)).alias("__offset")
    )
    w = Window.partitionBy(*keys, "__b").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    out = join_on(blocked.withColumn("__own", F.sum(value).over(w)), offsets, [*keys, "__b"])
    return out.withColumn(name, F.col("__own") + F.col("__offset")).drop("__b", "__own", "__offset")


# ---- quantiles -------------------------------------------------------------------------


# Right shifts of the three rounds of a quantile: 20, 22 and 22 bits of a value are told apart.
SHIFTS = (44, 22, 0)


def _bits(v: pd.Series) -> pd.Series:
    x = v.to_numpy(np.float64) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


def _values(b: pd.Series) -> pd.Series:
    bits = b.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


# Made at each use: a function object of Spark's that has been used cannot travel with the package's code.
def _ordered_bits(v: Column) -> Column:
    """Doubles as whole numbers in the same order; both zeros are one value and NaN is the largest."""
    return F.pandas_udf(_bits, LongType())(v)


def _from_bits(b: Column) -> Column:
    return F.pandas_udf(_values, DoubleType())(b)


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), prefix: str = "q"
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, as columns ``q0, q1, ..``, without a sort of the values.

    Three rounds of counts: of the leading bits of the ordered doubles, then of the next bits of those classes that
    hold a wanted rank, then of single values in those that still do. Counts add up on the map side, so a value that
    most rows have is one row per task. What is put in order is a group's classes of one round.
    """
    src = cut(df.where(F.col(value).isNotNull()).select(*keys, _ordered_bits(F.col(value).cast("double")).alias("__v")))
    ranks = lambda n: F.array_distinct(F.flatten(F.array(*[F.array(f((n - 1) * p)) for p in probs for f in (F.floor, F.ceil)])))
    wanted, last = None, 64
    for shift in SHIFTS:
        rows = src.withColumn("__b", F.shiftright("__v", shift))
        if wanted is None:
            counts = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
        else:
            # Of these joins only the right side can be sent to every task: the written rows pack so well that by
            # their file size they would be taken for a small table.
            rows, near = rows.withColumn("__c", F.shiftright("__v", last)), wanted.withColumnRenamed("__b", "__c")
            inside = join_on(rows, near.select(*keys, "__c"), [*keys, "__c"], "left_semi")
            counts = join_on(inside.groupBy(*keys, "__c", "__b").agg(F.count("*").alias("__n")), near, [*keys, "__c"])
        within = Window.partitionBy(*(keys if wanted is None else [*keys, "__c"]), F.lit(0))
        before = F.coalesce(F.sum("__n").over(within.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("__f", before)
        if wanted is None:
            counts = counts.withColumn("__t", F.sum("__n").over(within))
            counts = counts.withColumn("__r", F.transform(ranks(F.col("__t")), lambda r: F.struct(r.alias("rank"), r.alias("at"))))
        held = F.filter("__r", lambda r: (r["at"] >= F.col("__f")) & (r["at"] < F.col("__f") + F.col("__n")))
        wanted = counts.withColumn("__r", F.transform(held, lambda r: F.struct(r["rank"].alias("rank"), (r["at"] - F.col("__f")).alias("at"))))
        wanted = cut(wanted.where(F.size("__r") > 0).select(*keys, "__b", "__r", "__t"))
        last = shift
    found = wanted.withColumn("__x", _from_bits(F.col("__b"))).select(*keys, "__t", "__x", F.explode("__r.rank").alias("__r"))
    aggs = []
    for j, p in enumerate(probs):
        h = (F.col("__t") - 1) * p
        lo, hi = (F.max(F.when(F.col("__r") == f(h), F.col("__x"))) for f in (F.floor, F.ceil))
        aggs.append((lo + (hi - lo) * F.max(h - F.floor(h))).alias(f"{prefix}{j}"))
    return found.groupBy(*keys).agg(*aggs)


def _order_values(coded: DataFrame, ranks: Callable[[int], list[int]]) -> tuple[int, dict[int, int]]:
    """(Number of values, rank to ordered bits) of one column of ordered bits, by rounds of 16 bits: at most 65,536
    counts a round and wanted class reach the driver."""
    total, want = 0, {}
    for shift in (48, 32, 16, 0):
        rows = coded.withColumn("__b", F.shiftright("__v", shift))
        if shift < 48:
            rows = rows.where(F.shiftright("__v", shift + 16).isin(list(want)))
        counts = sorted((r["__b"], r["count"]) for r in rows.groupBy("__b").count().collect())
        if shift == 48:
            total = sum(n for _, n in counts)
            want = {None: [(r, r) for r in ranks(total)] if total else []}
        found: dict[int, list[tuple[int, int]]] = {}
        for outer, inner in want.items():
            before = 0
            for b, n in counts:
                if outer is not None and b >> 16 != outer:
                    continue
                for rank, at in inner:
                    if before <= at < before + n:
                        found.setdefault(b, []).append((rank, at - before))
                before += n
        want = found
        if not want:
            break
    return total, {rank: b for b, held in want.items() for rank, _ in held}


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """The same for the whole frame, as numbers for use in literals."""
    coded = cut(df.where(F.col(value).isNotNull()).select(_ordered_bits(F.col(value).cast("double")).alias("__v")))
    places = lambda n: [(n - 1) * p for p in probs]
    n, found = _order_values(coded, lambda n: sorted({f(h) for h in places(n) for f in (math.floor, math.ceil)}))
    if not n:
        return [None] * len(probs)
    x = dict(zip(found, _values(pd.Series(list(found.values()), dtype=np.int64))))
    return [float(x[math.floor(h)] + (x[math.ceil(h)] - x[math.floor(h)]) * (h - math.floor(h))) for h in places(n)]


def with_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), prefix: str = "q"
) -> DataFrame:
    if not keys:
        vals = quantile_values(df, value, probs)
        return df.withColumns({f"{prefix}{j}": F.lit(v) for j, v in enumerate(vals)})
    return join_on(df, quantiles(df, value, probs, keys, prefix), keys)


# ---- positions and percentile ranks ----------------------------------------------------


def group_position(df: DataFrame, grp: str, seq: str, name: str) -> DataFrame:
    """(seq - min) / max(width, 1) within the group."""
    out = with_stats(df, [grp], F.min(seq).alias("__ord_lo"), F.max(seq).alias("__ord_hi"))
    return out.withColumn(
        name, (F.col(seq) - F.col("__ord_lo")) / F.greatest(F.col("__ord_hi") - F.col("__ord_lo"), F.lit(1.0))
    ).drop("__ord_lo", "__ord_hi")


def rank_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Ordinal rank / (n - 1) within the group; 0 for a group of one."""
    out = with_stats(ordinal(df, keys, order, "__ord_r"), keys, F.count("*").alias("__ord_n"))
    return out.withColumn(name, F.col("__ord_r") / F.greatest(F.col("__ord_n") - 1, F.lit(1))).drop("__ord_r", "__ord_n")


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, __vn, __vu): how many rows have the value, and how many have it or come before it. Rows are
    counted by value first, so only distinct values are put in order."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__vn"))
    return running_sum(ordinal(counts, keys, [value], "__vr"), keys, "__vr", "__vn", "__vu").drop("__vr")


def _tie_rank(df: DataFrame, value: str, name: str, keys: Sequence[str]) -> DataFrame:
    shared = value_counts(df, value, keys).select(*keys, value, (F.col("__vu") - (F.col("__vn") - 1) / 2).alias(name))
    return join_on(df, shared, [*keys, value])


def tie_rank(
    df: DataFrame, value: str, tie: str, name: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Rank from 1 with ties averaged: it follows from the counts of values, whatever the order of ``tie``. The rows
    are written once, without a shuffle, as they are read twice."""
    return _tie_rank(cut(df), value, name, keys)


def percent_rank(
    df: DataFrame, value: str, tie: str, name: str, flavour: str = "average", keys: Sequence[str] = ()
) -> DataFrame:
    """``average``: tie-averaged rank / n. ``ordinal``: rank / (n - 1). ``minmax``: scaled value."""
    if flavour == "average":
        out = _tie_rank(with_stats(cut(df), keys, F.count("*").alias("__ord_n")), value, "__ord_t", keys)
        return out.withColumn(name, F.col("__ord_t") / F.col("__ord_n")).drop("__ord_t", "__ord_n")
    if flavour == "ordinal":
        return rank_position(df, keys, [value, tie], name)
    if flavour == "minmax":
        out = with_stats(df, keys, F.min(value).alias("__ord_lo"), F.max(value).alias("__ord_hi"))
        width = F.col("__ord_hi") - F.col("__ord_lo")
        return out.withColumn(
            name, F.when(width <= 1e-12, F.lit(0.0)).otherwise((F.col(value) - F.col("__ord_lo")) / width)
        ).drop("__ord_lo", "__ord_hi")
    raise ValueError(f"unknown flavour {flavour}")


def equal_bins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bins: int, name: str) -> DataFrame:
    """Bins cut at floor(n * i / bins); unlike ntile the spare rows do not go to the first bins."""
    out = with_stats(ordinal(df, keys, order, "__ord_r"), keys, F.count("*").alias("__ord_n"))
    return out.withColumn(
        name, F.floor((F.lit(bins) * (F.col("__ord_r") + 1) - 1) / F.col("__ord_n"))
    ).drop("__ord_r", "__ord_n")


def carry(
    df: DataFrame, keys: Sequence[str], rank: str, value: str, name: str, forward: bool = True
) -> DataFrame:
    """Last non-null ``value`` at or before the row (``forward``), or first at or after it."""
    sign = 1 if forward else -1
    blocked = df.withColumn("__b", F.floor(F.col(rank) / BLOCK))
    inside = Window.partitionBy(*keys, "__b").orderBy(F.col(rank) * sign).rowsBetween(
        Window.unboundedPreceding, 0
    )
    ends = blocked.where(F.col(value).isNotNull()).groupBy(*keys, "__b").agg(
        (F.max_by if forward else F.min_by)(value, rank).alias("__end")
    )
    held = blocked.select(*keys, "__b").distinct()
    held = join_on(held, ends, [*keys, "__b"])
    earlier = Window.partitionBy(*keys, F.lit(0)).orderBy(F.col("__b") * sign).rowsBetween(
        Window.unboundedPreceding, -1
    )
    edges = held.select(*keys, "__b", F.last("__end", ignorenulls=True).over(earlier).alias("__edge"))
    out = join_on(
        blocked.withColumn("__own", F.last(value, ignorenulls=True).over(inside)), edges, [*keys, "__b"]
    )
    return out.withColumn(name, F.coalesce("__own", "__edge")).drop("__b", "__own", "__edge")


def half_even(value: float) -> int:
    """Round half to even, as Python does."""
    return int(round(value))
