"""Top-k, gates and capped selections (TOP). Ties go to the higher row id unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut, scratch_path
from . import moments as M
from .ordered import half_even, join_on, ordinal, with_stats


def fraction_size(n: int, frac: float, least: int = 1) -> int:
    return max(least, half_even(n * frac))


def top_bands(corr: DataFrame, k: int, keys: Sequence[str] = (), ties: str = "high") -> DataFrame:
    """The k bands with the largest |corr|; ``ties`` prefers the high or the low band."""
    band = F.col("band").desc() if ties == "high" else F.col("band").asc()
    w = Window.partitionBy(*keys, F.lit(0)).orderBy(F.abs("corr").desc(), band)
    return corr.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def stable_top_bands(df: DataFrame, k: int, row_no: str, chunks: int = 5) -> DataFrame:
    """Sum of 1/rank of each band's place in the top 3k over chunks left out in turn."""
    parts = M.band_moments(df.withColumn("chunk", F.pmod(F.col(row_no), F.lit(chunks))), ["chunk"])
    rest = M.complement(parts, "chunk")
    usable = rest.where(M.m_xx() / F.greatest(F.col("n") - 1, F.lit(1)) >= 1e-6)
    ranked = top_bands(usable.withColumn("corr", M.pearson()), 3 * k, ["chunk"])
    votes = ranked.groupBy("band").agg(F.sum(1.0 / F.col("pos")).alias("votes"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("votes").desc(), "band")
    return votes.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def quartile_contrast(df: DataFrame, low: float, high: float, y: str = "y") -> DataFrame:
    """|mean(x | y >= high) - mean(x | y <= low)| per band."""
    long = df.select(y, F.posexplode("x").alias("band", "v"))
    return long.groupBy("band").agg(
        F.abs(F.avg(F.when(F.col(y) >= high, F.col("v"))) - F.avg(F.when(F.col(y) <= low, F.col("v")))).alias("contrast")
    )


def _before(score: str, tie: str, last_score: Column, last_tie: Column) -> Column:
    """Whether a row stands at or before another one in the order of falling scores (ties: higher id; nulls last)."""
    s, t = F.col(score), F.col(tie)
    higher = F.coalesce(s > last_score, s.isNotNull() & last_score.isNull())
    return higher | (s.eqNullSafe(last_score) & (last_tie.isNull() | F.coalesce(t >= last_tie, F.lit(False))))


def first_rows(df: DataFrame, score: str, tie: str, k: int) -> Column:
    """Whether a row is among the k of ``df`` with the largest scores (ties: higher id). Only scores and ids are put in
    order; rows are then compared with the k-th."""
    by = [F.col(score).desc(), F.col(tie).desc()]
    last = ordinal(df.select(score, tie), [], by, "__g").where(F.col("__g") == k - 1).first()
    return F.lit(True) if last is None else _before(score, tie, F.lit(last[score]), F.lit(last[tie]))


def top_fraction(df: DataFrame, score: str, tie: str, frac: float, name: str = "gate") -> DataFrame:
    df = cut(df)
    return df.withColumn(name, first_rows(df, score, tie, fraction_size(df.count(), frac)))


def _within_cap(df: DataFrame, score: str, tie: str, label: str, cap: int, name: str, free: Column | None = None) -> DataFrame:
    """Marks the ``cap`` rows of each label with the largest scores, of those that are ``free``, by comparison with the
    last of them."""
    free = F.lit(True) if free is None else F.coalesce(free, F.lit(False))
    by = [F.col(score).desc(), F.col(tie).desc()]
    ranked = ordinal(df.where(free).select(label, score, tie), [label], by, "__l").where(F.col("__l") == cap - 1)
    last = ranked.select(label, F.col(score).alias("__ls"), F.col(tie).alias("__lt"), F.lit(True).alias("__full"))
    inside = free & (F.col("__full").isNull() | _before(score, tie, F.col("__ls"), F.col("__lt")))
    return join_on(df, last, [label]).withColumn(name, inside).drop("__ls", "__lt", "__full")


def capped_top_fraction(
    df: DataFrame, score: str, tie: str, label: str, frac: float, cap: int, name: str = "gate", refill: bool = True
) -> DataFrame:
    """At most ``cap`` rows per label in score order; when that leaves room, the best of the rest."""
    df = cut(df)
    k = fraction_size(df.count(), frac)
    marked = _within_cap(df, score, tie, label, cap, "__in")
    held = df.groupBy(label).count().agg(F.sum(F.least("count", F.lit(cap)))).first()[0] or 0
    if held >= k:
        chosen = F.col("__in") & first_rows(marked.where("__in"), score, tie, k)
    elif refill:
        chosen = F.col("__in") | first_rows(marked.where("NOT __in"), score, tie, k - held)
    else:
        chosen = F.col("__in")
    return marked.withColumn(name, chosen).drop("__in")


def cap_gate(df: DataFrame, gate: str, signal: str, tie: str, label: str, cap: int, name: str = "capped") -> DataFrame:
    """Keep the ``cap`` largest |signal| of an existing gate per label."""
    ranked = ordinal(df, [gate, label], [F.abs(signal).desc(), F.col(tie).desc()], "__l")
    return ranked.withColumn(name, F.col(gate) & (F.col("__l") < cap)).drop("__l")


def centred_correction(df: DataFrame, chosen: Column, signal: str, blend: float, clip: float, name: str) -> DataFrame:
    """clip(blend * signal) on the chosen rows, less its mean over them; 0 elsewhere."""
    raw = F.greatest(F.least(F.col(signal) * blend, F.lit(clip)), F.lit(-clip))
    marked = df.withColumn("__raw", F.when(chosen, raw))
    out = with_stats(marked, [], F.avg("__raw").alias("__mean"))
    return out.withColumn(name, F.coalesce(F.col("__raw") - F.col("__mean"), F.lit(0.0))).drop("__raw", "__mean")


def balanced_selection(
    df: DataFrame, signal: str, tie: str, frac: float, blend: float, clip: float, name: str = "corr"
) -> DataFrame:
    """Half the budget on the largest positive signals, half on the most negative."""
    n = df.count()
    each = max(1, half_even(n * frac / 2.0))
    ranked = ordinal(df, [], [signal, tie], "__s")
    chosen = ((F.col("__s") >= n - each) & (F.col(signal) > 0)) | ((F.col("__s") < each) & (F.col(signal) < 0))
    return centred_correction(ranked, chosen, signal, blend, clip, name).drop("__s")


def _capped_pick(df: DataFrame, score: str, tie: str, label: str, cap: int, n: int, name: str) -> DataFrame:
    """Best n positive scores with at most ``cap`` per label."""
    positive = F.col(score) > 0
    marked = _within_cap(df, score, tie, label, cap, "__in", positive)
    chosen = F.col("__in") & first_rows(marked.where("__in"), score, tie, n)
    return marked.withColumn(name, chosen).drop("__in")


def asymmetric_selection(
    df: DataFrame, signal: str, tie: str, label: str, cap: int, pos_frac: float, neg_ratio: float,
    blend: float, clip: float, residual: str | None = None, banned: Column | None = None, name: str = "corr",
) -> DataFrame:
    """Different counts of raises and lowers; with a residual, only rows that agree with it."""
    s = F.col(signal)
    if residual is None:
        up, down = F.greatest(s, F.lit(0.0)), F.greatest(-s, F.lit(0.0))
    else:
        r = F.col(residual)
        up = F.when((s > 0) & (r > 0), s * F.abs(r)).otherwise(0.0)
        down = F.when((s < 0) & (r < 0), -s * F.abs(r)).otherwise(0.0)
    free = F.lit(True) if banned is None else ~banned
    base = df.withColumn("__up", F.when(free, up).otherwise(0.0)).withColumn("__down", F.when(free, down).otherwise(0.0))
    base = cut(base)
    n_pos = fraction_size(base.count(), pos_frac)
    n_neg = max(1, half_even(n_pos * neg_ratio))
    base = _capped_pick(base, "__up", tie, label, cap, n_pos, "__a")
    base = _capped_pick(base, "__down", tie, label, cap, n_neg, "__b")
    chosen = F.col("__a") | F.col("__b")
    return centred_correction(base, chosen, signal, blend, clip, name).drop("__up", "__down", "__a", "__b")


def damp_large(df: DataFrame, corr: str, tie: str, label: str, cap: int, power: float, name: str = "damped") -> DataFrame:
    """Multiply by min(1, (cap / rank)^power), rank by |corr| within the label."""
    ranked = ordinal(df, [label], [F.abs(corr).desc(), F.col(tie).desc()], "__l")
    return ranked.withColumn(
        name, F.col(corr) * F.least(F.lit(1.0), F.pow(F.lit(float(cap)) / (F.col("__l") + 1), F.lit(power)))
    ).drop("__l")


def keep_set(
    df: DataFrame, score: str, tie: str, group: str, frac: float, min_keep: int, per_group: int = 3, name: str = "keep"
) -> DataFrame:
    """Top fraction (at least ``min_keep``), then rows added from groups short of ``per_group``."""
    n = df.count()
    k = min(n, fraction_size(n, frac, min_keep))
    by = [F.col(score).desc(), F.col(tie).desc()]
    ranked = ordinal(df, [], by, "__g").withColumn("__k", F.col("__g") < k)
    ranked = with_stats(ranked, [group], F.sum(F.col("__k").cast("int")).alias("__have"))
    ranked = ordinal(ranked, [group], by, "__l")
    return ranked.withColumn(
        name, F.col("__k") | (F.col("__l") < F.lit(per_group) - F.col("__have"))
    ).drop("__g", "__k", "__have", "__l")


def top_overlap(df: DataFrame, a: str, b: str, tie: str, n: int) -> DataFrame:
    """Share of common rows among the n largest |a| and the n largest |b|."""
    def top(c: str) -> DataFrame:
        return df.orderBy(F.abs(c).desc(), F.col(tie).desc()).limit(n).select(tie)

    both = top(a).join(top(b), tie, "left_semi")
    return both.agg((F.count("*") / F.lit(n)).alias("overlap"))


# Cells of the rows in a max-min order; their pivots, best rows and point numbers are what the driver holds.
CELLS = 64


def _distances(x: np.ndarray, y: np.ndarray, point: tuple, scale: float, y_scale: float, x_weight: float) -> np.ndarray:
    """Distance of every row to one point; with a target part where ``x_weight`` is below 1."""
    d = np.sqrt(((x - point[0]) ** 2).sum(1)) / scale
    return d if x_weight == 1.0 else d * x_weight + np.abs(y - point[1]) / y_scale * (1 - x_weight)


def _by_cells(base: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The rows with the number of the nearest pivot, written in a folder per cell, and the pivots. Ranges of
    (cell, hash) are written, so a cell with most rows is many files."""
    held = base.orderBy(F.xxhash64("__t"), "__t").limit(CELLS).select("__x").collect()
    pivots = np.unique(np.array([r["__x"] for r in held], float), axis=0)
    shared = base.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = M.spectra_matrix(b.column("__x"))
                near = np.stack([((x - p) ** 2).sum(1) for p in shared.value], 1).argmin(1)
                yield b.append_column("cell", pa.array(near.astype(np.int32)))

    placed = base.mapInArrow(run, StructType([*base.schema.fields, StructField("cell", IntegerType())]))
    path = scratch_path(base.sparkSession, "cells")
    placed.repartitionByRange("cell", F.xxhash64("__t")).write.partitionBy("cell").parquet(path)
    return base.sparkSession.read.schema(placed.schema).parquet(path), pivots


def _best_of_cells(table: DataFrame, cells: list[int], state: dict) -> dict[int, dict]:
    """The row of each asked cell with the largest smallest distance to the cell's points (ties: low id), and the
    cell's radius around its pivot. One row per task and cell leaves the tasks."""
    shared = table.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict] = {}
        kind = None
        for b in batches:
            if not b.num_rows:
                continue
            kind, now = b.column("__t").type, shared.value
            of = b.column("cell").to_numpy()
            for c in np.unique(of).tolist():
                part = b.take(pa.array(np.flatnonzero(of == c)))
                x, y = M.spectra_matrix(part.column("__x")), part.column("__y").to_numpy(zero_copy_only=False).astype(float)
                score = np.full(len(x), np.inf)
                for i in now["of"][c]:
                    score = np.minimum(score, _distances(x, y, now["points"][i], *now["scales"]))
                out = pc.is_in(part.column("__t"), value_set=pa.array(now["taken"], kind)).to_numpy(zero_copy_only=False)
                score = np.where(out | np.isnan(score), -1.0, score)
                at = np.flatnonzero(score == score.max())
                ids = part.column("__t").take(pa.array(at))
                i = int(at[pc.index(ids, pc.min(ids)).as_py()])
                row = {"cell": c, "s": float(score[i]), "t": part.column("__t")[i].as_py(), "x": x[i].tolist(), "y": float(y[i])}
                row["r"] = float(np.sqrt(((x - now["pivots"][c]) ** 2).sum(1)).max())
                if c in best:
                    r = max(row["r"], best[c]["r"])
                    row = min(row, best[c], key=lambda v: (-v["s"], v["t"])) | {"r": r}
                best[c] = row
        if best:
            kinds = [("cell", pa.int32()), ("s", pa.float64()), ("t", kind), ("x", pa.list_(pa.float64())), ("y", pa.float64()), ("r", pa.float64())]
            yield pa.RecordBatch.from_pylist(list(best.values()), schema=pa.schema(kinds))

    ddl = f"cell int, s double, t {table.schema['__t'].dataType.simpleString()}, x array<double>, y double, r double"
    found = table.where(F.col("cell").isin(cells)).mapInArrow(run, ddl)
    row = F.struct("s", "t", "x", "y")
    top = found.groupBy("cell").agg(F.min_by(row, F.struct((-F.col("s")).alias("s"), "t")).alias("b"), F.max("r").alias("r"))
    return {r["cell"]: r["b"].asDict() | {"r": r["r"]} for r in top.collect()}


def farthest_points(
    df: DataFrame, k: int, x: str = "x", tie: str = "id", y: str | None = None, x_weight: float = 1.0, read: list | None = None
) -> list:
    """First k ids of the max-min order, starting from the row farthest from the centroid (ties: low id). Rows
    without a vector, or without a target where it counts, are not chosen; rows that repeat an id are taken together.

    Rows are written once by cell. A cell's best row stays its best until a new point comes closer to it than its
    distance, as the distances of all other rows only fall; till it is looked at again its old distance is an upper
    bound. So a step reads only cells with an outdated best row whose bound reaches the best of the others, and of
    the points a cell is compared with those near enough to matter (triangle inequality). ``read`` gets the cells
    read for each point.
    """
    mixed = bool(y) and x_weight < 0.999
    target = F.col(y) if y else F.lit(None)
    base = df.where(F.col(x).isNotNull()).select(F.col(tie).alias("__t"), F.col(x).alias("__x"), target.cast("double").alias("__y"))
    centre = M.mean_spectrum(base.select(F.col("__x").alias("x")))
    if not centre or k < 1:
        return []
    table, pivots = _by_cells(base)
    state = {"pivots": pivots, "taken": [], "points": [(np.array(centre), 0.0)], "of": [[0]] * len(pivots), "scales": (1.0, 1.0, 1.0)}
    best = _best_of_cells(table, list(range(len(pivots))), state)
    first = lambda held: min(held, key=lambda b: (-b["s"], b["t"]), default=None)
    step = first(best.values())
    if mixed:
        span = base.agg((F.max("__y") - F.min("__y")).alias("s")).first()["s"]
        state["scales"] = (2.0 * step["s"] or 1.0, span or 1.0, x_weight)
    state |= {"points": [], "of": {c: [] for c in best}}
    scale, _, weight = state["scales"]
    outdated = set(best)
    for b in best.values():
        b["s"] = np.inf
    chosen, seen = [], []
    while True:
        chosen.append(step["t"])
        if len(chosen) == k:
            break
        point = (np.array(step["x"]), step["y"])
        state["points"].append(point)
        state["taken"].append(step["t"])
        for c, b in best.items():
            to_best = _distances(np.array([b["x"]]), np.array([b["y"]]), point, *state["scales"])[0]
            if b["t"] == step["t"] or not to_best > b["s"] * (1 + 1e-12):
                outdated.add(c)
            nearest = (np.sqrt(((pivots[c] - point[0]) ** 2).sum()) - b["r"]) * weight / scale
            if not nearest > b["s"] * (1 + 1e-9):
                state["of"][c].append(len(chosen) - 1)
        while True:
            known = first(b for c, b in best.items() if c not in outdated)
            again = sorted(c for c in outdated if known is None or best[c]["s"] >= known["s"])
            if not again:
                break
            best |= _best_of_cells(table, again, state)
            outdated -= set(again)
            seen += again
        if read is not None:
            read.append(seen)
        seen, step = [], known
        if step["s"] < 0:
            break
    return chosen


def replicate(df: DataFrame, weight: str, low: float, high: float) -> DataFrame:
    """Rows repeated 1, 2 or 3 times by two weight edges."""
    times = F.when(F.col(weight) >= high, 3).when(F.col(weight) >= low, 2).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def one_per_bucket(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], n: int) -> DataFrame:
    """The n best rows per key."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
