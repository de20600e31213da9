"""Folds (CV-1..6) and out-of-fold prediction (CV-7..11)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import cut
from . import solvers as So
from .moments import Gram, GramTable, each_gram, gram_table
from .ordered import join_on, ordinal


def _deal(sizes: list[int], step: int, groups: int) -> list[int]:
    """How many of ``groups`` equal groups of ``step`` rows each fold gets, when every one goes to the smallest fold
    so far (lowest number first). A fold's groups come when its size is s, s + step, ..: the groups that are given
    out are those of the smallest such sizes."""
    below = lambda level: [max(0, -(-(level - s) // step)) for s in sizes]
    lo, hi = min(sizes), max(sizes) + step * groups + 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if sum(below(mid)) <= groups else (lo, mid)
    got = below(lo)
    # The rest come at the size ``lo`` itself, by fold number.
    left = groups - sum(got)
    for f, s in enumerate(sizes):
        if left and s <= lo and (lo - s) % step == 0:
            got[f] += 1
            left -= 1
    return got


def group_kfold(df: DataFrame, n: int = 5, group: str = "grp", seen: str = "id") -> DataFrame:
    """Groups by size (largest first, then first seen) into the smallest fold so far (lowest number).

    What reaches the driver is the number of groups of each size. The groups of one size are dealt in closed form:
    the j-th one of fold f has the place in the class that counts the turns of all folds before it, and the k-th
    group of the class, by ``seen``, takes the place k.
    """
    groups = cut(df.groupBy(group).agg(F.count("*").alias("__size"), F.min(seen).alias("__seen")))
    classes = sorted(((r["__size"], r["count"]) for r in groups.groupBy("__size").count().collect()), reverse=True)
    sizes = [0] * min(n, max(1, sum(m for _, m in classes)))
    turns = []
    for size, m in classes:
        turns += [(size, f, sizes[f], got, list(sizes)) for f, got in enumerate(_deal(sizes, size, m)) if got]
        for t in turns[-len(sizes):]:
            if t[0] == size:
                sizes[t[1]] += size * t[3]
    table = df.sparkSession.createDataFrame(turns, "__size long, fold_id long, __from long, __got long, __all array<long>")
    table = table.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__got") - 1)))
    gap = lambda s: F.col("__from") + F.col("__j") * F.col("__size") - s
    # Turns of a fold g before this one: those at a smaller size, and one at the same size if g is a lower number.
    turns_of = F.transform(
        "__all", lambda s, g: F.when(gap(s) >= 0, F.ceil(gap(s) / F.col("__size")) + ((gap(s) % F.col("__size") == 0) & (g < F.col("fold_id"))).cast("long")).otherwise(F.lit(0).cast("long")),
    )
    table = table.select("__size", F.aggregate(turns_of, F.lit(0).cast("long"), lambda a, b: a + b).alias("__k"), "fold_id")
    numbered = ordinal(groups, ["__size"], ["__seen"], "__k")
    placed = numbered.join(table, ["__size", "__k"]).select(group, "fold_id")
    return join_on(df, placed, [group])


def leave_one_group(df: DataFrame, group: str = "grp") -> DataFrame:
    """Fold number = place of the group in sorted order."""
    groups = df.select(group).distinct()
    return join_on(df, ordinal(groups, [], [group], "fold_id"), [group])


def repeated_leave_one_group(df: DataFrame, repeats: int, seed: int = 42, group: str = "grp") -> DataFrame:
    """Each repeat numbers the groups in its own seeded order; rows appear once per repeat."""
    groups = df.select(group).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    key = F.xxhash64(F.col(group), F.col("repeat"), F.lit(seed))
    numbered = ordinal(groups, ["repeat"], [key, group], "fold_id").withColumn(
        "fold_id", F.col("fold_id") + F.col("repeat") * groups.select(group).distinct().count()
    )
    return join_on(df, numbered, [group])


def target_stratified(df: DataFrame, k: int = 5, y: str = "y", tie: str = "id") -> DataFrame:
    return ordinal(df, [], [y, tie], "__r").withColumn("fold_id", F.pmod("__r", F.lit(k))).drop("__r")


def random_kfold(df: DataFrame, k: int = 5, seed: int = 42, tie: str = "id") -> DataFrame:
    """Seeded order by hash, then every k-th row."""
    key = F.xxhash64(F.col(tie), F.lit(seed))
    return ordinal(df, [], [key, tie], "__r").withColumn("fold_id", F.pmod("__r", F.lit(k))).drop("__r")


STRATEGIES: dict[str, Callable[..., DataFrame] | None] = {
    "none": None,
    "group_species": group_kfold,
    "leave_one_species": leave_one_group,
    "repeated_leave_one_species": lambda df: repeated_leave_one_group(df, 3),
    "target_stratified": target_stratified,
    "random": random_kfold,
}


def assign(df: DataFrame, strategy: str) -> DataFrame | None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known: {sorted(STRATEGIES)}")
    fn = STRATEGIES[strategy]
    return None if fn is None else fn(df)


# ---- prediction ------------------------------------------------------------------------


def predict(df: DataFrame, model: So.Linear, name: str = "y_pred", x: str = "x") -> DataFrame:
    """Score with one linear model: a dot product over its non-zero bands."""
    used = model.coef.nonzero()[0]
    if len(used) == 0:
        return df.withColumn(name, F.lit(float(model.intercept)))
    if len(used) <= 16:
        value = F.lit(float(model.intercept))
        for b in used:
            value = value + F.get(x, F.lit(int(b))) * float(model.coef[b])
        return df.withColumn(name, value)
    return df.withColumn(name, A.dot(F.col(x), A.doubles(model.coef)) + float(model.intercept))


MODELS = "k string, n double, m array<struct<spec: string, w: array<double>, b: double, info: string>>"


def solve(
    table: GramTable, fits: Mapping[str, Callable[[Gram], So.Linear]], others: bool = False, min_rows: float = 0, fallback: bool = True
) -> DataFrame:
    """``k, n, m``: for each key of a table of matrices, the models of all ``fits`` on its matrix, or with
    ``others`` on the total less its own. Each matrix is solved in the task that reads it; of the keys nothing but
    this table remains. A matrix of fewer than ``min_rows`` rows gives the models of the total, or none."""
    whole = table.total() if others or min_rows else None
    about, targets = table.about, table.targets
    held = table.rows.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("spec", pa.string()), ("w", pa.list_(pa.float64())), ("b", pa.float64()), ("info", pa.string())]))
        of_all: list[dict] = []

        def models(g: Gram) -> list[dict]:
            made = [(name, fit(g)) for name, fit in fits.items()]
            return [{"spec": name, "w": m.coef.tolist(), "b": float(m.intercept), "info": json.dumps(m.info, default=float)} for name, m in made]

        for k, own in each_gram(batches, about, targets):
            g = held.value - own if others else own
            if g.n >= max(min_rows, 1e-12):
                m = models(g)
            elif fallback and held.value is not None:
                of_all = of_all or models(held.value)
                m = of_all
            else:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.string()), pa.array([g.n]), pa.array([m], kind)], names=["k", "n", "m"])

    return table.rows.mapInArrow(run, MODELS)


def predict_by(df: DataFrame, models: DataFrame, key: str, name: str = "y_pred", x: str = "x") -> DataFrame:
    """Score each row with the (first) model of its key, from a table of ``solve``."""
    table = models.select(F.col("k").alias("__mk"), F.get("m", F.lit(0)).alias("__m"))
    joined = df.join(table, df[key].cast("string") == table["__mk"], "left")
    return joined.withColumn(name, A.dot(F.col(x), F.col("__m.w")) + F.col("__m.b")).drop("__mk", "__m")


def predict_many(df: DataFrame, models: DataFrame, key: str, keep: Sequence[str], x: str = "x") -> DataFrame:
    """Rows (keep.., spec, y_pred): every row scored by the models of its key under all specs."""
    table = models.select(F.col("k").alias("__mk"), F.col("m").alias("__m"))
    joined = df.join(table, df[key].cast("string") == table["__mk"], "left")
    scored = F.transform(
        "__m", lambda m: F.struct(m["spec"].alias("spec"), (A.dot(F.col(x), m["w"]) + m["b"]).alias("y_pred"))
    )
    return joined.select(*keep, F.inline(scored))


def out_of_fold(
    df: DataFrame, fit: Callable[[Gram], So.Linear], fold: str = "fold_id", name: str = "y_pred", y: str | Sequence[str] = "y"
) -> DataFrame:
    """Every fold predicted by a model of the others. One pass gives a matrix per fold; the train side of a fold is
    the total less its own matrix, so no row is read or stored twice. A fold that holds all rows has no model."""
    targets = [y] if isinstance(y, str) else list(y)
    return predict_by(df, solve(gram_table(df, fold, targets), {"": fit}, others=True, fallback=False), fold, name)


def out_of_fold_refit(
    df: DataFrame, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], fold: str = "fold_id"
) -> DataFrame:
    """For predictors that learn something a matrix cannot give (a reference spectrum, trees): one fit
    per fold, the folds joined again."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).limit(1001).collect()]
    if len(folds) > 1000:
        raise ValueError("too many folds for separate fits")
    out = None
    for f in folds:
        part = fit_predict(df.where(F.col(fold) != f), df.where(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out


def guard_score(rmse, worst_rmse, worst_bias):
    """rmse + 0.10 worst-group rmse + 0.15 |worst-group bias|."""
    return rmse + worst_rmse * 0.10 + F.abs(worst_bias) * 0.15


def nested_coefficients(df: DataFrame, fold: str, signal: str, residual: str, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Per fold, s.r / s.s over the other folds, clipped; 0 where the signal vanishes."""
    s, r = F.col(signal), F.col(residual)
    own = df.groupBy(fold).agg(F.sum(s * r).alias("sr"), F.sum(s * s).alias("ss"))
    whole = own.agg(F.sum("sr").alias("tr"), F.sum("ss").alias("ts")).first()
    ss = F.lit(whole["ts"]) - F.col("ss")
    beta = F.when(ss < 1e-12, F.lit(0.0)).otherwise((F.lit(whole["tr"]) - F.col("sr")) / ss)
    return own.select(fold, F.greatest(F.least(beta, F.lit(hi)), F.lit(lo)).alias("beta"))


def nested_correction(df: DataFrame, fold: str, signal: str, residual: str, name: str = "corr") -> DataFrame:
    """Correction of every row by the coefficient of the other folds."""
    out = join_on(df, nested_coefficients(df, fold, signal, residual), [fold])
    return out.withColumn(name, F.col("beta") * F.col(signal))
