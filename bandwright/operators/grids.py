"""Parameter grids as data and staged chains (GRD)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .moments import spectra_matrix
from .ordered import quantile_values


def settings(**lists: Sequence) -> list[dict]:
    """Every combination of a few short lists, with a name built from its values."""
    out = []
    for values in product(*lists.values()):
        row = dict(zip(lists, values))
        row["name"] = "_".join(f"{k}{tag(v)}" for k, v in row.items())
        out.append(row)
    return out


def tag(value) -> str:
    return f"{value:g}".replace("-", "m").replace(".", "p") if isinstance(value, (int, float)) else str(value)


def spec_table(spark: SparkSession, specs: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame(list(specs))


def explode_specs(df: DataFrame, specs: Sequence[dict], name: str = "spec") -> DataFrame:
    """Each row once per setting; the settings are a literal array, so nothing is joined or shuffled."""
    lits = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in specs])
    return df.withColumn(name, F.explode(lits))


def shortlist(scores: DataFrame, key: str, n: int, tie: str = "name") -> DataFrame:
    """The n best settings of a cheap pass."""
    return scores.orderBy(F.col(key).asc_nulls_last(), tie).limit(n)


def recheck(
    scores: DataFrame, key: str, n: int, run: Callable[[list[str]], DataFrame], tie: str = "name", nested: str = "nested"
) -> DataFrame:
    """Shortlist by the cheap score, run the n settings again with nested folds, rank by the second score."""
    head = shortlist(scores, key, n, tie)
    names = [r[tie] for r in head.select(tie).collect()]
    return head.join(run(names), tie).orderBy(F.col(nested).asc_nulls_last(), tie)


def keep_worthy(table: DataFrame, order: Sequence[Column | str], n: int, max_corr: float = 0.80, max_jaccard: float = 0.50) -> DataFrame:
    """Passing candidates that are not too alike, best n."""
    ok = (F.col("submit_gate") == "pass") & (F.col("max_pairwise_corr") <= max_corr) & (F.col("max_changed_jaccard") <= max_jaccard)
    return table.where(ok).orderBy(*order).limit(n)


def chain(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], true: str = "y", pred: str = "p") -> DataFrame:
    """An anchor rebuilt step by step. Each step reads the current prediction and residual ``r`` and
    returns the frame with the new prediction; the plan is cut between stages."""
    out = df.withColumn("r", F.col(true) - F.col(pred))
    for step in steps:
        out = cut(step(out).withColumn("r", F.col(true) - F.col(pred)))
    return out


def bandwidth(df: DataFrame, multiplier: float = 1.0, sample: int = 600, x: str = "x", tie: str = "id") -> float:
    """multiplier / median^2 of the pairwise distances of at most ``sample`` rows (the operator samples)."""
    picked = df.select(tie, F.col(x).alias("x")).orderBy(F.xxhash64(tie), tie).limit(sample)
    held = picked.toArrow().combine_chunks()
    col = held.column("x")
    mat = spectra_matrix(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col)
    rows, cols = np.triu_indices(len(mat), 1)
    dist = np.sqrt(((mat[rows] - mat[cols]) ** 2).sum(1)) if len(mat) * len(mat) * mat.shape[1] < 5e7 else np.concatenate(
        [np.sqrt(((mat[k + 1 :] - mat[k]) ** 2).sum(1)) for k in range(len(mat) - 1)]
    )
    dist = dist[dist > 1e-12]
    mid = float(np.median(dist)) if len(dist) else 1.0
    return multiplier / max(mid * mid, 1e-12)


def pick_list(scored: DataFrame, group_corr: str, corr: str, order: Sequence[Column | str], n: int = 300) -> DataFrame:
    """Windows with group |corr| >= 0.82 or |corr| >= 0.88, first n in order."""
    return scored.where((F.col(group_corr) >= 0.82) | (F.abs(corr) >= 0.88)).orderBy(*order).limit(n)


def signals(branches: dict[str, DataFrame], anchor: str = "anchor", pred: str = "pred") -> DataFrame:
    """Named branches (id, domain, anchor, pred) as one long table of signals."""
    out = None
    for name, df in branches.items():
        part = df.select(F.lit(name).alias("branch"), "domain", "id", (F.col(pred) - F.col(anchor)).alias("signal"))
        out = part if out is None else out.unionByName(part)
    return out
