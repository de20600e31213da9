"""Sufficient statistics: per-band co-moments (MOM-1) and Gram matrices (MOM-2)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Bytes of rows and matrices a task holds before it passes its partial sums on.
HELD_BYTES = 64 << 20
# Parts of a key that are added up separately before their sums meet, so that no task adds all partial sums of one
# key, and the most that reach the driver for the sum over all keys.
SALTS = 64

SUMS = ("n", "sx", "sy", "sxx", "sxy", "syy")


def mean_spectrum(df: DataFrame) -> list[float]:
    """Mean per band, in band order; d numbers reach the driver."""
    rows = (
        df.select(F.posexplode("x").alias("band", "v")).groupBy("band").agg(F.avg("v").alias("m")).collect()
    )
    return [r["m"] for r in sorted(rows, key=lambda r: r["band"])]


def any_spectrum(df: DataFrame) -> list[float]:
    """Some row's spectrum, used as the point moments are taken about."""
    row = df.select("x").first()
    return [] if row is None else [float(v) for v in row["x"]]


def band_moments(df: DataFrame, keys: Sequence[str], y: str = "y", about: float = 0.0) -> DataFrame:
    """MOM-1: n, Sx, Sy, Sxx, Sxy, Syy per (keys, band). The sums combine on the map side, so what is
    shuffled is one row per task, key and band. ``about`` is subtracted from the target."""
    long = df.select(
        *keys, (F.col(y) - about).alias("y"), F.posexplode("x").alias("band", "v")
    )
    return long.groupBy(*keys, "band").agg(*moment_aggs())


def moment_aggs(x: str = "v", y: str = "y") -> list[Column]:
    vx, vy = F.col(x), F.col(y)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(vx).alias("sx"),
        F.sum(vy).alias("sy"),
        F.sum(vx * vx).alias("sxx"),
        F.sum(vx * vy).alias("sxy"),
        F.sum(vy * vy).alias("syy"),
    ]


def complement(moments: DataFrame, fold: str, by: Sequence[str] = ("band",)) -> DataFrame:
    """Train-side sums of every fold: total minus own."""
    total = moments.groupBy(*by).agg(*[F.sum(c).alias(f"t_{c}") for c in SUMS])
    joined = moments.join(total, list(by))
    return joined.select(fold, *by, *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in SUMS])


def m_xx() -> Column:
    return F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")


def m_xy() -> Column:
    return F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")


def m_yy() -> Column:
    return F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")


def pearson(floor: float = 1e-12) -> Column:
    """Correlation from the sums, with variances and the denominator floored."""
    df = F.greatest(F.col("n") - 1, F.lit(1))
    sx = F.sqrt(F.greatest(m_xx() / df, F.lit(floor)))
    sy = F.sqrt(F.greatest(m_yy() / df, F.lit(floor)))
    return (m_xy() / df) / F.greatest(sx * sy, F.lit(floor))


def slope() -> Column:
    return F.when(m_xx() <= 1e-12, F.lit(0.0)).otherwise(m_xy() / m_xx())


def intercept() -> Column:
    return F.col("sy") / F.col("n") - slope() * F.col("sx") / F.col("n")


# ---- Gram matrices ---------------------------------------------------------------------


@dataclass
class Gram:
    """Weighted sums of products of [1, x - about, targets]; adds and subtracts."""

    m: np.ndarray
    about: np.ndarray
    targets: int

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.m + other.m, self.about, self.targets)

    def __sub__(self, other: "Gram") -> "Gram":
        return Gram(self.m - other.m, self.about, self.targets)

    @property
    def d(self) -> int:
        return self.m.shape[0] - 1 - self.targets

    @property
    def n(self) -> float:
        return float(self.m[0, 0])

    @property
    def mean(self) -> np.ndarray:
        return self.about + self.m[0, 1 : 1 + self.d] / self.n

    def y_mean(self, t: int = 0) -> float:
        return float(self.m[0, 1 + self.d + t] / self.n)

    @property
    def sxx(self) -> np.ndarray:
        """Centred X'X."""
        s = self.m[0, 1 : 1 + self.d]
        return self.m[1 : 1 + self.d, 1 : 1 + self.d] - np.outer(s, s) / self.n

    def sxy(self, t: int = 0) -> np.ndarray:
        j = 1 + self.d + t
        return self.m[1 : 1 + self.d, j] - self.m[0, 1 : 1 + self.d] * self.m[0, j] / self.n

    def syy(self, t: int = 0) -> float:
        j = 1 + self.d + t
        return float(self.m[j, j] - self.m[0, j] ** 2 / self.n)

    def take(self, bands: Sequence[int]) -> "Gram":
        """Sub-block for chosen bands."""
        keep = [0, *[1 + b for b in bands], *range(1 + self.d, self.m.shape[0])]
        return Gram(self.m[np.ix_(keep, keep)], self.about[list(bands)], self.targets)


def spectra_matrix(column: pa.Array) -> np.ndarray:
    """List column of one batch as a float matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=float).reshape(len(column), -1)


PARTIAL = pa.schema([("k", pa.string()), ("q", pa.int32()), ("v", pa.list_(pa.float64()))])


def _lower(m: np.ndarray) -> np.ndarray:
    return m[np.tril_indices(len(m))]


def _square(v: np.ndarray, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.tril_indices(p)] = v
    return m + np.tril(m, -1).T


def _partial_sums(about: np.ndarray, p: int):
    """Rows to partial sums of their products. A key with few rows in a task is passed on as these rows, which are
    smaller than a matrix: ``q`` is their number, or -1 for the lower half of a matrix."""
    half = p * (p + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str | None, list[np.ndarray]] = {}
        sums: dict[str | None, np.ndarray] = {}
        count: dict[str | None, int] = {}
        held = 0

        def fold(k) -> None:
            block = np.vstack(rows.pop(k))
            part = _lower(block[:, 1:].T @ (block[:, 1:] * block[:, :1]))
            sums[k] = sums[k] + part if k in sums else part

        def emit() -> Iterator[pa.RecordBatch]:
            for k in list(rows):
                if k in sums or count[k] * p >= half:
                    fold(k)
            out = [(k, -1, v) for k, v in sums.items()] + [(k, count[k], np.vstack(b).ravel()) for k, b in rows.items()]
            for at in range(0, len(out), 256):
                k, q, v = zip(*out[at : at + 256])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(q, pa.int32()), pa.array(v, pa.list_(pa.float64()))], schema=PARTIAL)
            rows.clear()
            sums.clear()
            count.clear()

        for b in batches:
            if b.num_rows == 0:
                continue
            x = spectra_matrix(b.column("x")) - about
            w = b.column("w").to_numpy(zero_copy_only=False)
            block = np.hstack([w[:, None], np.ones((len(x), 1)), x, spectra_matrix(b.column("t"))])
            codes = b.column("k").dictionary_encode("encode")
            at = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, np.diff(at[order]) != 0)), len(at))
            names = codes.dictionary.to_pylist()
            for lo, hi in zip(edges[:-1], edges[1:]):
                k = names[at[order[lo]]]
                rows.setdefault(k, []).append(block[order[lo:hi]])
                count[k] = count.get(k, 0) + int(hi - lo)
                held += (hi - lo) * (p + 1) * 8
                if count[k] > 4 * p:
                    held -= count[k] * (p + 1) * 8 - (0 if k in sums else half * 8)
                    count[k] = 0
                    fold(k)
            if held > HELD_BYTES:
                yield from emit()
                held = 0
        yield from emit()

    return run


def _added(p: int, keep_rows: bool):
    """Partial sums sorted by key to one row per key; with ``keep_rows`` a key that has few rows stays as rows."""
    half = p * (p + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, total, n, started = None, [], None, 0, False

        def fold() -> None:
            nonlocal total, blocks, n
            block = np.vstack(blocks)
            part = _lower(block[:, 1:].T @ (block[:, 1:] * block[:, :1]))
            total = part if total is None else total + part
            blocks, n = [], 0

        def done() -> pa.RecordBatch:
            nonlocal total
            if blocks and not (keep_rows and total is None and n * (p + 1) < half):
                fold()
            q, v = (-1, total) if total is not None else (n, np.vstack(blocks).ravel())
            total = None
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([q], pa.int32()), pa.array([v], pa.list_(pa.float64()))], schema=PARTIAL)

        for b in batches:
            offsets, flat = b.column("v").offsets.to_numpy(), b.column("v").values.to_numpy(zero_copy_only=False)
            for i, (k, q) in enumerate(zip(b.column("k").to_pylist(), b.column("q").to_pylist())):
                if started and k != key:
                    yield done()
                    blocks, n = [], 0
                key, started = k, True
                v = flat[offsets[i] : offsets[i + 1]]
                if q < 0:
                    total = v.copy() if total is None else total + v
                else:
                    blocks.append(v.reshape(q, p + 1).copy())
                    n += q
                    if n > 4 * p:
                        fold()
        if started:
            yield done()

    return run


@dataclass
class GramTable:
    """MOM-2 as a table: ``k``, ``q``, ``v`` with the lower half of one matrix per key."""

    rows: DataFrame
    about: np.ndarray
    targets: int

    @property
    def p(self) -> int:
        return 1 + len(self.about) + self.targets

    def total(self) -> Gram:
        """Sum over all keys: sums of at most SALTS parts reach the driver, whatever the number of keys."""
        parts = self.rows.select(F.lit("").alias("k"), "q", "v", F.pmod(F.xxhash64("k"), F.lit(SALTS)).alias("salt"))
        held = parts.repartition("salt").select("k", "q", "v").mapInArrow(_added(self.p, False), DDL).select("v").toArrow().column("v").to_pylist()
        m = np.sum([_square(np.asarray(v), self.p) for v in held], axis=0) if held else np.zeros((self.p, self.p))
        return Gram(m, self.about, self.targets)

    def centred(self) -> DataFrame:
        """``k, i, j, v``: upper half of the centred X'X of every key."""
        about, targets, p = self.about, self.targets, self.p
        schema = pa.schema([("k", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = np.triu_indices(p - 1 - targets)
            for k, g in each_gram(batches, about, targets):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(g.sxx[a, b])], schema=schema)

        return self.rows.mapInArrow(run, "k string, i long, j long, v double")


def each_gram(batches: Iterator[pa.RecordBatch], about: np.ndarray, targets: int) -> Iterator[tuple[str | None, Gram]]:
    """(key, matrix) of the rows of a GramTable, one at a time."""
    p = 1 + len(about) + targets
    for b in batches:
        offsets, flat = b.column("v").offsets.to_numpy(), b.column("v").values.to_numpy(zero_copy_only=False)
        for i, k in enumerate(b.column("k").to_pylist()):
            yield k, Gram(_square(flat[offsets[i] : offsets[i + 1]], p), about, targets)


DDL = "k string, q int, v array<double>"


def _salted_sums(df: DataFrame, key: Column, targets: Sequence[str], weight: str | None, keep_rows: bool) -> tuple[DataFrame, np.ndarray]:
    """Partial sums of every key, added up within SALTS parts of the tasks; and the point they are taken about."""
    about = np.asarray(any_spectrum(df))
    p = 1 + len(about) + len(targets)
    usable = F.col("x").isNotNull()
    for c in targets:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    src = df.where(usable).select(
        key.cast("string").alias("k"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"),
        F.array(*[F.col(c) for c in targets]).cast("array<double>").alias("t"), F.col("x").alias("x"),
    )
    parts = src.mapInArrow(_partial_sums(about, p), DDL).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return parts.repartition("salt", "k").sortWithinPartitions("salt", "k").select("k", "q", "v").mapInArrow(_added(p, keep_rows), DDL), about


def gram_table(df: DataFrame, key: str | Column, targets: Sequence[str] = ("y",), weight: str | None = None) -> GramTable:
    """MOM-2: one Gram per value of ``key``, written as a table; rows without a spectrum or a target are left out.

    Partial sums are added in two levels: first within a key and one of SALTS parts of the tasks, then within a
    key, so that neither many tasks nor a key with most rows meet in one task at once. A task adds one matrix at a
    time. A null key has a matrix of its own.
    """
    once, about = _salted_sums(df, F.col(key) if isinstance(key, str) else key, targets, weight, True)
    p = 1 + len(about) + len(targets)
    whole = once.repartition("k").sortWithinPartitions("k").mapInArrow(_added(p, False), DDL)
    return GramTable(cut(whole), about, len(targets))


def gram(
    df: DataFrame, key: str | Column | None = None, targets: Sequence[str] = ("y",), weight: str | None = None
) -> dict[str | None, Gram]:
    """One matrix of all rows, under the key None: SALTS partial sums reach the driver. With a ``key`` the matrices of
    its values are fetched one after the other, for a look at a few; operators keep them in a ``gram_table``."""
    if key is not None:
        table = gram_table(df, key, targets, weight)
        held = ((r["k"], Gram(_square(np.asarray(r["v"]), table.p), table.about, table.targets)) for r in table.rows.toLocalIterator())
        return dict(sorted(held, key=lambda r: (r[0] is not None, r[0])))
    once, about = _salted_sums(df, F.lit(""), targets, weight, False)
    p = 1 + len(about) + len(targets)
    sums = [_square(np.asarray(v), p) for v in once.select("v").toArrow().column("v").to_pylist()]
    return {None: Gram(np.sum(sums, axis=0) if sums else np.zeros((p, p)), about, len(targets))}


def total(grams: dict) -> Gram:
    parts = list(grams.values())
    return Gram(sum(g.m for g in parts), parts[0].about, parts[0].targets)


def held_out(grams: dict) -> dict:
    """Train-side Gram of every key: total minus own."""
    whole = total(grams)
    return {k: whole - g for k, g in grams.items()}
