"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= j) = sigmoid(w.x - t_j): one set of hashed-text weights and ordered thresholds. Grades: 0 toxic, 1 of
low quality, 2 good. The weights are fitted on a bounded sample of labelled documents (``fit_rows``, those with
the smallest hash of their id); every document is scored on its whole text.

Features are the distinct words (A-Z lower-cased, no punctuation), hashed, and classes of text figures (symbols,
capitals, repetition, length). Each counts once per document. Fitting is proximal gradient descent with an L1
penalty, which leaves words without evidence at zero, so that the length of a text adds no noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, slices

BITS = 20
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))


def _slot(feature: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(feature) >> (64 - BITS)


class _Slots(dict):
    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        s = self[word] = _slot(b"w:" + word)
        return s


def _level(name: str, share: float) -> bytes:
    return f"f:{name}:{min(int(share * 25), 25)}".encode()


def features(text: bytes, slots: _Slots) -> np.ndarray:
    """Slots of the distinct features of a text."""
    words = text.translate(ALNUM).split()
    n = max(1, len(words))
    own = set(words)
    size = max(1, len(text))
    lines = text.split(b"\n")
    extra = (
        _level("symbols", (len(text) - len(text.translate(None, SYMBOLS))) / size),
        _level("capitals", (len(text) - len(text.translate(None, CAPITALS))) / size),
        _level("shouts", text.count(b"!") / n),
        _level("lines", 1 - len(set(lines)) / len(lines)),
        f"f:length:{n.bit_length()}".encode(),
        f"f:distinct:{n.bit_length()}:{10 * len(own) // n}".encode(),
    )
    return np.unique(np.fromiter((*map(slots.__getitem__, own), *map(_slot, extra)), np.int32))


@dataclass
class Model:
    """Sparse weights by slot and rising thresholds; ``slots`` is sorted."""

    slots: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    thresholds: tuple[float, ...] = ()

    def tails(self, items: np.ndarray) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..; all one for a model without labels."""
        if not self.thresholds:
            return [1.0, 1.0]
        at = np.searchsorted(self.slots, items)
        at[at == len(self.slots)] = 0
        eta = float(self.weights[at[self.slots[at] == items]].sum()) if len(self.slots) else 0.0
        return [_sigmoid(eta - t) for t in self.thresholds]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else (e := math.exp(x)) / (1 + e)


def fit(rows: list[np.ndarray], grades: np.ndarray, l1: float = 2.0, rounds: int = 300, least: int = 5, levels: int = 3) -> Model:
    """Weights and thresholds of the smallest penalised loss. Features of fewer than ``least`` rows stay out.
    Grades without rows get half a row, so thresholds are finite."""
    if not len(rows):
        return Model()
    ptr = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    slot = np.concatenate(rows)
    used, slot, n = np.unique(slot, return_inverse=True, return_counts=True)
    often = n >= least
    number = np.cumsum(often) - 1
    keep = often[slot]
    owner = np.repeat(np.arange(len(rows)), np.diff(ptr))[keep]
    slot = number[slot[keep]]
    d = int(often.sum())
    counts = np.bincount(grades, minlength=levels) + 0.5
    weight = np.sqrt(counts.sum() / (levels * counts))[grades]
    share = np.cumsum(counts[::-1])[::-1][1:] / counts.sum()
    t = -np.log(share / (1 - share))
    w, gw, gt = np.zeros(d), np.full(d, 1e-8), np.full(levels - 1, 1e-8)
    for _ in range(rounds):
        eta = np.bincount(owner, weights=w[slot], minlength=len(rows)) if d else np.zeros(len(rows))
        p = 1 / (1 + np.exp(-np.clip(eta[:, None] - t, -35, 35)))
        edge = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], 1)
        i = np.arange(len(rows))
        hi, lo = edge[i, grades], edge[i, grades + 1]
        dens = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        g_eta = -weight * (dhi - dlo) / dens
        g_t = np.zeros(levels - 1)
        for j in range(levels - 1):
            g_t[j] = (weight * (np.where(grades == j + 1, dhi, 0.0) - np.where(grades == j, dlo, 0.0)) / dens).sum()
        g = np.bincount(slot, weights=g_eta[owner], minlength=d) if d else w
        gw += g * g
        gt += g_t * g_t
        step = 0.3 / np.sqrt(gw)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        t = np.maximum.accumulate(t - 0.3 / np.sqrt(gt) * g_t)
    on = np.flatnonzero(w)
    return Model(used[often][on].astype(np.int32), w[on], tuple(float(x) for x in t))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Model:
    """A model from at most ``fit_rows`` labelled documents. Rows of labels without an id or both ratings are not
    used; a missing rating counts as fine. Of several labels of one id the lowest grade counts; of several rows of
    one id in ``docs`` the one whose text has the smallest hash."""
    toxic, good = F.coalesce(F.col("toxic").cast("int"), F.lit(0)) == 1, F.coalesce(F.col("quality").cast("int"), F.lit(1)) == 1
    rated = labels.where("doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)")
    rated = rated.select(F.col("doc_id").alias("rated_id"), F.when(toxic, 0).when(good, 2).otherwise(1).alias("grade"))
    rated = rated.groupBy("rated_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("rated_id"), "rated_id").limit(fit_rows)
    # At most ``fit_rows`` rows of two numbers.
    rows = docs.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).join(F.broadcast(rated), F.col("doc_id") == F.col("rated_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in slices(batches):
            found = [features(t or b"", slots) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grade", "rated_id", "h")), pa.array(found, pa.list_(pa.int32()))], names=["grade", "id", "h", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = rows.select("grade", F.col("rated_id").cast(kind).alias("rated_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"grade int, id {kind}, h long, items array<int>")
    got = read.groupBy("id").agg(F.min(F.struct("h", "grade", "items")).alias("one")).select("one.grade", "id", "one.items").toArrow()
    got = got.sort_by("id").combine_chunks()
    grades = got.column("grade").to_numpy().astype(np.int64)
    items = got.column("items")
    return fit([x.values.to_numpy() for x in items], grades)


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, least: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, p_fair, p_good, kept`` for every row: the expected grade (0 to 2), the two tail
    probabilities, and whether P(good) reaches ``least``.

    A null or empty text has no words. Without usable labels everything is kept with probability one. Repeated
    rows give repeated results; an empty table none. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(astuple(train(docs, labels, fit_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, model = _Slots(), Model(*held.value)
        for batch in slices(batches):
            tails = [model.tails(features(t or b"", slots)) for t in batch.column("text").to_pylist()]
            fair, good = zip(*tails) if tails else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.float64()) for x in ([a + b for a, b in tails], fair, good)), pa.array([b >= least for b in good], pa.bool_())],
                names=["doc_id", "expected_grade", "p_fair", "p_good", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, expected_grade double, p_fair double, p_good double, kept boolean")


def select(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose P(good) reaches ``least``."""
    held = docs.sparkSession.sparkContext.broadcast(astuple(train(docs, labels, fit_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, model = _Slots(), Model(*held.value)
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([model.tails(features(t or b"", slots))[1] >= least for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
