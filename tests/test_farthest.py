"""Max-min order by lazy bounds against the plain order."""

import numpy as np
import pytest

from bandwright.operators import select as P


def plain(ids, x, k, y=None, weight=1.0):
    to = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
    scale, span = (2 * to.max(), np.ptp(y)) if y is not None else (1.0, 1.0)
    score, out = to, []
    for step in range(min(k, len(set(ids)))):
        i = min(range(len(ids)), key=lambda j: (-score[j], ids[j]))
        out.append(ids[i])
        d = np.sqrt(((x - x[i]) ** 2).sum(1)) / scale
        if y is not None:
            d = weight * d + (1 - weight) * np.abs(y - y[i]) / span
        score = d if step == 0 else np.minimum(score, d)
        score = np.where(np.isin(ids, out), -1.0, score)
    return out


@pytest.mark.parametrize("weight", [1.0, 0.6])
def test_order_and_cells_read(spark, weight):
    """Clusters with a third of the rows in one vector: the order is exact, later points read few cells."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c * 10, 1, (60, 4)) for c in rng.normal(size=(20, 4))] + [np.ones((600, 4))])
    y, ids = rng.normal(size=len(x)), rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in r], float(t)) for i, r, t in zip(ids, x, y)], "id long, x array<double>, y double")
    read = []
    target = (y, weight) if weight < 1 else (None, 1.0)
    got = P.farthest_points(df.repartition(5), 24, y="y" if weight < 1 else None, x_weight=weight, read=read)
    assert got == plain(ids.tolist(), x, 24, *target)
    assert len(read) == 23 and len(read[0]) > 30
    assert sum(map(len, read[12:])) < sum(map(len, read[:11]))
    if weight == 1.0:
        assert sum(map(len, read[12:])) < 11 * len(read[0]) / 3


def test_few_rows_ties_and_nulls(spark):
    rows = [(4, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (3, [0.0, 0.0]), (9, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    assert P.farthest_points(df, 10) == [3, 2, 4]
    assert P.farthest_points(df.limit(0), 3) == [] and P.farthest_points(df, 1) == [3]
    names = spark.createDataFrame([("b", [1.0]), ("a", [3.0]), ("c", [9.0])], "id string, x array<double>")
    assert P.farthest_points(names, 5) == ["c", "b", "a"]
