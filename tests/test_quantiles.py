"""Exact quantiles by rounds of counts."""

import numpy as np
import pytest

from bandwright.operators.ordered import quantile_values, quantiles, with_quantiles

PROBS = [0.0, 0.1, 0.5, 0.77, 0.933, 1.0]


def expected(x, p):
    x = np.sort(x)
    h = (len(x) - 1) * p
    lo, hi = x[int(np.floor(h))], x[int(np.ceil(h))]
    return lo + (hi - lo) * (h - np.floor(h))


@pytest.fixture(scope="module")
def table(spark):
    """Most rows have one value; both zeros, denormals, huge values, and values that differ in the last bits only."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=1500), np.full(9000, 2.5), [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324], 1.7e9 + rng.random(1500) * 1e-4, -1 - rng.random(1500) * 1e-12])
    k = rng.integers(0, 3, len(v))
    rows = [(int(a), float(b)) for a, b in zip(k, v)] + [(7, None), (8, 3.5), (None, 1.0), (None, 2.0)]
    return spark.createDataFrame(rows, "k int, v double").repartition(5), k, v


def test_quantiles_by_group(table):
    df, k, v = table
    got = {r.k: r for r in quantiles(df, "v", PROBS, ["k"]).collect()}
    assert set(got) == {0, 1, 2, 8, None}
    for key in range(3):
        for j, p in enumerate(PROBS):
            assert got[key][f"q{j}"] == expected(v[k == key], p)
    assert [got[8][f"q{j}"] for j in range(6)] == [3.5] * 6 and got[None].q2 == 1.5


def test_quantiles_of_all_rows(table):
    df, k, v = table
    whole = np.concatenate([v, [3.5, 1.0, 2.0]])
    want = [expected(whole, p) for p in PROBS]
    assert quantile_values(df, "v", PROBS) == want
    assert [quantiles(df, "v", PROBS).first()[f"q{j}"] for j in range(6)] == want


def test_without_values(table):
    df, *_ = table
    none = df.where("k = 7")
    assert quantile_values(none, "v", [0.5]) == [None]
    assert quantiles(none, "v", [0.5], ["k"]).count() == 0 and quantiles(none, "v", [0.5]).first().q0 is None
    assert {r.q0 for r in with_quantiles(df, "v", [0.5], ["k"]).where("k = 7").collect()} == {None}


def test_whole_numbers_and_no_sort(spark, table):
    ints = spark.createDataFrame([(i % 10,) for i in range(100)], "v int")
    assert quantile_values(ints, "v", [0.25, 0.5]) == [expected(np.arange(100) % 10, 0.25), 4.5]
    plan = quantiles(table[0], "v", [0.5], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_the_package_still_travels_after_a_quantile(table):
    """Models are sent to executors with this package's modules, whatever ran before."""
    from pyspark import cloudpickle

    from bandwright.operators import fits

    quantile_values(table[0], "v", [0.5])
    assert cloudpickle.dumps(lambda g: fits.So.one_band(g))
