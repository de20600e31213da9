"""Folds dealt by size classes, shares of random subsets, and the search for a power."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bandwright.operators import folds as Cv
from bandwright.operators import groups as G
from bandwright.operators import targets as T


def greedy(sizes, n):
    load, out = [0] * min(n, len(sizes)), []
    for s in sizes:
        f = min(range(len(load)), key=lambda k: (load[k], k))
        load[f] += s
        out.append(f)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 9), st.integers(1, 40))
def test_deal_is_the_greedy_choice(start, step, groups):
    load, got = list(start), [0] * len(start)
    for _ in range(groups):
        f = min(range(len(load)), key=lambda k: (load[k], k))
        load[f] += step
        got[f] += 1
    assert Cv._deal(start, step, groups) == got


@pytest.mark.parametrize("n, groups", [(5, 1), (4, 3), (3, 40), (7, 200)])
def test_group_folds_equal_the_greedy_loop(spark, n, groups):
    rng = np.random.default_rng(groups)
    sizes = rng.integers(1, 9, groups)
    sizes[0] = 120
    of = np.repeat(np.arange(groups), sizes)
    rng.shuffle(of)
    df = spark.createDataFrame([(i, f"g{g}") for i, g in enumerate(of)], "id long, grp string").repartition(4)
    first = {g: int(np.flatnonzero(of == g)[0]) for g in range(groups)}
    order = sorted(range(groups), key=lambda g: (-sizes[g], first[g]))
    want = dict(zip((f"g{g}" for g in order), greedy([sizes[g] for g in order], n)))
    got = {(r.grp, r.fold_id) for r in Cv.group_kfold(df, n).collect()}
    assert got == set(want.items())


def test_shares_add_up_and_have_the_right_spread():
    sizes = np.array([50, 0, 30, 400, 20, 500])
    before = np.concatenate([[0], np.cumsum(sizes)])
    shares = np.array([G.subset_share(before, k, 100, 4000, 9) for k in range(6)])
    assert (shares.sum(0) == 100).all() and (shares >= 0).all() and (shares <= sizes[:, None]).all()
    assert np.allclose(shares.mean(1), sizes / 10, atol=0.25)
    p = sizes / 1000
    assert np.allclose(shares.var(1), 100 * p * (1 - p) * 900 / 999, rtol=0.12, atol=0.05)


def test_shares_of_very_many_rows():
    before = np.array([0, 3_000_000_000, 5_000_000_000])
    a, b = (G.subset_share(before, k, 1_000_000, 2000, 1) for k in range(2))
    assert (a + b == 1_000_000).all() and abs(a.mean() - 600_000) < 60 and abs(a.std() / np.sqrt(1e6 * 0.24) - 1) < 0.06


@pytest.mark.parametrize("power", [8.0, -6.0, 0.5])
def test_lambda_outside_the_first_interval(spark, power):
    rng = np.random.default_rng(2)
    y = (1 + power * rng.normal(0, 0.02, 4000)) ** (1 / power)
    df = spark.createDataFrame([(float(v),) for v in y], "y double")
    got = T.best_lambda(df, "y", "box_cox")
    grid = np.linspace(power - 4, power + 4, 1601)
    like = [-0.5 * len(y) * np.log(np.var((y**g - 1) / g if g else np.log(y))) + (g - 1) * np.log(y).sum() for g in grid]
    assert got == pytest.approx(grid[int(np.argmax(like))], abs=0.02)
