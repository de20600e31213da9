"""Links of similar sets: ids with several texts, and lists entered by position."""

import random

import brute
import numpy as np

from bandwright.llm import jaccard_join, linking


def near(words, rng, changes=1):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def components(rows, k, num, den):
    """Smallest reachable id where an id is one node with the sets of all its texts."""
    sets = [(i, brute.shingle_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets:
        for j, b in sets:
            common = len(a & b)
            if a and b and den * common >= num * (len(a) + len(b) - common):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i, _ in sets}


def test_ids_with_several_texts_lose_no_link(spark):
    """One id on two texts, near copies of each under other ids; an id with an empty text besides; equal texts."""
    rng, rows = random.Random(3), []
    for g in range(12):
        one, two = ([f"g{g}{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "ab")
        first = 100 * g
        rows += [(first + 5, " ".join(one)), (first + 5, " ".join(two)), (first + 1, near(one, rng)), (first + 9, near(two, rng))]
        rows += [(first + 5, ""), (first + 2, near(one, rng)), (first + 2, None), (first + 30, " ".join(two)), (first + 40, "alone " * 3 + f"x{g}")]
    rng.shuffle(rows)
    want = components(rows, 4, 85, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = jaccard_join.join(docs, 4, 85, 100).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items())
    assert all(want[100 * g + i] == 100 * g + 1 for g in range(12) for i in (2, 5, 9, 30))


def test_rows_without_id_have_no_component(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.component_id or 0) for r in jaccard_join.join(docs, 4, 85, 100).collect()) == [(0, 0), (0, 0), (2, 2), (3, 2)]


def test_lists_are_entered_by_position():
    rng = np.random.default_rng(5)
    for sets, tokens, n in ((1, 1, 1), (7, 3, 12), (90, 11, 600), (300, 40, 5000)):
        pairs = np.unique(np.stack([rng.integers(0, sets, n), rng.integers(0, tokens, n)], 1), axis=0)
        lists = linking.Lists(pairs[:, 1], pairs[:, 0], tokens, sets)
        for low in {0, 1, sets // 2, sets - 1}:
            asked = np.unique(rng.integers(0, tokens, 5))
            of = pairs[np.isin(pairs[:, 1], asked)]
            read, skipped = lists.read, lists.skipped
            got = lists.counted(asked, low)
            assert (got[low:] == np.bincount(of[:, 0], minlength=sets)[low:]).all()
            assert lists.read - read == (of[:, 0] >= low).sum() and lists.skipped - skipped == (of[:, 0] < low).sum()


def test_skipping_keeps_every_link(monkeypatch):
    """Sets of many sizes with common tokens: places of small sets are skipped, the components are those of all pairs."""
    made = []

    class Seen(linking.Lists):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)

    monkeypatch.setattr(linking, "Lists", Seen)
    rng = np.random.default_rng(8)
    sets = []
    for size in range(20, 220, 4):
        base = rng.choice(2000, size, replace=False).astype(np.uint64)
        sets += [np.unique(np.concatenate((base[c:], rng.choice(2000, c).astype(np.uint64)))) for c in (0, 1, 3, size // 2)]
    found = linking.link_sets(sets, np.zeros(len(sets)), 80, 100)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in found:
        assert linking.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 80, 100)
        up[root(a)] = root(b)
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if linking.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 80, 100)]
    assert len(linked) > 80 and all(root(a) == root(b) for a, b in linked)
    # Sizes run from 20 to 220, so about a quarter of the places belongs to sets that are too small.
    assert made[0].skipped * 4 > made[0].read
