"""Paragraphs of many texts at once, keys on which documents differ, and components of long paths."""

import numpy as np

from bandwright.llm import linking, substring_dedup

TEXTS = [t.encode() for t in ("", "One. " * 40, "é w a. " + "word here, " * 30 + "End! " + " ".join(f"x{i}" for i in range(90)), "a b. c\n" * 30, "\n. ", " ".join(f"x{i}" for i in range(90)) + ". Tail")]


def test_paragraphs_of_many_texts_are_those_of_each():
    together = substring_dedup.Paragraphs(TEXTS, 25, 5, 9, 3)
    for i, text in enumerate(TEXTS):
        alone, own = substring_dedup.Paragraphs([text], 25, 5, 9, 3), together.doc == i
        assert (alone.ids == together.ids[own]).all() and (alone.keys == together.keys[own]).all()
        assert (alone.passage_ids == together.passage_ids[together.text[together.passages] == i]).all() if len(alone.passages) else True
        if own.any():
            got = np.stack(together.offsets(together.first[own], together.end[own]))
            assert (got == np.stack(alone.offsets(alone.first, alone.end))).all()
    assert len(together.ids) > 3


def test_what_copies_share_is_compared_in_place():
    body = " ".join(f"w{i}" for i in range(60)) + "."
    same = substring_dedup.Paragraphs([b"Yes. " + body.encode(), b"Yes. " + body.encode(), b"No. " + body.encode()], 25, 5, 9, 3)
    hit = np.ones(same.keys.shape, bool)
    a, b = same.links(hit, 80, 100)
    assert {(int(same.doc[x]), int(same.doc[y])) for x, y in zip(a, b)} == {(0, 0), (1, 1), (2, 2)}
    out = [{int(x) for x in p.fingerprints(np.ones(p.keys.shape, bool), np.array([1]))} for p in (substring_dedup.Paragraphs([t], 25, 5, 9, 3) for t in (b"Yes. " + body.encode(), b"Yes. " + body.encode(), b"No. " + body.encode()))]
    assert out[0] == out[1] != out[2]


def test_components_of_paths_and_loops(spark):
    path = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000), (2000, 2001), (2001, 2002), (2002, 2000)]
    got = {r.id: r.component for r in linking.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 301)} | {2000: 2000, 2001: 2000, 2002: 2000}
