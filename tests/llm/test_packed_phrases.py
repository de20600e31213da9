"""The third scan of the collocations leaves one row per task, language and part, whatever number of phrases it counts."""

import collections

import numpy as np
import pyarrow as pa

from bandwright.llm import collocations
from bandwright.llm.common import BITMAP_BITS

All = collections.namedtuple("All", "value")


def test_phrases_leave_a_task_packed():
    every = np.full(1 << (BITMAP_BITS - 3), 255, np.uint8)
    texts = [" ".join(f"w{(i * j) % 701}é" for j in range(900)) + ". a b c. a b" for i in range(1, 30)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr"] * 14 + ["en"], "text": texts})
    packed = list(collocations._phrase_counts(All((every,) * 3), 4)([batch]))
    assert sum(b.num_rows for b in packed) <= 2 * 4
    rows = [r for b in collocations._merged(1)(packed) for r in b.to_pylist()]
    assert len(rows) > 10_000
    want = collections.Counter()
    for i, t in enumerate(texts):
        for piece in t.split("."):
            w = piece.split()
            want["fr" if i % 2 else "en", "", "", ""] += len(w)
            for k in (1, 2, 3):
                for at in range(len(w) - k + 1):
                    want["fr" if i % 2 else "en", *w[at : at + k], *[""] * (3 - k)] += 1
    assert {(r["lang"], r["w1"], r["w2"], r["w3"]): r["n"] for r in rows} == want
