"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, each text scanned once.

The automaton reads words, not letters: every word of the items gets a code point, a text becomes one string
with a code point per word (one code for all other words), and a match's place in that string is its place in
words. Byte offsets of the original are looked up only for texts with a hit.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import alnum_words, arrow_type, map_rows

# Bytes of item text in one automaton. Larger sets of items are scanned in blocks of about this size.
BLOCK_BYTES = 4 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Automaton:
    """Windows of ``window`` words of the items; an item of fewer words is one window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        import ahocorasick

        self.codes: dict[bytes, str] = {}
        owners: dict[str, list[str]] = {}
        for item, text in items:
            words = alnum_words(text)
            if not words:
                continue
            # Code points from 32 on, over the surrogates; 1 stands for every word that no item has.
            line = "".join(self.codes.setdefault(w, self._code(len(self.codes))) for w in words)
            for k in range(max(1, len(words) - window + 1)):
                owners.setdefault(line[k : k + window], []).append(item)
        self.machine = ahocorasick.Automaton()
        for key, who in owners.items():
            self.machine.add_word(key, (len(key), sorted(set(who))))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    @staticmethod
    def _code(n: int) -> str:
        n += 32
        return chr(n if n < 0xD800 else n + 0x800)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(first word, end word, items) of each match."""
        if self.empty or not words:
            return []
        get = self.codes.get
        line = "".join([get(w, "\x01") for w in words])
        return [(end + 1 - n, end + 1, who) for end, (n, who) in self.machine.iter(line)]


def _spans(hits: list[int]) -> list[tuple[int, int]]:
    """Union of [first, end) pairs."""
    out: list[list[int]] = []
    for a, b in sorted(zip(hits[::2], hits[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _offsets(text: bytes, spans: list[tuple[int, int]]) -> list[int]:
    """Code points [start, end) in the original text of spans of words."""
    at = [m.span() for m in WORD.finditer(text)]
    return [len(text[:x].decode("utf-8", "replace")) for a, b in spans for x in (at[a][0], at[b - 1][1])]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` for every row of ``docs``.

    ``spans`` holds code points [start, end) of the hit words in the original text, flattened. A null or empty
    text has no words and no hit; an item without words, or without id or text, has no window. Repeated rows
    give repeated results. Without items nothing is hit. Columns other than doc_id, text, item_id are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    blocks = max(1, -(-size // block_bytes))
    state = docs.select(
        F.col("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"),
        F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    texts, ints = pa.list_(pa.string()), pa.list_(pa.int32())
    between = {"doc_id": arrow_type(docs, "doc_id"), "text": pa.binary(), "hits": ints, "items": texts}
    whole = {
        "doc_id": arrow_type(docs, "doc_id"), "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "spans": ints,
    }
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        held = spark.sparkContext.broadcast([(r.item, bytes(r.text)) for r in part])
        if b < blocks - 1:
            state = cut(map_rows(state, _scanner(held, window), between))
    return map_rows(state, _scanner(held, window, True), whole)


def _scanner(held: Broadcast, window: int, last: bool = False):
    machines: list[Automaton] = []

    def scan(batch):
        if not machines:
            machines.append(Automaton(held.value, window))
        rows = []
        for text, hits, items in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "items"))):
            words = alnum_words(text)
            for a, b, who in machines[0].scan(words):
                hits += (a, b)
                items += who
            rows.append((text or b"", len(words), hits, sorted(set(items))))
        if not last:
            return {"doc_id": batch.column("doc_id"), "text": [r[0] for r in rows], "hits": [[x for s in _spans(r[2]) for x in s] for r in rows], "items": [r[3] for r in rows]}
        spans = [_spans(r[2]) for r in rows]
        hit = [sum(b - a for a, b in s) for s in spans]
        return {
            "doc_id": batch.column("doc_id"), "n_words": [r[1] for r in rows], "n_hit": hit, "n_items": [len(r[3]) for r in rows],
            "items_sha256": [hashlib.sha256(",".join(r[3]).encode()).hexdigest() for r in rows],
            "contaminated": [h > 0 for h in hit], "spans": [_offsets(r[0], s) if s else [] for r, s in zip(rows, spans)],
        }

    return scan
