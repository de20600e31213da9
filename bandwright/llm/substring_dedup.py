"""Substring dedup by paragraph MinHash banding.

A paragraph here is a run of whole sentences of at least ``unit_words`` words; one starts at every sentence, so a
passage that repeats is found wherever it stands in a line or document. Its set is its 5-word shingles. Band
keys come from MinHash values; paragraphs that collide in a band are compared exactly (Jaccard), and clusters of
linked paragraphs are the components. The first place of a cluster is kept.

Punctuation does not decide alone: a passage is a window of ``unit_words`` words anywhere in a text, taken where its
hash is the least among ``unit_words + 2`` neighbouring windows. So every run of over 2 x ``unit_words`` words that
two documents share word for word holds a passage that both have taken, whatever the sentences and lines around it.
Passages are compared by equality, that is by id: with one word changed inside, so short a set is below the similarity.

Texts are cut many at a time. Only keys that occur in two documents matter; a first scan counts them packed. Most of
them stand for copies of one stretch of text: their paragraphs are the same in every document that has the key,
each with the paragraphs that begin a sentence before or after. Such pairs are compared inside the document, by
places alone. A second scan tells from a fingerprint of each document's paragraphs of a key where documents differ,
and only the paragraphs of those keys are moved and compared by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import linking
from .common import ALNUM, LOWER, PIECE, VALUES, bitmap, hashed_places, in_bitmap, mix, shingled, slices
from .packed import KEY, PACKED_DDL, TOP, Held, packed_rows, reaching

# Bytes of words, their values for hashing (lower-cased), and the ends of sentences and lines.
IN_WORD = np.array([c != 32 for c in ALNUM])
LOWERED = VALUES[np.frombuffer(LOWER, np.uint8)]
ENDS = np.array([c in b".!?\n" for c in range(256)])
# Bits of a sieve for each key, and the most of all, by their logarithm: 128 MB. A fuller one lets more rows through.
KEY_BITS, MOST_BITS = 16, 30
# Paragraphs of a document under one key that are compared in place.
IN_PLACE = 4
# Keys with fingerprints that a task holds before it passes them on.
HELD = 1 << 20
# Bytes of a shingle's hash that are moved.
ITEM = 6


# Paragraph ids that a task remembers having sent.
SEEN = 1_000_000


def tune(similarity: float, recall: float, rows: int = 3) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` values whose collision chance at ``similarity`` reaches ``recall``.
    With three rows, paragraphs that overlap by half seldom collide; a fourth would ask for a third more keys."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands, rows


def _reach(x: np.ndarray, width: int, take) -> np.ndarray:
    """The least or greatest (``take``) of each ``width`` neighbouring values."""
    n = 1
    while n < width:
        step = min(n, width - n)
        x = take(x[:-step], x[step:])
        n += step
    return x


def chosen(values: np.ndarray, width: int) -> np.ndarray:
    """Places of which every ``width`` neighbouring ones hold one with their least value; of equal values few."""
    if len(values) < width:
        return np.empty(0, np.int64)
    low = _reach(values, width, np.minimum)
    pad = np.zeros(width - 1, values.dtype)
    at = np.flatnonzero(values == _reach(np.concatenate([pad, low, pad]), width, np.maximum))
    if not (values[at[1:]] == values[at[:-1]]).any():
        return at
    own, out, last = values.tolist(), [], -1
    for j, v in enumerate(low.tolist()):
        if last < j or own[last] != v:
            last = next(q for q in range(j + width - 1, j - 1, -1) if own[q] == v)
            out.append(last)
    return np.array(out, np.int64)


class Paragraphs:
    """The paragraphs of some texts, in order: the text's number, first word and end, id and band keys; and passages
    likewise. Words and shingles are numbered through all the texts."""

    def __init__(self, texts: list[bytes], unit_words: int, k: int, bands: int, rows: int) -> None:
        # A line end between texts, so that no word or sentence spans two.
        data = b"\n".join(texts)
        self.k, self.data = k, data
        hashes, self.start, self.stop = hashed_places(data, IN_WORD, LOWERED)
        self.text_at = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        n = len(hashes)
        self.text = np.searchsorted(self.text_at, self.start, "right") - 1
        sentence = np.searchsorted(np.flatnonzero(ENDS[np.frombuffer(data, np.uint8)]), self.start)
        first = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1])) if n else np.empty(0, np.int64)
        ends = np.append(first[1:], n)
        at = np.searchsorted(ends, first + unit_words)
        fit = at < len(first)
        first, end = first[fit], ends[at[fit]]
        same = self.text[first] == self.text[end - 1] if len(first) else np.empty(0, bool)
        self.first, self.end = first[same], end[same]
        self.doc = self.text[self.first]
        self.items = shingled(hashes, k) if n >= k else np.empty(0, np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.items), dtype=np.uint64)))
        self.ids = mix(sums[self.end - k + 1] - sums[self.first] + (self.end - self.first).astype(np.uint64)) if len(self.first) else np.empty(0, np.uint64)
        self.keys = self._keys(bands, rows)
        if bands:
            self._passages(sums, n, unit_words)

    def _keys(self, bands: int, rows: int) -> np.ndarray:
        if not len(self.first) or not bands:
            return np.empty((len(self.first), bands), np.uint64)
        # Ranges of shingles; every second result of reduceat is one range.
        cuts = np.stack([self.first, self.end - self.k + 1], 1).ravel()
        top = np.append(self.items, np.uint64(2**64 - 1))
        keys = []
        for b in range(bands):
            key = np.full(len(self.first), b + 1, np.uint64)
            for r in range(rows):
                seed = np.uint64((0x9E3779B97F4A7C15 * (b * rows + r + 1)) % 2**64)
                key = mix(key + np.minimum.reduceat(mix(top ^ seed), cuts)[::2])
            keys.append(key)
        return np.stack(keys, 1)

    def _passages(self, sums: np.ndarray, words: int, unit_words: int) -> None:
        """First words, ids and keys of the passages. Ids are those of paragraphs of the same words."""
        n, width = unit_words - self.k + 1, unit_words + 2
        span = width + unit_words - 1
        at = np.empty(0, np.int64)
        ids = mix(sums[n:] - sums[:-n] + np.uint64(unit_words)) if words >= unit_words else np.empty(0, np.uint64)
        if words >= span:
            low = _reach(ids, width, np.minimum)
            # Neighbours of one text only.
            low[self.text[: words - span + 1] != self.text[span - 1 :]] = 0
            pad = np.zeros(width - 1, np.uint64)
            at = np.flatnonzero(ids == _reach(np.concatenate([pad, low, pad]), width, np.maximum))
            tied = (ids[at[1:]] == ids[at[:-1]]) & (self.text[at[1:]] == self.text[at[:-1]])
            for t in np.unique(self.text[at[1:][tied]]).tolist():
                lo, hi = np.searchsorted(self.text, (t, t + 1)).tolist()
                own = chosen(ids[lo : hi - unit_words + 1], width) + lo
                at = np.sort(np.concatenate((at[self.text[at] != t], own)))
        self.passages, self.passage_ids = at, ids[at]
        self.passage_keys = mix(self.passage_ids ^ np.uint64(0xD1B54A32D192ED03))

    def offsets(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points, in their text, of the first word's start and the last word's end."""
        lead = np.concatenate(([0], np.cumsum((np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80)))
        zero = lead[self.text_at[self.text[first]]]
        return lead[self.start[first]] - zero, lead[self.stop[end - 1]] - zero

    def item_set(self, i: int) -> np.ndarray:
        return np.unique(self.items[self.first[i] : self.end[i] - self.k + 1] >> np.uint64(64 - 8 * ITEM))

    def plain(self) -> np.ndarray:
        """Paragraphs whose shingles stand nowhere else in their text, so that what two of them share are places."""
        if not len(self.items):
            return np.ones(len(self.first), bool)
        own = mix(self.items + self.text[: len(self.items)].astype(np.uint64))
        _, at, n = np.unique(own, return_inverse=True, return_counts=True)
        more = np.concatenate(([0], np.cumsum(n[at] > 1)))
        return more[self.end - self.k + 1] == more[self.first]

    def lists(self, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the keys marked in ``hit``: one row per text, key and id, in order of text and key; the number of its list,
        key and paragraph, and per list whether its paragraphs can be compared in place."""
        who, band = np.nonzero(hit)
        key, ids = self.keys[who, band], self.ids[who]
        order = np.lexsort((ids, key, self.doc[who]))
        who, key, ids = who[order], key[order], ids[order]
        doc = self.doc[who]
        new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.empty(0, bool)
        keep = new | np.append(True, ids[1:] != ids[:-1]) if len(key) else new
        who, key, number = who[keep], key[keep], np.cumsum(new)[keep] - 1
        size = np.bincount(number)
        odd = np.bincount(number, ~self.plain()[who]) if len(who) else size
        return number, key, who, (size == 1) | (size <= IN_PLACE) & (odd == 0)

    def fingerprints(self, hit: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
        """Leading bytes of each key, and in the other three a sum over its paragraphs in the text."""
        number, key, who, plain = self.lists(hit)
        if not len(who):
            return np.empty(0, np.uint64)
        at = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        total = np.add.reduceat(mix(self.ids[who]), at)
        # What cannot be compared in place is told apart by the document.
        total = np.where(plain, total, mix(total + mix(doc_ids[self.doc[who[at]]].view(np.uint64))))
        return (key[at] & TOP) | (mix(total) >> np.uint64(8 * KEY))

    def links(self, hit: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Paragraphs of one text and key that are similar, where they can be compared in place."""
        number, _, who, plain = self.lists(hit)
        out = [np.empty((0, 2), np.int64)]
        for d in range(1, IN_PLACE):
            i = np.flatnonzero((number[d:] == number[:-d]) & plain[number[d:]]) if len(number) > d else np.empty(0, np.int64)
            a, b = who[i], who[i + d]
            common = np.maximum(np.minimum(self.end[a], self.end[b]) - np.maximum(self.first[a], self.first[b]) - self.k + 1, 0)
            both = self.end[a] - self.first[a] + self.end[b] - self.first[b] - 2 * (self.k - 1)
            similar = den * common >= num * (both - common)
            out.append(np.stack([a[similar], b[similar]], 1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pairs[:, 0], pairs[:, 1]


def _sieve(df: DataFrame, key: str) -> tuple[np.ndarray, int]:
    """A bitmap with two bits for each hash, by its leading bits and by others of the 40 that are counted."""
    bits = min(MOST_BITS, max(16, (KEY_BITS * df.count()).bit_length()))
    return bitmap(df.select(key).union(df.select(F.shiftleft(key, 13))), key, bits), bits


def _passed(sieve: tuple[np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    keys = keys.view(np.uint64)
    return in_bitmap(sieve[0], keys, sieve[1]) & in_bitmap(sieve[0], keys << np.uint64(13), sieve[1])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts, about ``PIECE`` bytes at a time."""
    for batch in slices(batches):
        ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), [t or b"" for t in batch.column("text").to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= PIECE:
                size += len(texts[end])
                end += 1
            yield ids[at:end], texts[at:end]
            at = end


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that come with two fingerprints or more."""
    parts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, data in zip(*(c.to_pylist() for c in batch.columns)):
            parts.setdefault(part, []).append(np.frombuffer(data, np.uint64))
    for part in list(parts):
        key = np.unique(np.concatenate(parts.pop(part))) & TOP
        key = np.unique(key[1:][key[1:] == key[:-1]]).view(np.int64)
        for i in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_pydict({"h": key[i : i + (1 << 16)]})


def _decode(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // ITEM, 8), np.uint8)
    out[:, :ITEM] = np.frombuffer(data, np.uint8).reshape(-1, ITEM)
    return out.view("<u8").ravel().astype(np.uint64)


def _encode(items: np.ndarray) -> bytes:
    return items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ITEM].tobytes()


def spans(docs: DataFrame, unit_words: int = 25, k: int = 5, num: int = 80, den: int = 100, recall: float = 0.998) -> DataFrame:
    """``doc_id, start, end, cluster_id, kept``: every paragraph or passage whose cluster has places in two documents or more.

    Places are code points [start, end) of the text. One place of each cluster, the first by doc_id and start,
    is kept; the others are to be removed. Paragraphs need ``unit_words`` words, so shorter texts, and null or
    empty ones, have none. A sentence that is longer is one paragraph; passages lie in it as in any other text. Rows that repeat a doc_id are one
    document; rows without one are not read. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    bands, rows = tune(num / den, recall)
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for _, group in _groups(batches):
            p = Paragraphs(group, unit_words, k, bands, rows)
            key = np.concatenate((p.keys.ravel(), p.passage_keys)) & TOP
            # Once per document: its number takes the place of the bytes that are not counted.
            doc = np.concatenate((np.repeat(p.doc, bands), p.text[p.passages])).astype(np.uint64)
            once = np.unique(key | doc) & TOP
            held.add(once)
            if held.size() > HELD:
                key, n = held.merge()
                yield from packed_rows(0, key, np.minimum(n, 2), shuffles, 2)
                held = Held()
        key, n = held.merge()
        yield from packed_rows(0, key, np.minimum(n, 2), shuffles, 2)

    shared = cut(texts.mapInArrow(keyed, PACKED_DDL).repartition(shuffles, "part").mapInArrow(reaching(2), "kind int, h long").select("h"))
    twice = spark.sparkContext.broadcast(_sieve(shared, "h"))

    def hits(p: Paragraphs) -> np.ndarray:
        return _passed(twice.value, p.keys.ravel()).reshape(p.keys.shape)

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            all_ = np.unique(np.concatenate(held)) if held else np.empty(0, np.uint64)
            held.clear()
            edge = np.searchsorted(all_ >> np.uint64(32), (np.arange(shuffles + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(shuffles))
            for part, (lo, hi) in enumerate(zip(edge[:-1], edge[1:])):
                if hi > lo:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": pa.array([all_[lo:hi].tobytes()], pa.binary())})

        for ids, group in _groups(batches):
            p = Paragraphs(group, unit_words, k, bands, rows)
            held.append(p.fingerprints(hits(p), ids))
            size += len(held[-1])
            if size > HELD:
                yield from packed()
                size = 0
        yield from packed()

    differing = cut(texts.mapInArrow(fingerprinted, "part int, data binary").repartition(shuffles, "part").mapInArrow(_differing, "h long"))
    apart = spark.sparkContext.broadcast(_sieve(differing, "h"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for docs_, group in _groups(batches):
            p = Paragraphs(group, unit_words, k, bands, rows)
            held = hits(p)
            hit = np.flatnonzero(held.any(1))
            more = np.flatnonzero(_passed(twice.value, p.passage_keys))
            # A passage that is a paragraph too is one place.
            more = more[~np.isin(p.passages[more], p.first[hit][p.end[hit] - p.first[hit] == unit_words])]
            if not len(hit) + len(more):
                continue
            first = np.concatenate((p.first[hit], p.passages[more]))
            end = np.concatenate((p.end[hit], p.passages[more] + unit_words))
            ids = np.concatenate((p.ids[hit], p.passage_ids[more])).view(np.int64)
            doc = docs_[p.text[first]]
            # Keys, size and links once per id in a task.
            own = _passed(apart.value, p.keys[hit].ravel()).reshape(-1, bands) & held[hit]
            keys: list = [None] * len(first)
            n: list = [None] * len(first)
            for i in np.flatnonzero(own.any(1)).tolist():
                if (who := int(ids[i])) not in seen:
                    seen.add(who)
                    keys[i], n[i] = p.keys[hit[i]][own[i]].view(np.int64), len(p.item_set(hit[i]))
            links: dict[int, list[int]] = {}
            a, b = p.links(held, num, den)
            for x, y in zip(np.searchsorted(hit, a).tolist(), p.ids[b].view(np.int64).tolist()):
                if (pair := (int(ids[x]), y)) not in seen:
                    seen.add(pair)
                    links.setdefault(x, []).append(y)
            if len(seen) > SEEN:
                seen.clear()
            pick = mix(ids.view(np.uint64) + mix(doc.view(np.uint64))).view(np.int64)
            picks = [int(x) if m is not None else None for x, m in zip(pick, n)]
            others = [links.get(i) for i in range(len(first))]
            long_lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (doc, *p.offsets(first, end), ids, n, picks)), pa.array(keys, long_lists), pa.array(others, long_lists)],
                names=["doc_id", "start", "end", "id", "n", "pick", "keys", "linked"],
            )

    places = cut(texts.mapInArrow(found, "doc_id long, start long, end long, id long, n long, pick long, keys array<long>, linked array<long>"))
    # One row per id.
    named = places.where("n IS NOT NULL").select("id", "n", "keys")
    keys = cut(named.select("id", "n", F.explode("keys").alias("key")).distinct().select("key", "id", "n", F.lit(0).cast("long").alias("pos")))

    def sets_of(ids: DataFrame) -> DataFrame:
        """Shingles of the wanted paragraphs, by a scan of the texts, each from one document that has it."""
        picked = cut(places.where("n IS NOT NULL").join(ids.distinct(), "id", "left_semi").groupBy("id").agg(F.min("pick").alias("pick")))
        wanted = spark.sparkContext.broadcast(_sieve(picked, "pick"))

        def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for docs_, group in _groups(batches):
                p = Paragraphs(group, unit_words, k, 0, 0)
                at = np.flatnonzero(_passed(wanted.value, mix(p.ids + mix(docs_[p.doc].view(np.uint64))))) if len(p.ids) else np.empty(0, np.int64)
                got, at = np.unique(p.ids[at], return_index=True)[0], at[np.unique(p.ids[at], return_index=True)[1]]
                held = [_encode(p.item_set(i)) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(held, pa.binary())], names=["id", "items"])

        return texts.mapInArrow(items, "id long, items binary")

    edges = linking.links(keys, sets_of, _decode, num, den)
    inside = places.where("linked IS NOT NULL").select(F.col("id").alias("a"), F.explode("linked").alias("b"))
    groups = linking.components(edges.union(inside).distinct()).withColumnRenamed("id", "node")
    rows_ = places.select("doc_id", "start", "end", "id").join(groups, F.col("id") == F.col("node"), "left")
    rows_ = cut(rows_.select("doc_id", "start", "end", F.coalesce("component", "id").alias("cluster_id")))
    firsts = rows_.groupBy("cluster_id").agg(F.min(F.struct("doc_id", "start", "end")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id <> last").drop("last")
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start"))
    return rows_.join(firsts, "cluster_id").select("doc_id", "start", "end", "cluster_id", kept.alias("kept"))
