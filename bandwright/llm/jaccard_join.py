"""Exact n-gram Jaccard join with set relations.

A document is the set of its word shingles. Copies (equal sets) are one set. Take the first tokens of each set in a
common order of all tokens: as a similar set lacks at most p - 1 of a set's tokens, two similar sets share one of
their first p tokens, and p + 1 (p of the smaller) of their first 2p. So a set is left out at once unless that many
of its first 2p tokens occur in other sets; a count of those tokens over all sets tells. The order puts rare tokens first, from
counts over all documents, so frequent passages (tokens frequent in some task) hardly ever count, nor do windows of
common words, more and more of which recur by chance as the table grows; any order gives
the same links. Rows are dropped by a bitmap of fixed size before they are moved, and exactly after it: sets by a
count of the tokens of those that passed, keys in ``linking``.
``linking`` compares the sets that are left, by keys among their first p tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import linking
from .common import LOWER, bitmap, fingerprint, hashed_words, in_bitmap, sets_of_words, shingle_sets, shingled, slices
from .packed import CHUNK_KEYS, CHUNK_ROWS, LOOSE, OWNED_DDL, PACKED_DDL, TOP, Held, enough_repeated, owned_rows, packed_rows, reaching, repeated

# Tokens seen this often in one chunk of a task are counted; the most frequent are kept for the order.
CHUNK, LOCAL_LEAST, ORDERED = 1 << 21, 4, 1 << 19
# Words are counted by so many leading bits of their hash, in so many parts.
WORD_BITS, WORD_PARTS = 21, 16


def _texts(column: pa.Array) -> list[bytes]:
    """Lower-cased texts; null is empty."""
    return [(t or b"").translate(LOWER) for t in column.to_pylist()]


def _bytes(docs: DataFrame) -> DataFrame:
    """Id, text, and a hash of both: rows of one id with different texts are told apart by it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", "text"))


class Order(NamedTuple):
    """The common order of all tokens: those of ``often`` (sorted) last, by ``rank``; the others by the level of their
    rarest word, then by hash."""

    often: np.ndarray
    rank: np.ndarray
    level: np.ndarray


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _leveled(level: np.ndarray, k: int) -> np.ndarray:
    """Level of each window of ``k`` words: that of its rarest word, as a window occurs no more often than any of them."""
    out = level[: len(level) - k + 1]
    for j in range(1, k):
        out = np.minimum(out, level[j : len(out) + j])
    return out


def common_order(docs: DataFrame, k: int) -> Order:
    """Frequent shingles by their count, and levels of words: two for each power of two of a word's count. Words are
    counted by the leading bits of their hash; what a task counts leaves it packed."""
    size = (1 << WORD_BITS) // WORD_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, words, loose = [], 0, np.zeros(1 << WORD_BITS, np.int64), [np.empty(0, np.uint64)]

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= LOCAL_LEAST
            none = int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep].astype(np.int64)), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=["h", "c", "part", "words"])

        for batch in slices(batches):
            for h, count in hashed_words(_texts(batch.column("text"))):
                loose.append(h)
                if sum(map(len, loose)) >= LOOSE:
                    words += np.bincount(_slots(np.concatenate(loose)), minlength=len(words))
                    loose = loose[:1]
                for own in sets_of_words(h, count, k):
                    held.append(own)
                    n += len(own)
                    if n >= CHUNK:
                        yield counted()
                        held, n = [], 0
        if held:
            yield counted()
        words += np.bincount(_slots(np.concatenate(loose)), minlength=len(words))
        packed = [(None, None, i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(words.reshape(WORD_PARTS, size)) if part.any()]
        if packed:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*packed), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))), names=["h", "c", "part", "words"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, words in zip(*(c.to_pylist() for c in batch.columns)):
                total[part] = total.get(part, 0) + np.frombuffer(zlib.decompress(words), np.int64)
        for part, n in total.items():
            level = (2 * np.log2(n + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "level"])

    rows = cut(_bytes(docs).mapInArrow(run, "h long, c long, part int, words binary"))
    top = rows.where("part IS NULL").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(ORDERED).toArrow()
    level = np.zeros((WORD_PARTS, size), np.uint8)
    for row in rows.where("part IS NOT NULL").select("part", "words").repartition(WORD_PARTS, "part").mapInArrow(added, "part int, level binary").collect():
        level[row.part] = np.frombuffer(bytes(row.level), np.uint8)
    h = top.column("h").to_numpy().view(np.uint64)
    rank = np.arange(len(h), 0, -1)
    order = np.argsort(h)
    return Order(h[order], rank[order], level.ravel())


def needed(n: int, num: int, den: int) -> int:
    """p: one more than the tokens that a similar set may lack."""
    return n + (-num * n // den) + 1 if n else 0


def least(n: int, num: int, den: int) -> int:
    """How many of the first 2p tokens any similar set shares, within its own first 2p: 2p (or all) less p plus
    one, for the smallest size that can be similar."""
    m = -(-num * n // den)
    p = needed(m, num, den)
    return min(2 * p, m) - p + 1


def prefix(items: np.ndarray, level: np.ndarray, common: Order, length: int) -> np.ndarray:
    """The first tokens of a sorted set in the common order."""
    rare = np.ones(len(items), bool)
    if len(items) and len(common.often):
        at = np.minimum(np.searchsorted(common.often, items), len(common.often) - 1)
        rare = common.often[at] != items
    first = items[rare][np.argsort(level[rare], kind="stable")[:length]]
    if len(first) == length or rare.all():
        return first
    rest = items[~rare][np.argsort(common.rank[at[~rare]], kind="stable")]
    return np.concatenate([first, rest[: length - len(first)]])


def _ordered_sets(texts: list[bytes], k: int, word_level: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of ``shingle_sets``, and the level of each token."""
    for h, words in hashed_words(texts):
        of = word_level[_slots(h)]
        windows, least_of = (shingled(h, k), _leveled(of, k)) if len(h) >= k else (h, of)
        at = 0
        for n in words.tolist():
            if n >= k:
                own, level = windows[at : at + n - k + 1], least_of[at : at + n - k + 1]
            else:
                own, level = (shingled(h[at : at + n], n), of[at : at + n].min(keepdims=True)) if n else (h[:0], of[:0])
            order = np.argsort(own)
            own = own[order]
            once = np.append(True, own[1:] != own[:-1])[: len(own)]
            yield own[once], level[order[once]]
            at += n


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, row, n, f1, f2, keys``: size, fingerprint and first tokens of every row."""
    common = docs.sparkSession.sparkContext.broadcast(tuple(common_order(docs, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*common.value)
        for batch in slices(batches):
            n, f1, f2, keys = [], [], [], []
            for s, level in _ordered_sets(_texts(batch.column("text")), k, order.level):
                n.append(len(s))
                for f, x in zip((f1, f2), fingerprint(s)):
                    f.append(x)
                keys.append(prefix(s, level, order, 2 * needed(len(s), num, den)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), *(pa.array(c, pa.int64()) for c in (n, f1, f2)), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n", "f1", "f2", "keys"],
            )

    return cut(_bytes(docs).mapInArrow(run, "doc_id long, row long, n long, f1 long, f2 long, keys array<long>"))


def _twice(sets: DataFrame) -> DataFrame:
    """``h``: leading bytes of the keys that occur twice or more. A task sends its keys packed, by part of their range."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in slices(batches):
            held.add(batch.column("keys").flatten().to_numpy(zero_copy_only=False).view(np.uint64) & TOP)
            if held.size() > CHUNK:
                key, n = held.merge()
                yield from packed_rows(0, key, np.minimum(n, 2), parts, 2)
                held = Held()
        key, n = held.merge()
        yield from packed_rows(0, key, np.minimum(n, 2), parts, 2)

    packed = sets.select("keys").mapInArrow(run, PACKED_DDL)
    return cut(packed.repartition(parts, "part").mapInArrow(reaching(2), "kind int, h long")).select("h")


class _Keys:
    """Of a batch of sets: those that ``first`` names and that have enough shared ones among their first 2p tokens, as
    far as the bitmap ``twice`` tells. ``flat, owner, pos``: all their keys, with the set and the place in it."""

    def __init__(self, batch: pa.RecordBatch, twice: np.ndarray, first: np.ndarray, num: int, den: int):
        batch = self._of(batch.take(pa.array(np.flatnonzero(in_bitmap(first, batch.column("row").to_numpy(zero_copy_only=False))))), twice)
        need = np.array([max(1, least(x, num, den)) for x in batch.column("n").to_pylist()], np.int64)
        enough = np.flatnonzero(np.bincount(self.owner[self.hit], minlength=batch.num_rows) >= need)
        self.rows = self._of(batch.take(pa.array(enough)), twice) if len(enough) < batch.num_rows else batch
        self.need = need[enough]

    def _of(self, batch: pa.RecordBatch, twice: np.ndarray) -> pa.RecordBatch:
        keys = batch.column("keys")
        self.flat = keys.flatten().to_numpy(zero_copy_only=False)
        length = keys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = np.repeat(np.arange(batch.num_rows), length)
        self.pos = np.arange(len(self.flat)) - (length.cumsum() - length)[self.owner]
        self.hit = in_bitmap(twice, self.flat) if len(self.flat) else np.empty(0, bool)
        return batch


def _enough(rows: DataFrame, held: Broadcast, num: int, den: int) -> DataFrame:
    """``row`` of the sets that have enough shared ones among their first 2p tokens, by the count of each token in all
    sets that the bitmaps let through. Similar sets both pass, so what they share is counted twice. The bitmaps fill
    up as the table grows; this count does not."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows are read from a written table, so a task that runs again gives the same chunks.
        chunk, kept, n, size = TaskContext.get().partitionId() << 32, [], 0, 0

        def packed() -> pa.RecordBatch:
            return owned_rows(chunk, *map(np.concatenate, zip(*kept)), parts)

        for batch in slices(batches):
            own = _Keys(batch, *held.value, num, den)
            if kept and (n + own.rows.num_rows > CHUNK_ROWS or size + len(own.flat) > CHUNK_KEYS):
                yield packed()
                chunk, kept, n, size = chunk + 1, [], 0, 0
            if own.rows.num_rows:
                kept.append((own.flat[own.hit].view(np.uint64), own.owner[own.hit] + n, own.rows.column("row").to_numpy(zero_copy_only=False), own.need))
                n += own.rows.num_rows
                size += len(kept[-1][0])
        if kept:
            yield packed()

    owners = rows.mapInArrow(run, OWNED_DDL).repartition(parts, "part").mapInArrow(repeated, OWNED_DDL)
    return owners.repartition(parts, "chunk").mapInArrow(enough_repeated, "row long")


def _shared_keys(sets: DataFrame, firsts: DataFrame, num: int, den: int) -> DataFrame:
    """``key, id, doc, n, pos``: those of the first p tokens that occur twice or more, of sets with enough shared
    ones among their first 2p. Equal sets are one: ``firsts`` names the row with their smallest doc_id, and only these
    rows give keys (a few others may pass the bitmap: they are sets like any other). ``id`` is the hash of the row."""
    sc = sets.sparkSession.sparkContext
    rows = sets.where("doc_id IS NOT NULL").select("row", "doc_id", "n", "keys")
    twice = bitmap(_twice(sets), "h")
    held = sc.broadcast((twice, bitmap(_enough(rows, sc.broadcast((twice, bitmap(firsts, "row"))), num, den), "row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = _Keys(batch, *held.value, num, den)
            p = np.array([needed(x, num, den) for x in own.rows.column("n").to_pylist()], np.int64)
            take = np.flatnonzero(own.hit & (own.pos < p[own.owner]))
            of = pa.array(own.owner[take])
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.flat[take], pa.int64()), *(own.rows.column(c).take(of) for c in ("row", "doc_id", "n")), pa.array(own.pos[take], pa.int64())],
                names=["key", "id", "doc", "n", "pos"],
            )

    keys = rows.mapInArrow(run, "key long, id long, doc long, n long, pos long")
    # Rows that repeat id and text would count as two sets.
    again = not rows.groupBy("row").count().where("count > 1").isEmpty()
    return cut(keys.dropDuplicates(["key", "id"]) if again else keys)


def _items(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, items`` of the wanted rows, and of a few others: texts stay where they are, a bitmap of the ids
    picks the rows. Items are the compressed words, smaller than their hashes."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = batch.take(pa.array(np.flatnonzero(in_bitmap(held.value, batch.column("row").to_numpy(zero_copy_only=False)))))
            items = [zlib.compress(t) for t in _texts(own.column("text"))]
            yield pa.RecordBatch.from_arrays([own.column("row"), pa.array(items, pa.binary())], names=["id", "items"])

    return _bytes(docs).where("doc_id IS NOT NULL").mapInArrow(run, "id long, items binary")


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: set size and smallest doc_id reachable by links
    (Jaccard similarity of at least ``num / den``).

    Words are runs without white space, A-Z lower-cased. Fewer than ``k`` words are one shingle. A null or empty
    text has an empty set and links with nothing. Rows that repeat a doc_id are one node of the graph, which all
    their texts link; rows without one have no component. Equal texts link by their equal sets. Columns other than
    doc_id and text are not read.
    """
    sets = _sets(docs, k, num, den)
    # Equal sets: the row with the smallest doc_id of each, and how many there are.
    equal = cut(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "row")).alias("of"), F.count("*").alias("c")))
    keys = _shared_keys(sets, equal.select("of.row"), num, den)
    found = linking.links(keys.drop("doc"), lambda ids: _items(docs, ids), lambda b: shingle_sets([zlib.decompress(b)], k)[0], num, den)
    # Copies: the smallest id of each set, then the component of that id.
    least = equal.where("c > 1").select("f1", "f2", F.col("of.doc_id").alias("least"))
    known = sets.select("doc_id", "n", "f1", "f2").join(least, ["f1", "f2"], "left")
    known = known.withColumn("least", F.when(F.expr("n > 0 AND doc_id IS NOT NULL"), F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")))
    groups = linking.components(_by_document(found, keys).union(_of_repeated_ids(sets, known)))
    out = known.join(groups, known.least == groups.id, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "least", "doc_id").alias("component_id"))


def _by_document(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges between sets as edges between their smallest doc_ids."""
    doc = cut(keys.select("id", "doc").distinct())
    for end in ("a", "b"):
        edges = edges.join(doc.select(F.col("id").alias(end), F.col("doc").alias(f"{end}_doc")), end)
    return edges.select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))


def _of_repeated_ids(sets: DataFrame, known: DataFrame) -> DataFrame:
    """Edges from ids that have several sets to the smallest doc_id of each."""
    f = F.struct("f1", "f2")
    several = sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(f).alias("lo"), F.max(f).alias("hi")).where("lo <> hi").select("doc_id")
    return known.join(several, "doc_id", "left_semi").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
