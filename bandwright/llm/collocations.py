"""Phrase collocations from count streams in prefix and suffix order.

Counting. A phrase of two or three words can only be frequent if its pairs of words are. A first scan counts pairs
by hash and leaves a bitmap of those that may be frequent; a second one counts the triples both of whose pairs are
among them, and notes the words of these pairs; a third one counts the words, pairs and triples that are left as
text. Hashes only keep phrases out that cannot be frequent: a collision lets one more through to the exact counts.
Within a task words are numbers and counts come from sorted arrays.

Estimation. The counts of all orders are one stream, sorted by words from the left: each word stands before its
pairs and each pair before its triples, so one pass over the stream knows, for every phrase, the counts of its
beginnings (left counts), and, for every pair, its most frequent continuation (right extension). The same stream
sorted by words from the right gives the counts of the ends and the left extensions. Both are lockstep merges of
sorted runs without a hash table. The stream is dealt out in ranges of rows, not of words: a word whose phrases
span several ranges is sent to each of them, so no word's phrases have to be in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import LOWER, WordHashes, bitmap, in_bitmap, mix, slices, text_column
from .packed import PACKED_DDL, TOP, Held, pack as _pack, packed_rows, reaching, unpack as _unpack  # noqa: F401

# A-Z to a-z; ends of pieces become a byte that no UTF-8 text has.
BREAK = 0xFF
PIECES = bytes(BREAK if chr(c) in ".,;:!?\n\x0b\x0c\r" else LOWER[c] for c in range(256))
# Bits of a word's number in a task, so that three numbers fit 63 bits, and words that are numbered at a time: a
# task passes its counts on before it has more numbers than these bits hold.
NUMBERS, WORDS = 21, 1 << 19
# Bytes of text that are counted at a time; counts a task holds before it passes them on. A task needs about 100
# bytes for each count it holds.
CHUNK, HELD = 1 << 21, 2 << 20
# Rows of a range of the sorted stream, and keys that are drawn to place the borders, per range.
RANGE_ROWS, DRAWN = 200_000, 64


class _Numbers(dict):
    """Word to number from 1; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({b"\xff": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _language(lang: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(lang.encode())


def _pair_hashes(a: np.ndarray, b: np.ndarray, lang: int) -> np.ndarray:
    return mix(mix(a + np.uint64(lang)) + b)


def _triple_hashes(pair: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(pair + mix(c))


def _word_hashes(a: np.ndarray, lang: int) -> np.ndarray:
    return mix(a ^ np.uint64(lang))


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    for batch in slices(batches):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if text:
                texts.setdefault(lang, []).append(text)
        yield texts


def _packed_counts(parts: int, enough: int, pairs: Broadcast | None):
    """Leading bytes of hashes with counts up to ``enough``, one packed row per task, kind and part of the hash range.
    Without ``pairs``: kind 0, every pair. With it: kind 0, triples of two such pairs; kind 1, words of such pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), [Held(), Held()]
        pending: dict[str, list[bytes]] = {}
        size = 0

        def count(lang: str, texts: list[bytes]) -> None:
            words = b"\xff".join(texts).translate(PIECES).replace(b"\xff", b" \xff ").split()
            h, seed = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), _language(lang)
            inside = h != np.uint64(hashes[b"\xff"])
            at = np.flatnonzero(inside[1:] & inside[:-1])
            pair = _pair_hashes(h[at], h[at + 1], seed)
            if pairs is None:
                held[0].add(pair & TOP)
                return
            some = in_bitmap(pairs.value, pair)
            at, pair = at[some], pair[some]
            next_too = np.flatnonzero(at[1:] == at[:-1] + 1)
            held[0].add(_triple_hashes(pair[next_too], h[at[next_too] + 2]) & TOP)
            held[1].add(_word_hashes(np.append(h[at], h[at + 1]), seed) & TOP)

        def packed() -> Iterator[pa.RecordBatch]:
            for kind in range(2):
                key, n = held[kind].merge()
                # A word of a pair is wanted whatever its count in this task.
                n = np.minimum(n, enough) if kind == 0 else np.full(len(n), enough)
                yield from packed_rows(kind, key, n, parts, enough)
                held[kind] = Held()

        for texts in _by_language(batches):
            for lang, some in texts.items():
                pending.setdefault(lang, []).extend(some)
                size += sum(map(len, some))
            if size > CHUNK:
                for lang, some in pending.items():
                    count(lang, some)
                pending, size = {}, 0
                if sum(x.size() for x in held) > HELD:
                    yield from packed()
        for lang, some in pending.items():
            count(lang, some)
        yield from packed()

    return run


def _hashes(texts: DataFrame, enough: int, pairs: Broadcast | None) -> DataFrame:
    """Hashes that reach ``enough``, written. The range of hashes is cut into the session's shuffle partitions."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = texts.mapInArrow(_packed_counts(parts, enough, pairs), PACKED_DDL)
    return cut(packed.repartition(parts, "kind", "part").mapInArrow(reaching(enough), "kind int, h long"))


# The counts of a task and part of the phrases, one row per language: phrases by line ends, their words by spaces, of
# which there are always two; counts in as many bytes as the greatest needs. Neither stands in a word.
GRAMS = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("phrases", pa.binary()), ("n", pa.binary())])
# Counts that are merged into the others of a part at a time.
LOOSE = 1 << 20


class _Language:
    """Numbers of a language's words and counts of its phrases of one, two and three words, within a task."""

    def __init__(self, lang: str) -> None:
        self.lang, self.seed = lang, _language(lang)
        self.numbers = _Numbers()
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.hashed = 1
        self.held = [Held(), Held(), Held()]
        self.words = 0

    def word_hashes(self) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        if len(self.numbers) > self.hashed:
            while len(self.numbers) > len(self.hashes):
                self.hashes = np.append(self.hashes, np.zeros_like(self.hashes))
            new = islice(self.numbers, self.hashed, None)
            self.hashes[self.hashed : len(self.numbers)] = np.fromiter(map(xxh3_64_intdigest, new), np.uint64, len(self.numbers) - self.hashed)
            self.hashed = len(self.numbers)
        return self.hashes

    def count(self, texts: list[bytes], may: "tuple[np.ndarray, ...]", parts: int) -> Iterator[pa.RecordBatch]:
        words = b"\xff".join(texts).translate(PIECES).replace(b"\xff", b" \xff ").split()
        # Two words more than are counted, for the phrases that begin at the last ones.
        for at in range(0, len(words), WORDS):
            if len(self.numbers) > WORDS:
                yield from self.rows(parts)
            some = words[at : at + WORDS + 2]
            self._count(np.fromiter(map(self.numbers.__getitem__, some), np.int64, len(some)), may)

    def _count(self, w: np.ndarray, may: "tuple[np.ndarray, ...]") -> None:
        words, pairs, triples = may
        h, u = self.word_hashes()[w], w.astype(np.uint64)
        inside = w > 0
        self.words += int(inside[:WORDS].sum())
        # Which numbers are words of pairs, looked up once per number.
        wanted = in_bitmap(words, _word_hashes(self.hashes[: len(self.numbers)], self.seed))
        self.held[0].add(u[:WORDS][inside[:WORDS] & wanted[w[:WORDS]]])
        pair = np.flatnonzero(inside[1:] & inside[:-1])
        hashed = _pair_hashes(h[pair], h[pair + 1], self.seed)
        some = in_bitmap(pairs, hashed)
        pair, hashed = pair[some], hashed[some]
        next_too = np.flatnonzero(pair[1:] == pair[:-1] + 1)
        three = pair[next_too]
        three = three[in_bitmap(triples, _triple_hashes(hashed[next_too], h[three + 2]))]
        pair, three = pair[pair < WORDS], three[three < WORDS]
        shift = np.uint64(NUMBERS)
        self.held[1].add((u[pair] << shift) | u[pair + 1])
        self.held[2].add((((u[three] << shift) | u[three + 1]) << shift) | u[three + 2])

    def size(self) -> int:
        return sum(x.size() for x in self.held)

    def rows(self, parts: int) -> Iterator[pa.RecordBatch]:
        words = pa.array([b"", *list(self.numbers)[1:]], pa.binary())
        h = self.word_hashes()
        mask = np.uint64((1 << NUMBERS) - 1)
        # A phrase without words has the number of all words.
        phrases, counts, hashes = [pa.array([b"  "], pa.binary())], [np.array([self.words])], [np.zeros(1, np.uint64)]
        for order, held in enumerate(self.held):
            key, n = held.merge()
            at = [((key >> np.uint64(NUMBERS * j)) & mask).astype(np.int64) for j in range(order, -1, -1)]
            at += [np.zeros(len(key), np.int64)] * (2 - order)
            phrases.append(pc.binary_join_element_wise(*(words.take(pa.array(x)) for x in at), b" "))
            counts.append(n)
            hashes.append(mix(mix(mix(h[at[0]]) + h[at[1]]) + h[at[2]]))
        part = ((np.concatenate(hashes) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        n = np.concatenate(counts)[order]
        phrases = pa.concat_arrays(phrases).take(pa.array(order))
        edge = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        for p, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
            if hi > lo:
                some = n[lo:hi]
                row = [self.lang, p, b"\n".join(phrases.slice(lo, hi - lo).to_pylist()), some.astype(np.min_scalar_type(some.max())).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, GRAMS)], schema=GRAMS)
        self.__init__(self.lang)


def _merged(enough: int):
    """Phrases with ``enough`` occurrences of the parts that a task gets, and the numbers of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        loose: dict[str, int] = {}

        def merge(lang: str) -> None:
            held[lang] = [pa.concat_tables(held[lang]).group_by("phrase").aggregate([("n", "sum")]).rename_columns(["phrase", "n"])]
            loose[lang] = 0

        for batch in batches:
            for lang, _, phrases, n in zip(*(c.to_pylist() for c in batch.columns)):
                phrases = phrases.split(b"\n")
                n = np.frombuffer(n, f"u{len(n) // len(phrases)}").astype(np.int64)
                held.setdefault(lang, []).append(pa.table({"phrase": pa.array(phrases, pa.binary()), "n": n}))
                loose[lang] = loose.get(lang, 0) + len(n)
                if loose[lang] > LOOSE:
                    merge(lang)
        for lang in list(held):
            merge(lang)
            whole = held.pop(lang)[0]
            whole = whole.filter(pc.or_(pc.greater_equal(whole.column("n"), enough), pc.equal(whole.column("phrase"), b"  ")))
            for at in range(0, whole.num_rows, 50_000):
                some = whole.slice(at, 50_000)
                words = [x.decode().split(" ") for x in some.column("phrase").to_pylist()]
                cols = [pa.array([w[j] for w in words], pa.string()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), *cols, some.column("n").combine_chunks()], names=["lang", "w1", "w2", "w3", "n"])

    return run


def _phrase_counts(may: Broadcast, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str, _Language] = {}
        pending: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for texts in _by_language(batches):
            for lang, some in texts.items():
                pending.setdefault(lang, []).extend(some)
                size[lang] = size.get(lang, 0) + sum(map(len, some))
                if size[lang] > CHUNK:
                    yield from languages.setdefault(lang, _Language(lang)).count(pending.pop(lang), may.value, parts)
                    size[lang] = 0
                    if sum(len(x.numbers) for x in languages.values()) > WORDS or sum(x.size() for x in languages.values()) > HELD:
                        for held in languages.values():
                            yield from held.rows(parts)
        for lang, some in pending.items():
            yield from languages.setdefault(lang, _Language(lang)).count(some, may.value, parts)
        for held in languages.values():
            yield from held.rows(parts)

    return run


def phrase_counts(docs: DataFrame, enough: int) -> DataFrame:
    """``lang, w1, w2, w3, n``: the phrases of two and three words with ``enough`` occurrences and the words of such
    pairs, absent words as empty strings; a row without words holds the number of words. Written once."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_column().alias("text"))
    pairs = bitmap(_hashes(texts, enough, None), "h")
    second = _hashes(texts, enough, spark.sparkContext.broadcast(pairs))
    may = spark.sparkContext.broadcast((bitmap(second.where("kind = 1"), "h"), pairs, bitmap(second.where("kind = 0"), "h")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = texts.mapInArrow(_phrase_counts(may, parts), "lang string, part int, phrases binary, n binary")
    return cut(packed.repartition(parts, "part").mapInArrow(_merged(enough), "lang string, w1 string, w2 string, w3 string, n long"))


# ---- the stream in one order -----------------------------------------------------------

# k1, k2, k3: words in the order of the stream. near, far: counts of the parts that begin (end) the phrase with one
# and two words; ext: most frequent phrase that is one word longer. Those ending in 0 are of the order before.
ROW = "lang string, k1 string, k2 string, k3 string, n long, near0 long, far0 long, ext long"
DONE = ROW.replace("ext long", "near long, far long, ext long")
ROW_NAMES, DONE_NAMES = ([c.split()[0] for c in ddl.split(", ")] for ddl in (ROW, DONE))


def _borders(rows: DataFrame, ranges: int) -> list[tuple]:
    """Keys that cut the sorted rows into about ``ranges`` equal ranges, from a bounded draw of keys."""
    total = rows.count()
    ranges = min(ranges, -(-total // RANGE_ROWS))
    if ranges < 2:
        return []
    drawn = rows.select("lang", "k1", "k2", "k3").sample(min(1.0, DRAWN * ranges / total), seed=7).collect()
    keys = sorted(tuple(r) for r in drawn)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _placed(borders: list[tuple]):
    """Rows with the number of their range; a word or pair goes to every range that its phrases reach."""
    from bisect import bisect_left, bisect_right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            at, where, home = [], [], []
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "k1", "k2", "k3")))):
                lang, a, b, c = key
                first = bisect_right(borders, key)
                # The next string after x is x and a zero character.
                last = first if c else bisect_left(borders, (lang, a, b + "\0") if b else (lang, a + "\0"))
                for r in range(first, max(first, last) + 1):
                    at.append(i)
                    where.append(r)
                    home.append(r == first)
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(where, pa.int32()), pa.array(home, pa.bool_())], names=[*part.schema.names, "range", "home"])

    return run


def _lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the sorted stream: each phrase gets the counts of the word and the pair that stand before it,
    each pair the most frequent triple that follows it. A pair seen outside its home range gives only its ``ext``."""
    out: list[tuple] = []
    word = pair = held = None
    single = pair_count = 0

    def close() -> None:
        if held is not None:
            lang, k1, k2, n, near0, far0, ext, home = held
            out.append((lang, k1, k2, "", n if home else None, near0, far0, single, None, ext))

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays(
            [pa.array(x, pa.string() if i < 4 else pa.int64()) for i, x in enumerate(zip(*out))] if out else [pa.array([], pa.string() if i < 4 else pa.int64()) for i in range(10)],
            names=DONE_NAMES,
        )
        out.clear()
        return rows

    for batch in slices(batches, 20_000):
        for lang, k1, k2, k3, n, near0, far0, ext, where, home in zip(*(batch.column(c).to_pylist() for c in [*ROW_NAMES, "range", "home"])):
            if (where, lang, k1) != word:
                close()
                held = pair = None
                word, single = (where, lang, k1), 0
            if not k2:
                single = n
                continue
            if (k2,) != pair:
                close()
                pair, held = (k2,), (lang, k1, k2, None, None, None, None, False)
            most = max(x for x in (held[6], ext, n if k3 else 0) if x is not None) if (held[6] or ext or k3) else None
            if k3:
                held = (*held[:6], most, held[7])
                out.append((lang, k1, k2, k3, n, near0, far0, single, pair_count, None))
            else:
                # Rows of one pair: itself once, and parts of its extensions from ranges of the other order.
                if n is not None:
                    pair_count = n
                    held = (lang, k1, k2, n, near0, far0, most, home)
                else:
                    held = (*held[:6], most, held[7])
        if len(out) > 20_000:
            yield flush()
    close()
    held = None
    yield flush()


def _ordered(rows: DataFrame, ranges: int) -> DataFrame:
    placed = rows.mapInArrow(_placed(_borders(rows, ranges)), ROW + ", range int, home boolean")
    return placed.repartition("range").sortWithinPartitions("range", "lang", "k1", "k2", "k3").mapInArrow(_lockstep, DONE)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lowest-scoring cut of each phrase, in whole numbers of any size."""
    for batch in batches:
        rows = []
        for lang, k1, k2, k3, n, near0, far0, near, far, ext in zip(*(c.to_pylist() for c in batch.columns)):
            phrase = " ".join(w for w in (k3, k2, k1) if w)
            if n is None:
                rows.append((lang, phrase, None, None, None, None, ext))
                continue
            # After one word: its count and that of the rest; after two: the pair's and the last word's.
            cuts = [(near0, far), (far0, near)] if k3 else [(near0, near)]
            score, k = min((1_000_000 * n * n // (l * r), k) for k, (l, r) in enumerate(cuts))
            rows.append((lang, phrase, n, *cuts[k], score, ext))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(zip(*rows))], names=["lang", "phrase", "a", "l", "r", "score", "ext"])


def mine(docs: DataFrame, enough: int = 10, cover: int = 50, top: int = 2000, ranges: int = 4096) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two or three words of each language.

    Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line ends; words are what stands between
    spaces and tabs, phrases lie within pieces and all their occurrences count. A phrase with ``a >= enough``
    occurrences has the score floor(10^6 a^2 / (l r)) of its lowest-scoring cut, the earliest of equal ones; one
    that lies in a longer phrase with at least ``cover`` percent of its occurrences is dropped. ``n`` is the number of
    the language's words. A null language is ``und``; a null or empty text has no words; rows that repeat count as
    often as they occur. A language without frequent phrases has no rows, nor has an empty table. Only text and lang
    are read. ``ranges`` bounds the ranges that the streams are dealt out in; their size does not bound memory.
    """
    counts = phrase_counts(docs, enough)
    often = counts.where("w1 <> ''")
    none = F.lit(None).cast("long")
    forward = often.select("lang", F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.col("w3").alias("k3"), "n", none.alias("near0"), none.alias("far0"), none.alias("ext"))
    left = _ordered(forward, ranges).select(
        "lang", F.when(F.col("k3") == "", F.col("k2")).otherwise(F.col("k3")).alias("k1"), F.when(F.col("k3") == "", F.col("k1")).otherwise(F.col("k2")).alias("k2"),
        F.when(F.col("k3") == "", "").otherwise(F.col("k1")).alias("k3"), "n", F.col("near").alias("near0"), F.col("far").alias("far0"), "ext",
    )
    backward = cut(forward.where("k2 = ''").unionByName(left))
    parts = _ordered(backward, ranges).mapInArrow(_scored, "lang string, phrase string, a long, l long, r long, score long, ext long")
    # Only pairs whose phrases span ranges have more than one row here.
    whole = parts.groupBy("lang", "phrase").agg(*[F.max(c).alias(c) for c in ("a", "l", "r", "score", "ext")])
    by = (F.desc("score"), F.desc("a"), "phrase")
    alone = whole.where("ext IS NULL OR 100 * ext < %d * a" % cover)
    # The best of each of 64 parts of a language first, so that no task ranks a language's phrases.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = alone.withColumn("part", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("w1 = ''").select("lang", "n")
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
