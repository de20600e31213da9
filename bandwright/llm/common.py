"""Helpers shared by the operators: byte-level words, shingle sets, Arrow maps and bounded bitmaps."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

# ASCII A-Z to a-z on UTF-8 bytes; other bytes stay, so other letters keep their case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# The same, and every ASCII byte that is neither letter nor digit becomes a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def text_column(name: str = "text") -> Column:
    """Whole text with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and any non-ASCII characters."""
    return text.translate(ALNUM).split() if text else []


# Rows of a batch that are worked on at a time, so that a task never holds the texts of a batch decoded at once.
SLICE = 1024


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, without empty ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: dict[str, pa.DataType]) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns of the given types."""
    arrow = pa.schema(list(schema.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict(fn(batch), schema=arrow)

    return df.mapInArrow(run, from_arrow_schema(arrow))


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


# ---- shingle sets ----------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), a bijection."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordHashes(dict):
    """Word to 64-bit hash, remembered for the words of a task; emptied when it holds too many."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def shingled(h: np.ndarray, k: int) -> np.ndarray:
    """One hash per window of ``k`` of the given word hashes, of which there are ``k`` or more."""
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = mix(out + h[j : len(out) + j] + np.uint64(j + 1))
    return out


def shingles(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """One 64-bit hash per window of ``k`` words; fewer words make one window, none makes none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    return shingled(np.fromiter(map(hashes.__getitem__, words), np.uint64, n), min(k, n))


# Words as stretches of an array of bytes. A word's hash is the sum of its bytes' values times powers of an odd
# number, counted from the word's start: the difference of two running sums over the whole array.
SPACE = re.compile(rb"[ \t-\r]")
IN_WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
BASE = 0x9E3779B97F4A7C15
VALUES = mix(np.arange(1, 257, dtype=np.uint64))
# Bytes of text that are hashed at a time.
PIECE = 1 << 18
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """``BASE`` to the powers 0 to n - 1 and their inverses, modulo 2**64; kept, and made longer on demand."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * PIECE)
        tables = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        _powers[:] = tables
    return _powers


def _word_places(data: bytes, in_word: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words, that is of runs of bytes of ``in_word``."""
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = in_word[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(values[b] * power[: len(b)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start]), start, end


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words between white space."""
    return _word_places(data, IN_WORD, VALUES)[:2]


def hashed_places(data: bytes, in_word: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words; white space must not be in words."""
    out, at = [], 0
    for piece in _pieces(data):
        h, start, end = _word_places(piece, in_word, values)
        out.append((h, start + at, end + at))
        at += len(piece)
    return tuple(np.concatenate(c) for c in zip(*out))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into pieces of about ``PIECE`` bytes; no word is cut."""
    at = 0
    while len(text) - at > PIECE:
        space = SPACE.search(text, at + PIECE)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def hashed_words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in groups of about ``PIECE`` bytes: hashes of all their words (between white space), in order, and
    the number of words of each text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end]) + 1
            end += 1
        if end - at == 1:
            h = np.concatenate([_word_hashes(piece)[0] for piece in _pieces(texts[at])])
            yield h, np.array([len(h)])
        else:
            h, start = _word_hashes(b" ".join(texts[at:end]))
            length = np.array([len(t) + 1 for t in texts[at:end]])
            yield h, np.diff(np.searchsorted(start, np.concatenate(([0], length.cumsum()))))
        at = end


def sets_of_words(h: np.ndarray, words: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The set of every text of a group of ``hashed_words``."""
    windows = shingled(h, k) if len(h) >= k else h
    at = 0
    for n in words.tolist():
        if n >= k:
            yield np.unique(windows[at : at + n - k + 1])
        else:
            yield shingled(h[at : at + n], n) if n else np.empty(0, np.uint64)
        at += n


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of ``k`` words of every text; fewer words are one shingle, none make none."""
    return [s for h, words in hashed_words(texts) for s in sets_of_words(h, words, k)]


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set's mixed hashes; equal sets have equal sums."""
    a = int(np.add.reduce(mix(items + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)) if len(items) else 0
    b = int(np.add.reduce(mix(items ^ np.uint64(0xD1B54A32D192ED03)), dtype=np.uint64)) if len(items) else 0
    return _signed(a), _signed(b)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# ---- bitmaps of a fixed size -----------------------------------------------------------

# Bits of a bitmap: 2**27 bits are 16 MB whatever the input. A fuller one lets more rows through to the exact
# join behind it and never loses any.
BITMAP_BITS = 27


def bitmap(df: DataFrame, key: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bits set at the leading bits of a column of 64-bit hashes. Keys are dealt out by bucket and each bucket's
    bitmap is built in one task; at most ``2**bits / 8`` bytes reach the driver."""
    slot = F.shiftrightunsigned(F.col(key), 64 - bits)
    parts = (
        df.select(slot.alias("s")).withColumn("b", F.shiftright("s", 15)).repartition("b")
        .groupBy("b").agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(32767)).alias("m"))
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.collect():
        out[row.b << 12 : (row.b + 1) << 12] = np.frombuffer(bytes(row.m), np.uint8)
    return out


def in_bitmap(held: np.ndarray, keys: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    """Whether each 64-bit key may be among those of the bitmap."""
    slots = keys.view(np.uint64) >> np.uint64(64 - bits)
    return ((held[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


# ---- joins with frequent keys ----------------------------------------------------------

# A key with more than one part in SHARE of the rows is frequent; there can be no more than SHARE such keys.
SHARE = 4096


def split_join(rows: DataFrame, table: DataFrame, key: str, total: int, share: int = SHARE) -> DataFrame:
    """Inner join of ``rows`` with a table that has each key once and, in ``n``, how many rows have it. The
    frequent keys, at most ``share`` by their definition, are broadcast; the others meet in a shuffle in which no
    key has more than one part in ``share`` of the rows. ``n`` is not returned."""
    often = F.col("n") * share > total
    hot = table.where(often).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~often).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
