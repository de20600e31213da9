"""Counts of 64-bit hashes that leave a task as one packed row per part of the hash range.

Keys are cut to their leading bytes, so a count is that of all hashes with these bytes: it is never too small. What
is packed needs five bytes for a key seen once in a task, and one more for its count otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

# Bytes of a hash that are counted, and counts that are merged into the others at a time.
KEY, LOOSE = 5, 1 << 19
TOP = np.uint64((1 << 64) - (1 << (64 - 8 * KEY)))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    keys.clear()
    counts.clear()
    order = np.argsort(key, kind="stable")
    key = key[order]
    count = count[order]
    del order
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[at], np.add.reduceat(count, at) if len(at) else count


class Held:
    """Keys with counts of one task, merged now and then."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.loose = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.loose += len(k)
        if self.loose > LOOSE:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            k, c = merged(self.keys, self.counts)
            self.keys, self.counts = [k], [c]
        self.loose = 0
        return (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def size(self) -> int:
        return sum(map(len, self.keys))


PACKED_DDL = "kind int, part int, ones binary, more binary, n binary"
PACKED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("ones", pa.binary()), ("more", pa.binary()), ("n", pa.binary())])


def pack(keys: np.ndarray) -> bytes:
    """The leading KEY bytes of 64-bit hashes."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY, 8), np.uint8)
    out[:, :KEY] = np.frombuffer(data, np.uint8).reshape(-1, KEY)
    return out.view(">u8").ravel().astype(np.uint64)


def packed_rows(kind: int, key: np.ndarray, n: np.ndarray, parts: int, enough: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys with their counts (up to ``enough``) as one row per part of the hash range."""
    edge = np.searchsorted(key >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
    for p, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
        if b > a:
            once = n[a:b] == 1
            wide = np.uint8 if enough < 256 else np.int64
            row = [kind, p, pack(key[a:b][once]), pack(key[a:b][~once]), n[a:b][~once].astype(wide).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, PACKED)], schema=PACKED)


def reaching(enough: int):
    """Packed rows of a part to the hashes that reach ``enough``."""
    wide = np.uint8 if enough < 256 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[tuple[int, int], list[np.ndarray]] = {}
        counts: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for kind, part, ones, more, n in zip(*(c.to_pylist() for c in batch.columns)):
                keys.setdefault((kind, part), []).extend((unpack(ones), unpack(more)))
                counts.setdefault((kind, part), []).extend((np.ones(len(ones) // KEY, np.int64), np.frombuffer(n, wide).astype(np.int64)))
        for at in list(keys):
            key, n = merged(keys.pop(at), counts.pop(at))
            key = key[n >= enough].view(np.int64)
            for i in range(0, len(key), 1 << 16):
                some = key[i : i + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"kind": np.full(len(some), at[0], np.int32), "h": some})

    return run


# ---- keys that come back to the rows they are of -----------------------------------------

# Rows and keys of one chunk at most; a row is named by its number in the chunk.
CHUNK_ROWS, CHUNK_KEYS = 1 << 16, 1 << 20
OWNED_DDL = "chunk long, part int, keys binary, owners binary, need binary"
OWNED = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("need", pa.binary())])


def pack_sorted(keys: np.ndarray) -> bytes:
    """The leading KEY bytes of one or more sorted hashes: the first, then the steps to the next in as few bytes as all need."""
    top = keys >> np.uint64(64 - 8 * KEY)
    step = np.diff(top, prepend=top[:1])
    width = max(1, -(-int(step.max()).bit_length() // 8))
    return top[:1].astype("<u8").tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    """``n`` packed hashes; the bytes that were cut off are zero."""
    step = np.zeros((n, 8), np.uint8)
    step[:, : (len(data) - 8) // n] = np.frombuffer(data, np.uint8, offset=8).reshape(n, -1)
    return (np.frombuffer(data, "<u8", 1) + step.view("<u8").ravel().cumsum(dtype=np.uint64)) << np.uint64(64 - 8 * KEY)


def owned_rows(chunk: int, keys: np.ndarray, owner: np.ndarray, rows: np.ndarray, need: np.ndarray, parts: int) -> pa.RecordBatch:
    """A chunk's keys with the numbers of their rows, as one row per part of the hash range, and one with the rows'
    hashes and how many repeated keys each needs."""
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order].astype("<u2")
    edge = np.searchsorted(keys >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
    out = [(chunk, p, pack_sorted(keys[a:b]), owner[a:b].tobytes(), None) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
    out.append((chunk, chunk % parts, rows.astype("<i8").tobytes(), None, need.astype("<i8").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OWNED)], schema=OWNED)


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all rows of a part: per chunk the owners of keys that occur twice or more. Rows without owners pass."""
    held: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for batch in batches:
        of_rows = pa.compute.is_null(batch.column("owners"))
        yield batch.filter(of_rows)
        for chunk, part, keys, owners, _ in zip(*(c.to_pylist() for c in batch.filter(pa.compute.invert(of_rows)).columns)):
            held.setdefault(part, []).append((chunk, keys, owners))
    for part in list(held):
        chunks, packed, owners = zip(*held.pop(part))
        owner = [np.frombuffer(x, "<u2") for x in owners]
        key = np.concatenate([unpack_sorted(x, len(o)) for x, o in zip(packed, owner)])
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edge = np.cumsum([0, *map(len, owner)])
        hits = [o[twice[a:b]].tobytes() for o, a, b in zip(owner, edge[:-1], edge[1:])]
        none = [None] * len(hits)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((chunks, [part] * len(hits), none, hits, none), OWNED)], schema=OWNED)


def enough_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row``: hashes of the rows that own as many repeated keys as they need. Gets all rows of a chunk."""
    count: dict[int, np.ndarray] = {}
    rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for chunk, _, keys, owners, need in zip(*(c.to_pylist() for c in batch.columns)):
            if owners is None:
                rows[chunk] = np.frombuffer(keys, "<i8"), np.frombuffer(need, "<i8")
            else:
                # No longer than the chunk has rows.
                n = np.bincount(np.frombuffer(owners, "<u2"))
                a, b = sorted((n, count.get(chunk, n[:0])), key=len)
                b[: len(a)] += a
                count[chunk] = b
    for chunk, (row, need) in rows.items():
        n = count.get(chunk, np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(row[: len(n)][n >= need[: len(n)]], pa.int64())], names=["row"])
