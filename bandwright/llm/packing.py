"""Packing of token sequences by bounded-space online best-fit.

Each task reads its documents once, in order of arrival, and keeps a fixed number of open bins. The open bins
hang in lists by free space, and one integer holds a bit for each free space that has bins; the best fit for a
piece is the lowest set bit at or above its length. When one bin too many is open, the fullest closes. Within
one Arrow batch the longest pieces are placed first, so that short ones fill the gaps.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_column

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """A fixed number of open bins, found by free space."""

    def __init__(self, size: int, limit: int, first: int) -> None:
        self.size, self.limit, self.next, self.open = size, limit, first, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece of 1 to ``size`` tokens."""
        above = self.bits >> length
        if above:
            free = length + ((above & -above).bit_length() - 1)
            bin_ = self._take(free)
        else:
            bin_, free = self.next, self.size
            self.next += 1
        if left := free - length:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.size - free

    def _take(self, free: int) -> int:
        at = self.by_free[free]
        bin_ = at.pop()
        if not at:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_


class Encoder:
    """Ids of a byte-level BPE, from its file of ranks, as little-endian 32-bit bytes. The string of a special token
    in a text is that token, as the vocabulary's own tokenizer reads it by default."""

    # Fixed value: the pre-token pattern that belongs to the vocabulary.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    # Fixed value: the special token of the vocabulary.
    SPECIAL = {"<|endoftext|>": 50256}

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=self.SPECIAL)

    def __call__(self, text: str) -> bytes:
        ids = array("I", self.encoding.encode(text, allowed_special="all"))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def pieces(tokens: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: the first may be shorter, the others are full."""
    first = tokens - size * (-(-tokens // size) - 1)
    return [(0, first)] + [(s, size) for s in range(first, tokens, size)]


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, open_bins: int = 16_384, end_id: int = 2) -> DataFrame:
    """One row per piece of every document: ``SCHEMA``. A null text is empty and becomes the end id alone.
    ``tokenizer_path`` names a file of ranks. The string of a special token in a text is one id. Longer documents are cut, others stay whole; repeated rows and ids are packed like any other. An empty
    table gives no rows. Other columns are not read.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        task = TaskContext.get()
        bins = OpenBins(size, open_bins, (task.partitionId() if task else 0) << 36)
        for batch in batches:
            todo = []
            for part in slices([batch]):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    row = encoder(text) + end
                    for k, (start, length) in enumerate(pieces(len(row) // 4, size)):
                        todo.append((length, doc, k, start, zlib.crc32(row[4 * start : 4 * (start + length)])))
            todo.sort(key=lambda x: -x[0])
            put = [bins.put(x[0]) for x in todo]
            if todo:
                length, doc, k, start, crc = zip(*todo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc, *zip(*put)))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    return docs.select(F.col("doc_id").cast("long"), text_column()).mapInArrow(run, SCHEMA)
