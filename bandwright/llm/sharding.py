"""Sharding by longest-processing-time scheduling: groups that must stay together go, largest first, to the
least-loaded shard through a heap.

The heap on the driver never sees all groups. A group as large as ``1 / grain`` of a shard's fair share is an
item of its own (there are at most ``shards * grain`` such groups); all smaller groups are dealt by hash into
``shards * grain`` bundles, whose sums are the other items. So at most ``2 * shards * grain`` numbers are
collected at any input size, and a shard misses the fair share by about one bundle.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import text_column

SLOT_ROWS = 10_000


def schedule(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Item to shard: items (key, size) by falling size, each to the shard with the least so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard(docs: DataFrame, shards: int = 40, grain: int = 256, overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: near-equal bytes per shard, equal texts together.

    A null text is the empty text. Rows with the same doc_id, or with none, are placed like any other; equal
    rows share their text's shard and get slots of their own. A group larger than a fair share fills a shard
    by itself. Slots are gapless; which row has which may differ between runs. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    body = text_column()
    # Written once: both the sums and the rows below read these few bytes per document, not the texts.
    rows = cut(
        docs.select(
            "doc_id", (F.octet_length(body) + overhead).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.md5(body).alias("grp"),
        ).withColumns({"bundle": F.pmod(F.xxhash64("grp"), F.lit(shards * grain)), "no": F.monotonically_increasing_id()})
    )
    held = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    least = max(1, (held.bytes or 0) // (shards * grain))
    big = cut(rows.groupBy("grp", "bundle").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > least))
    of_big = {r.grp: r.bytes for r in big.select("grp", "bytes").toLocalIterator()}
    names = {g: shards * grain + k for k, g in enumerate(sorted(of_big))}
    rest = rows.groupBy("bundle").agg(F.sum("size").alias("bytes"))
    taken = big.groupBy("bundle").agg(F.sum("bytes").alias("taken"))
    rest = rest.join(taken, "bundle", "left").select("bundle", (F.col("bytes") - F.coalesce("taken", F.lit(0))).alias("bytes"))
    items = [(r.bundle, r.bytes) for r in rest.where("bytes > 0").toLocalIterator()] + [(names[g], b) for g, b in of_big.items()]
    placed = schedule(items, shards)
    own = spark.createDataFrame([(g, placed[k]) for g, k in names.items()], "grp string, own int")
    dealt = spark.createDataFrame([(k, s) for k, s in placed.items() if k < shards * grain], "bundle long, dealt int")
    # Both tables have at most shards * grain rows by construction.
    put = rows.join(F.broadcast(own), "grp", "left").join(F.broadcast(dealt), "bundle", "left")
    put = put.withColumn("shard", F.coalesce("own", "dealt")).drop("own", "dealt", "grp", "bundle")
    return _slots(put, shards, held.n)


def _slots(put: DataFrame, shards: int, n: int) -> DataFrame:
    """Gapless numbers per shard: rows are numbered inside buckets of a bounded size, then moved by the counts
    of the buckets before. Rows are dealt into buckets by their written number, so neither a shard nor the rows of
    one id, or without any, meet in one task."""
    buckets = 16 + n // (shards * SLOT_ROWS)
    put = put.withColumn("part", F.pmod(F.xxhash64("no"), F.lit(buckets)))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "no")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = put.groupBy("shard", "part").agg(F.count("*").alias("c"))
    starts = counts.select("shard", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    numbered = put.withColumn("at", (F.row_number().over(inside) - 1).cast("long"))
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("start")).alias("slot")
    )
