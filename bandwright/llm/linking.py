"""Exact links between similar sets that share keys, without a row per pair.

Sets come with keys (tokens of which similar sets share one). The members of a key's list are not paired.
Every set takes a home, found through the leader of its longest list. The sets of a home are split into blocks of a bounded
size. A block is compared with the leader and, as far as sets do not link to it, within itself. After that two
blocks are compared when some key has members in both, except those parts of one home that link to the leader:
they are connected already. So a group of near copies costs rows in proportion to its size, and only what does
not link to its leader is compared further.

Inside a comparison of blocks the sets are held once and each set's overlaps with all others are counted by
index lists; where a set is highly similar to the one before, its counts are derived from those by the lists of
the tokens in which the two differ. Sets are in order of size, so a list is entered at the first set that is
large enough for the similarity; what stands before that place is skipped, and stays so for all later sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Sets and set elements in one block; what a task compares at once is two of these.
BLOCK_SETS, BLOCK_ITEMS = 512, 1 << 19
# So few sets are compared pair by pair.
FEW = 8


def similar(common: int, a: int, b: int, num: int, den: int) -> bool:
    return den * common >= num * (a + b - common)


class Lists:
    """Index lists of tokens over sets in order of size: the places of a token are the numbers of its sets, rising.

    ``place`` joins token and set in one rising number, so the part of a list from a given set on is found by a
    search; blocks of ``BLOCK`` places are told apart first by their last numbers. ``read`` and ``skipped`` count
    the places of the asked lists that were and were not looked at.
    """

    BLOCK = 64

    def __init__(self, token: np.ndarray, owner: np.ndarray, tokens: int, sets: int):
        by_token = np.argsort(token, kind="stable")
        self.sets = sets
        self.owner = owner[by_token]
        self.place = token[by_token] * sets + self.owner
        self.first = np.searchsorted(token[by_token], np.arange(tokens + 1))
        self.last = self.place[self.BLOCK - 1 :: self.BLOCK]
        self.read = self.skipped = 0

    def entry(self, tokens: np.ndarray, low: int) -> np.ndarray:
        """First place of each list whose set is ``low`` or later."""
        if not low:
            return self.first[tokens]
        wanted = tokens * self.sets + low
        at = np.searchsorted(self.last, wanted) * self.BLOCK
        for step in (32, 16, 8, 4, 2, 1):
            end = at + step
            behind = self.place[np.minimum(end, len(self.place)) - 1] < wanted
            at = np.where(behind & (end <= len(self.place)), end, at)
        return at

    def counted(self, tokens: np.ndarray, low: int) -> np.ndarray:
        """How many of the tokens each set from ``low`` on holds; smaller numbers mean nothing."""
        start = self.entry(tokens, low)
        n = self.first[tokens + 1] - start
        total = int(n.sum())
        self.read += total
        self.skipped += int((start - self.first[tokens]).sum())
        if not total:
            return np.zeros(self.sets, np.int64)
        at = np.repeat(start - np.concatenate(([0], n.cumsum()[:-1])), n) + np.arange(total)
        return np.bincount(self.owner[at], minlength=self.sets)


def _link_few(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int, joined: np.ndarray | None) -> list[tuple[int, int]]:
    """``link_sets`` for a few sets."""
    held, group, out = [set(x.tolist()) for x in sets], list(range(len(sets))), []
    two = len(set(sides.tolist())) > 1
    if joined is not None and joined.any():
        first = int(np.flatnonzero(joined)[0])
        group = [first if done else i for i, done in enumerate(joined.tolist())]
    for y in range(len(sets)):
        for x in range(y):
            if group[x] == group[y] or two and sides[x] == sides[y]:
                continue
            a, b = len(held[x]), len(held[y])
            if den * min(a, b) >= num * max(a, b) and similar(len(held[x] & held[y]), a, b, num, den):
                gone = group[y]
                group = [group[x] if g == gone else g for g in group]
                out.append((x, y))
    return out


def link_sets(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a forest that connects all linked sets. Pairs within a side are left out where there are two
    sides, and those of two ``joined`` sets, which are connected already. Sets hold distinct 64-bit values."""
    m = len(sets)
    if m <= FEW:
        return _link_few(sets, sides, num, den, joined)
    order = sorted(range(m), key=lambda i: (len(sets[i]), sets[i][:1].tolist()))
    sizes = np.array([len(sets[i]) for i in order])
    side = sides[order]
    two = len(np.unique(side)) > 1
    token = np.concatenate([sets[i] for i in order]) if m else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(m), sizes)
    _, token, held = np.unique(token, return_inverse=True, return_counts=True)
    keep = held[token] > 1
    token, owner = token[keep], owner[keep]
    lists = Lists(token, owner, len(held), m)
    bounds = np.searchsorted(owner, np.arange(m + 1))
    mine = [np.sort(token[bounds[y] : bounds[y + 1]]) for y in range(m)]

    up = list(range(m))
    done = np.zeros(m, bool) if joined is None else joined[order]
    if done.any():
        for i in np.flatnonzero(done).tolist():
            up[i] = int(np.flatnonzero(done)[0])

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    counts, before = np.zeros(m, np.int64), np.empty(0, np.int64)
    for y in range(m):
        # Only sets up to y: sizes below the bound cannot reach the similarity.
        low = int(np.searchsorted(sizes, -(-num * int(sizes[y]) // den)))
        if low >= y or done[y] and done[low:y].all():
            continue
        gone, new = np.setdiff1d(before, mine[y], True), np.setdiff1d(mine[y], before, True)
        if len(gone) + len(new) < len(mine[y]):
            # The bound never falls, so what was skipped for a set before is not asked for again.
            counts = counts - lists.counted(gone, low) + lists.counted(new, low)
        else:
            counts = lists.counted(mine[y], low)
        before = mine[y]
        common = counts[low:y]
        hit = den * common >= num * (sizes[low:y] + sizes[y] - common)
        if two:
            hit &= side[low:y] != side[y]
        for x in (np.flatnonzero(hit) + low).tolist():
            if root(x) != root(y):
                up[root(x)] = root(y)
                out.append((order[x], order[y]))
    return out


def _listed(keys: DataFrame) -> DataFrame:
    """The keys of two sets or more, with length and leader of their list."""
    lists = keys.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("pos", "id")).alias("lead")).where("m > 1").select("key", "m", F.col("lead.id").alias("leader"))
    return cut(keys.select("key", "id", "n").join(cut(lists), "key"))


def _homes(listed: DataFrame, block_sets: int, block_items: int) -> DataFrame:
    """``id, leader, block``: a set follows the leader of its longest list, and that one's leader, twice; so the
    many lists of one group end in few homes. A home falls into as many blocks as its size asks for."""
    best = listed.groupBy("id").agg(F.max(F.struct("m", (-F.col("leader")).alias("l"))).alias("best"), F.max("n").alias("n"))
    homes = cut(best.select("id", "n", (-F.col("best.l")).alias("leader")))
    for _ in range(2):
        up = homes.select(F.col("id").alias("leader"), F.col("leader").alias("next"))
        homes = cut(homes.join(up, "leader", "left").select("id", "n", F.coalesce("next", "leader").alias("leader")))
    size = homes.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_items)).alias("parts"))
    return cut(homes.join(size, "leader").select("id", "leader", F.xxhash64("leader", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")))


FOUND = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("settled", pa.bool_())])


def _grouped(rows: DataFrame, by: str, compare: Callable[..., list[tuple]]) -> DataFrame:
    """Rows (id, other, settled) of ``compare``, which gets the columns of all rows of one ``by``. Groups are mostly of two or
    three rows, so that they are told apart here and not sent to Python one by one."""
    names = [by, *(c for c in rows.columns if c != by)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [[] for _ in names[1:]], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(map(kind, c)), f.type) for kind, c, f in zip((int, int, lambda x: x if x is None else bool(x)), columns, FOUND)], schema=FOUND)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            columns = [c.to_pylist() for c in batch.columns[1:]]
            edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(edge[:-1], edge[1:]):
                if key is not None and keys[lo] != key:
                    out += compare(*held)
                    held = [[] for _ in names[1:]]
                    if len(out) > 20_000:
                        yield flush()
                key = keys[lo]
                for h, c in zip(held, columns):
                    h += c[lo:hi]
        if key is not None:
            out += compare(*held)
        yield flush()

    return rows.select(names).repartition(by).sortWithinPartitions(by).mapInArrow(run, "id long, other long, settled boolean")


def links(keys: DataFrame, sets_of, decode, num: int, den: int, block_sets: int = BLOCK_SETS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Edges ``a, b`` (longs) that connect every pair of linked sets, perhaps through others.

    ``keys``: ``key, id, n, pos``, one row per set and key. ``sets_of(ids)`` gives ``id, items`` for a table of
    ids, possibly with more ids and repeated rows; ``decode(items)`` an array of distinct 64-bit values.
    """
    listed = _listed(keys)
    homes = _homes(listed, block_sets, block_items)
    sets = cut(sets_of(homes.select("id")))

    def decoded(ids: list[int], items: list[bytes]) -> tuple[list[int], list[np.ndarray]]:
        one = dict(zip(ids, items))
        return list(one), [decode(x) for x in one.values()]

    def within(leaders: list[int], ids: list[int], items: list[bytes], member: list[bool]) -> list[tuple]:
        """One block with its leader: who links to the leader, and all other links inside."""
        own, leader = {i for i, m in zip(ids, member) if m}, leaders[0]
        ids, held = decoded(ids, items)
        lead = held[ids.index(leader)] if leader in ids else np.empty(0, np.uint64)
        settled = np.array([i == leader or similar(len(np.intersect1d(x, lead, True)), len(x), len(lead), num, den) for i, x in zip(ids, held)])
        out = [(i, leader if s else i, s) for i, s in zip(ids, settled) if i in own]
        if not settled.all():
            out += [(ids[x], ids[y], None) for x, y in link_sets(held, np.zeros(len(held)), num, den, settled)]
        return out

    members = homes.join(sets, "id").select("block", "leader", "id", "items", F.lit(True).alias("member"))
    lead = homes.select("block", "leader").distinct().join(sets.withColumnRenamed("id", "leader"), "leader").select("block", "leader", F.col("leader").alias("id"), "items", F.lit(False).alias("member"))
    inside = cut(_grouped(members.union(lead), "block", within))
    known = inside.where("settled IS NOT NULL").groupBy("id").agg(F.max("settled").alias("settled"))
    placed = cut(homes.join(known, "id").select("id", "leader", F.col("block").alias("home"), F.xxhash64("block", "settled").alias("block"), F.when(F.col("settled"), F.col("leader")).alias("under")))

    def across(blocks: list[int], ids: list[int], items: list[bytes]) -> list[tuple]:
        """Two blocks: links between them."""
        sides = dict(zip(ids, blocks))
        ids, held = decoded(ids, items)
        return [(ids[x], ids[y], None) for x, y in link_sets(held, np.array([sides[i] for i in ids]), num, den)]

    # Blocks of one home meet whole; of two homes only the sets that have a key in the other.
    # And of those, the ones with which a set of a like size has that key: the smaller of two similar sets has at least
    # ``num / den`` of the other's size.
    seen = cut(listed.select("key", "id", "n").join(placed, "id").select("key", "id", "n", "block", "leader", "under"))
    other = seen.groupBy("key", F.col("block").alias("block2"), F.col("leader").alias("leader2"), F.col("under").alias("under2")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    sized = f"{num} * n <= {den} * high AND {num} * low <= {den} * n"
    far = seen.join(other, "key").where(f"leader <> leader2 AND NOT coalesce(under = under2, false) AND {sized}").select("id", "block", "block2").distinct()
    parts = placed.select("leader", "home", "block", "under").distinct()
    same = parts.join(parts.select("leader", F.col("home").alias("home2"), F.col("block").alias("block2"), F.col("under").alias("under2")), "leader")
    same = cut(same.where("home <> home2 AND NOT coalesce(under = under2, false)").select("block", "block2"))
    near = placed.select("id", "block").join(same, "block").select("id", "block", "block2")
    named = cut(far.union(near).select(F.xxhash64(F.least("block", "block2"), F.greatest("block", "block2")).alias("pair"), "block", "id"))
    apart = _grouped(named.join(sets, "id").select("pair", "block", "id", "items"), "pair", across)
    return cut(inside.union(apart).where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable from each id of ``edges`` (``a, b``). In each round every node follows
    the least of its neighbours, in an order by hash, and that one's; the edges are then drawn between those that are
    followed, so that a round has fewer than the one before. Rounds end when no edge is left; every one is written."""
    known = edges.where("a <> b").select("a", "b")
    rest = cut(known.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).distinct())
    rounds = []
    while not rest.isEmpty():
        up = cut(rest.union(rest.select("b", "a")).groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("up")))
        above = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
        up = cut(up.join(above, "up").select("node", F.col("next").alias("up")))
        rounds.append(up)
        for end in ("a", "b"):
            rest = rest.join(up.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up")), end)
        rest = cut(rest.where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
    ids = known.select(F.col("a").alias("id")).union(known.select("b")).distinct().withColumn("node", F.xxhash64("id"))
    if not rounds:
        return ids.select("id", F.col("id").alias("component"))
    ends = rounds.pop()
    while rounds:
        last = ends.select(F.col("node").alias("up"), F.col("up").alias("end"))
        ends = cut(rounds.pop().join(last, "up", "left").select("node", F.coalesce("end", "up").alias("up")))
    ids = cut(ids.join(ends, "node").select("id", "up"))
    return ids.join(ids.groupBy("up").agg(F.min("id").alias("component")), "up").select("id", "component")
