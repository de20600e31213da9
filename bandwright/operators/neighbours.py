"""Exact nearest neighbours and distances between groups (JN-3..14).

``knn`` never forms the pairs of a cross join. When one side fits in memory (its size is checked) that
side is broadcast and the other side is scanned once. Otherwise rows are split into cells around
pivot rows, a reference is sent only to the cells it may have a neighbour in (triangle inequality),
cells are cut into bounded blocks, and only k rows per query and block leave a task. Copies of one
vector are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import cut
from .moments import spectra_matrix
from .ordered import join_on, ordinal, tie_rank, with_stats

# Bytes of vectors a side may hold to be broadcast.
BROADCAST_BYTES = 128 << 20
CELL_ROWS = 20_000
BLOCK_ROWS = 8_192
MAX_PIVOTS = 1_024
# Rows of a tile of queries and of references in one search.
QUERY_TILE, REF_TILE = 256, 8_192
# Groups whose samples meet in one task.
GROUP_BLOCK = 32

OUT = "qid long, rid long, d double"
OUT_SCHEMA = pa.schema([("qid", pa.int64()), ("rid", pa.int64()), ("d", pa.float64())])


def search(q: np.ndarray, qid: np.ndarray, r: np.ndarray, rid: np.ndarray, k: int, no_self: bool) -> tuple:
    """k nearest references of each query by (distance, id). A matrix product finds the candidates and
    their distances are then computed directly, so equal vectors get equal distances. Queries and references
    are taken in tiles; a distance tile never exceeds ``QUERY_TILE * REF_TILE`` numbers, and the best k so far
    are carried from tile to tile."""
    out_q, out_r, out_d = [], [], []
    if len(r) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for s in range(0, len(q), QUERY_TILE):
        part, ids = q[s : s + QUERY_TILE], qid[s : s + QUERY_TILE]
        best = [(np.empty(0, np.int64), np.empty(0))] * len(part)
        for t in range(0, len(r), REF_TILE):
            best = _merge_tile(part, ids, r[t : t + REF_TILE], rid[t : t + REF_TILE], k, no_self, best)
        for j, (who, dist) in enumerate(best):
            out_q.append(np.full(len(who), ids[j]))
            out_r.append(who)
            out_d.append(dist)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_d)


def _merge_tile(part: np.ndarray, ids: np.ndarray, r: np.ndarray, rid: np.ndarray, k: int, no_self: bool, best: list) -> list:
    """The best k of each query after one more tile of references."""
    q2, r2 = (part * part).sum(1), (r * r).sum(1)
    near = q2[:, None] + r2[None, :] - 2.0 * (part @ r.T)
    if no_self:
        near[ids[:, None] == rid[None, :]] = np.inf
    kk = min(k, near.shape[1])
    edge = np.partition(near, kk - 1, axis=1)[:, kk - 1]
    slack = 1e-9 * (q2 + r2.max()) + 1e-12
    out = []
    for j, (who, held) in enumerate(best):
        limit = edge[j] + slack[j]
        if len(held) >= k:
            limit = min(limit, held[-1] * held[-1] + slack[j])
        cand = np.flatnonzero(near[j] <= limit)
        cand = cand[np.isfinite(near[j][cand])]
        diff = r[cand] - part[j]
        who, dist = np.concatenate([who, rid[cand]]), np.concatenate([held, np.sqrt((diff * diff).sum(1))])
        order = np.lexsort((who, dist))[:k]
        out.append((who[order], dist[order]))
    return out


def _batch(found: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())],
        schema=OUT_SCHEMA,
    )


def _held(df: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors when there are at most ``limit`` rows."""
    t = df.limit(limit + 1).toArrow().combine_chunks()
    if t.num_rows > limit:
        return None
    if t.num_rows == 0:
        return np.empty(0, np.int64), np.empty((0, 0))
    col = t.column("x").combine_chunks() if isinstance(t.column("x"), pa.ChunkedArray) else t.column("x")
    return t.column("id").to_numpy().astype(np.int64), spectra_matrix(col)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest per query; Spark keeps k rows per query and partition before the shuffle."""
    w = Window.partitionBy("qid").orderBy("d", "rid")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def knn(
    queries: DataFrame, refs: DataFrame, k: int, no_self: bool = False, metric: str = "euclidean",
    plan: str | None = None,
) -> DataFrame:
    """(qid, rid, d, pos) for rows (id, x). ``metric='cosine'`` returns the cosine distance. ``plan``
    (refs, queries or cells) is chosen from the sizes when not given."""
    q, r = queries.select("id", "x"), refs.select("id", "x")
    if metric == "cosine":
        q, r = (s.select("id", A.l2_normalise(F.col("x")).alias("x")) for s in (q, r))
    first = r.first()
    d = len(first["x"]) if first is not None else 1
    limit = max(1, BROADCAST_BYTES // (8 * d))
    held = _held(r, limit) if plan in (None, "refs") else None
    if held is not None:
        out = _scan_queries(q, held, k, no_self)
    else:
        held = _held(q, limit) if plan in (None, "queries") else None
        out = _scan_refs(r, held, k, no_self) if held is not None else _cells(q, r, k, no_self)
    if metric == "cosine":
        # unit vectors: squared distance is twice the cosine distance
        out = out.withColumn("d", F.col("d") * F.col("d") / 2)
    return out


def _scan_queries(q: DataFrame, held: tuple, k: int, no_self: bool) -> DataFrame:
    shared = q.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, r = shared.value
        for b in batches:
            if b.num_rows:
                found = search(spectra_matrix(b.column("x")), b.column("id").to_numpy(), r, rid, k, no_self)
                if len(found[0]) == 0:
                    continue
                run_starts = np.flatnonzero(np.r_[True, found[0][1:] != found[0][:-1]])
                pos = np.arange(len(found[0])) - np.repeat(run_starts, np.diff(np.r_[run_starts, len(found[0])])) + 1
                yield _batch(found).append_column("pos", pa.array(pos.astype(np.int32)))

    # a query is searched whole in one task, in order, so its rows can be numbered there
    return q.mapInArrow(run, OUT + ", pos int")


def _scan_refs(r: DataFrame, held: tuple, k: int, no_self: bool) -> DataFrame:
    shared = r.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        for b in batches:
            if b.num_rows:
                yield _batch(search(q, qid, spectra_matrix(b.column("x")), b.column("id").to_numpy(), k, no_self))

    return _best(r.mapInArrow(run, OUT), k)


def _cells(q: DataFrame, r: DataFrame, k: int, no_self: bool) -> DataFrame:
    want = k + 1 if no_self else k
    spark = q.sparkSession
    # copies of one vector: the lowest ids suffice as references, and one search serves all queries
    w = Window.partitionBy("x").orderBy("id")
    refs = r.withColumn("n", F.row_number().over(w)).where(F.col("n") <= want).drop("n")
    leads = q.groupBy("x").agg(F.min("id").alias("id"))
    refs, leads = cut(refs), cut(leads)
    n_ref = refs.count()
    count = int(min(MAX_PIVOTS, max(4, n_ref // CELL_ROWS)))
    _, pivots = _held(refs.orderBy(F.xxhash64("id"), "id").limit(count), count)
    shared = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            dist = _to_pivots(spectra_matrix(b.column("x")), shared.value)
            cell = dist.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("x"), pa.array(cell.astype(np.int32)), pa.array(dist[np.arange(len(cell)), cell])],
                names=["id", "x", "cell", "dc"],
            )

    ddl = "id long, x array<double>, cell int, dc double"
    q_cells = cut(leads.mapInArrow(nearest, ddl))
    q_stats = q_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dc").alias("u")).collect()
    by_dist = Window.partitionBy("cell").orderBy("dc", "id")
    near = (
        refs.mapInArrow(nearest, ddl).select("cell", "dc", "id")
        .withColumn("n", F.row_number().over(by_dist)).where(F.col("n") <= want).select("cell", "dc").collect()
    )
    closest = np.full((len(pivots), want), np.inf)
    filled = np.zeros(len(pivots), dtype=int)
    for row in near:
        closest[row["cell"], filled[row["cell"]]] = row["dc"]
        filled[row["cell"]] += 1
    between = _to_pivots(pivots, pivots)
    reach, q_count = {}, {}
    for row in q_stats:
        upper = (row["u"] + between[row["cell"]][:, None] + closest).ravel()
        theta = float(np.partition(upper, want - 1)[want - 1])
        reach[row["cell"]] = (row["u"] + theta) * (1 + 1e-9) + 1e-9
        q_count[row["cell"]] = row["n"]
    cells = np.asarray(sorted(reach))
    bounds = np.asarray([reach[c] for c in cells])
    sent = spark.sparkContext.broadcast((cells, bounds))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            at, limit = sent.value
            x = spectra_matrix(b.column("x"))
            hit = _to_pivots(x, shared.value[at]) <= limit
            for j, c in enumerate(at):
                rows = np.flatnonzero(hit[:, j])
                if len(rows):
                    part = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("x"), pa.array(np.full(len(rows), c, np.int32))], names=["id", "x", "cell"]
                    )

    placed = refs.mapInArrow(spread, "id long, x array<double>, cell int")
    r_count = {row["cell"]: row["count"] for row in placed.groupBy("cell").count().collect()}
    cuts = [
        (int(c), math.ceil(q_count[c] / BLOCK_ROWS), math.ceil(r_count.get(c, 0) / BLOCK_ROWS) or 1) for c in q_count
    ]
    sizes = F.broadcast(spark.createDataFrame(cuts, "cell int, qn int, rn int"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q_cells.join(sizes, "cell").withColumn("qb", own("qn")).withColumn("rb", every("rn"))
    right = placed.join(sizes, "cell").withColumn("rb", own("rn")).withColumn("qb", every("qn"))
    keys = ["cell", "qb", "rb"]

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return OUT_SCHEMA.empty_table()
        qx, rx = (spectra_matrix(t.column("x").combine_chunks()) for t in (a, b))
        found = search(qx, a.column("id").to_numpy(), rx, b.column("id").to_numpy(), want, False)
        return pa.Table.from_batches([_batch(found)])

    found = (
        left.select(*keys, "id", "x").groupBy(*keys)
        .cogroup(right.select(*keys, "id", "x").groupBy(*keys)).applyInArrow(block, OUT)
    )
    best = _best(found, want).drop("pos").withColumnRenamed("qid", "lead")
    # give every copy of a query vector the result of its lead
    alias = leads.withColumnRenamed("id", "lead").join(q.withColumnRenamed("id", "qid"), "x").select("lead", "qid")
    out = alias.join(best, "lead").select("qid", "rid", "d")
    if no_self:
        out = out.where(F.col("qid") != F.col("rid"))
    return _best(out, k)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(sq, 0.0))


# ---- uses of the neighbours ------------------------------------------------------------


def with_ref(pairs: DataFrame, refs: DataFrame, *cols: str) -> DataFrame:
    """Attach reference columns to (qid, rid, ..) rows."""
    return pairs.join(refs.select(F.col("id").alias("rid"), *cols), "rid")


def inverse_distance_mean(pairs: DataFrame, refs: DataFrame, value: str, name: str = "value") -> DataFrame:
    w = 1.0 / F.greatest(F.col("d"), F.lit(1e-6))
    return with_ref(pairs, refs, value).groupBy("qid").agg((F.sum(w * F.col(value)) / F.sum(w)).alias(name))


def mean_distance(pairs: DataFrame, name: str = "mean_d") -> DataFrame:
    return pairs.groupBy("qid").agg(F.avg("d").alias(name))


def inconsistency(df: DataFrame, k: int, y: str = "y") -> DataFrame:
    """|y - median of the k neighbours' y|, self left out; k values per group at most."""
    mid = with_ref(knn(df, df, k, no_self=True), df, y).groupBy("qid").agg(F.percentile(y, F.lit(0.5)).alias("m"))
    return df.join(mid.withColumnRenamed("qid", "id"), "id").select("id", F.abs(F.col(y) - F.col("m")).alias("inconsistency"))


def neighbour_groups(pairs: DataFrame, queries: DataFrame, refs: DataFrame, n: int = 3) -> DataFrame:
    """Per query group: the n commonest reference groups among the neighbours, with shares."""
    asked = queries.select(F.col("id").alias("qid"), F.col("grp").alias("test_grp"))
    both = with_ref(pairs, refs, "grp").join(asked, "qid")
    counts = both.groupBy("test_grp", "grp").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy("test_grp"))
    w = Window.partitionBy("test_grp").orderBy(F.col("c").desc(), "grp")
    ranked = counts.withColumn("share", F.col("c") / total).withColumn("pos", F.row_number().over(w))
    return ranked.where(F.col("pos") <= n)


def proximity(df: DataFrame, marked: DataFrame, k: int = 5) -> DataFrame:
    """Average-tie percentile rank of minus the mean distance to the k nearest marked rows."""
    near = mean_distance(knn(df, marked, k)).withColumn("s", -F.col("mean_d")).withColumnRenamed("qid", "id")
    out = with_stats(tie_rank(near, "s", "id", "t"), [], F.count("*").alias("n"))
    return out.select("id", "mean_d", (F.col("t") / F.col("n")).alias("proximity"))


def test_likeness(train: DataFrame, test: DataFrame, k: int = 10, mode: str = "knn") -> DataFrame:
    """Minus the mean distance of each train row to its k nearest test rows; ``ratio`` divides by the
    mean distance to its train neighbours."""
    to_test = mean_distance(knn(train, test, k), "a")
    if mode == "knn":
        return to_test.select(F.col("qid").alias("id"), (-F.col("a")).alias("likeness"))
    to_train = mean_distance(knn(train, train, max(2, k) - 1, no_self=True), "b")
    return to_test.join(to_train, "qid").select(
        F.col("qid").alias("id"), (-F.col("a") / F.greatest("b", F.lit(1e-12))).alias("likeness")
    )


# ---- groups ----------------------------------------------------------------------------


def nearest_groups(test: DataFrame, train: DataFrame, n: int) -> DataFrame:
    """n nearest train centroids of every test centroid by cosine; rows (grp, x) on both sides."""
    asked = test.select(F.col("grp").cast("long").alias("id"), "x")
    held = train.select(F.col("grp").cast("long").alias("id"), "x")
    near = knn(asked, held, n, metric="cosine")
    return near.select(
        F.col("qid").alias("test_grp"), F.col("rid").alias("train_grp"), (1 - F.col("d")).alias("cosine"), "pos"
    )


def evenly_spaced(df: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows per group, evenly spaced in id order (the sampling the distance between
    groups is defined on)."""
    sized = with_stats(ordinal(df, ["grp"], ["id"], "__r"), ["grp"], F.count("*").alias("__n"))
    step = (F.col("__n") - 1) / float(max(limit - 1, 1))
    k = F.round(F.col("__r") / step)
    kept = (F.col("__n") <= limit) | ((k <= limit - 1) & (F.bround(k * step).cast("long") == F.col("__r")))
    return sized.where(kept).drop("__r", "__n")


PAIR_DDL = "a long, b long, s double, n long"


def _cross_sums(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sum and count of distances per (left group, right group). Every pair of groups is asked for; groups are
    dealt into blocks and each pair of blocks meets in one task on the executors."""
    sides = []
    blocks = [max(1, math.ceil(side.select("grp").distinct().count() / GROUP_BLOCK)) for side in (left, right)]
    for own, mine, other, name in ((left, blocks[0], blocks[1], ("lb", "rb")), (right, blocks[1], blocks[0], ("rb", "lb"))):
        rows = own.select("x", F.col("grp").cast("long").alias("grp"))
        rows = rows.withColumn(name[0], F.pmod(F.xxhash64("grp"), F.lit(mine))).withColumn(name[1], F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        sides.append(rows.select(F.col("lb").cast("int"), F.col("rb").cast("int"), "grp", "x").groupBy("lb", "rb"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"a": [], "b": [], "s": [], "n": []}
        if a.num_rows and b.num_rows:
            x, g = spectra_matrix(b.column("x").combine_chunks()), b.column("grp").to_numpy()
            names, codes = np.unique(g, return_inverse=True)
            count = np.bincount(codes)
            sums: dict[int, np.ndarray] = {}
            size: dict[int, int] = {}
            for v, own in zip(spectra_matrix(a.column("x").combine_chunks()), a.column("grp").to_pylist()):
                part = np.bincount(codes, weights=np.sqrt(((x - v) ** 2).sum(1)))
                sums[own] = sums.get(own, 0.0) + part
                size[own] = size.get(own, 0) + 1
            for own, s in sums.items():
                for to, value, n in zip(names.tolist(), s.tolist(), (count * size[own]).tolist()):
                    for key, held in zip(out, (own, to, value, n)):
                        out[key].append(held)
        return pa.table(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.float64()), ("n", pa.int64())]))

    return sides[0].cogroup(sides[1]).applyInArrow(meet, PAIR_DDL)


def _spread(sample: DataFrame) -> DataFrame:
    """Mean distance inside each group of a sample (0 for one row); groups are bounded by the sample."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf["x"].to_numpy())
        n = len(x)
        s = sum(np.sqrt(((x - v) ** 2).sum(1)).sum() for v in x)
        return pd.DataFrame({"g": [int(pdf["grp"].iloc[0])], "spread": [s / (n * (n - 1)) if n > 1 else 0.0]})

    return sample.select(F.col("grp").cast("long").alias("grp"), "x").groupBy("grp").applyInPandas(run, "g long, spread double")


def _group_facts(df: DataFrame, key: str, size: str, centre: str, y: str | None = None) -> DataFrame:
    """Size, mean spectrum and, with ``y``, target mean and sd of every group, over all rows."""
    rows = df.select(F.col("grp").cast("long").alias(key), "x", (F.col(y) if y else F.lit(None)).cast("double").alias("__y"))
    per = rows.select(key, F.posexplode("x").alias("k", "v")).groupBy(key, "k").agg(F.avg("v").alias("m"))
    mean = per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias(centre))
    facts = [F.count("*").alias(size)]
    if key == "train_grp":
        facts += [F.avg("__y").alias("y_mean"), F.stddev_pop("__y").alias("y_sd")]
    return rows.groupBy(key).agg(*facts).join(mean, key)


def energy_distance(test: DataFrame, train: DataFrame, limit: int = 120, n: int | None = 8, skip_same: bool = False) -> DataFrame:
    """max(0, 2 cross - within - within) between groups, on evenly spaced samples; n best per group by energy, then
    cosine distance of the centroids. ``n_test`` and ``n_train`` are group sizes, ``y_mean`` and ``y_sd`` the
    train group's target (null where ``train`` has no ``y``)."""
    te, tr = cut(evenly_spaced(test, limit)), cut(evenly_spaced(train, limit))
    cross = _cross_sums(te, tr).select(F.col("a").alias("test_grp"), F.col("b").alias("train_grp"), (F.col("s") / F.col("n")).alias("cross"))
    if skip_same:
        cross = cross.where(F.col("test_grp") != F.col("train_grp"))
    out = cross.join(_spread(te).select(F.col("g").alias("test_grp"), F.col("spread").alias("sa")), "test_grp")
    out = out.join(_spread(tr).select(F.col("g").alias("train_grp"), F.col("spread").alias("sb")), "train_grp")
    out = out.select(
        "test_grp", "train_grp", F.greatest(F.lit(0.0), F.col("cross") * 2 - F.col("sa") - F.col("sb")).alias("energy"), "cross"
    )
    out = out.join(_group_facts(test, "test_grp", "n_test", "cu"), "test_grp").join(_group_facts(train, "train_grp", "n_train", "cv", "y" if "y" in train.columns else None), "train_grp")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    scale = F.greatest(F.sqrt(dot("cu", "cu") * dot("cv", "cv")), F.lit(1e-12))
    out = out.withColumn("cosine_distance", 1 - dot("cu", "cv") / scale).drop("cu", "cv")
    w = Window.partitionBy("test_grp").orderBy("energy", "cosine_distance", "train_grp")
    ranked = out.withColumn("pos", F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col("pos") <= n)


def vote_consensus(matches: DataFrame, n: int = 5) -> DataFrame:
    """Top-3 matches of several views counted per test group, as text."""
    from .groups import top_counts

    votes = matches.where(F.col("pos") <= 3).groupBy("test_grp", "train_grp").agg(F.count("*").alias("c"))
    views = matches.groupBy("test_grp").agg(F.countDistinct("view").alias("n_views"))
    return join_on(top_counts(votes, ["test_grp"], "train_grp", "c", n, "votes"), views, ["test_grp"])


def pseudo_alignment(train: DataFrame, limit: int = 120, y: str = "y") -> DataFrame:
    """Each train group held out in turn and matched on spectra only; target gaps to its match."""
    match = energy_distance(train, train, limit, 1, skip_same=True)
    stats = train.groupBy(F.col("grp").cast("long").alias("g")).agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s"))
    own = stats.select(F.col("g").alias("test_grp"), F.col("m").alias("ma"), F.col("s").alias("sa"))
    other = stats.select(F.col("g").alias("train_grp"), F.col("m").alias("mb"), F.col("s").alias("sb"))
    return match.join(own, "test_grp").join(other, "train_grp").select(
        F.col("test_grp").alias("held_out"), F.col("train_grp").alias("matched"), "energy",
        (F.col("mb") - F.col("ma")).alias("mean_gap"), (F.col("sb") - F.col("sa")).alias("sd_gap"),
    )
