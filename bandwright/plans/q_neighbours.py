"""JN-3..14: nearest groups, nearest neighbours and distances between groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import groups as G
from ..operators import neighbours as Nb
from .fixtures import LONG_SQL, SPECTRA_SQL, TRAIN_SQL, spectra, test, train
from .registry import d, i, query

CENT_SQL = LONG_SQL + """,
cent AS (SELECT grp, list(m ORDER BY band) AS c FROM (SELECT grp, band, avg(v) AS m FROM bands GROUP BY grp, band) GROUP BY grp),
cosine AS (SELECT a.grp AS test_grp, b.grp AS train_grp,
  list_sum(list_transform(range(1, 65), lambda k: a.c[k] * b.c[k])) / greatest(sqrt(list_sum(list_transform(a.c, lambda u: u * u))) * sqrt(list_sum(list_transform(b.c, lambda u: u * u))), 1e-12) AS cosine
  FROM cent a JOIN cent b ON a.grp > 6 AND b.grp <= 6)"""


def centroid_pair(spark, sf):
    return G.centroids(test(spark, sf)), G.centroids(train(spark, sf))


@query(
    "JN-3",
    f"""WITH {CENT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY test_grp ORDER BY cosine DESC, train_grp) AS pos FROM cosine)
SELECT test_grp, train_grp, {d('cosine', 'cosine')}, {i('pos', 'pos')} FROM r WHERE pos <= 3""",
)
def jn_3(spark, sf):
    return Nb.nearest_groups(*centroid_pair(spark, sf), 3)


@query(
    "JN-4",
    f"""WITH {CENT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY test_grp ORDER BY cosine DESC, train_grp) AS pos FROM cosine),
t AS (SELECT grp, avg(y) AS m, stddev_pop(y) AS s FROM spectra GROUP BY grp)
SELECT test_grp, train_grp, {d('1 - cosine', 'distance')}, {i('pos', 'pos')}, {d('m', 'target_mean')}, {d('s', 'target_std')} FROM r JOIN t ON train_grp = grp WHERE pos <= 5""",
)
def jn_4(spark, sf):
    """Five nearest train groups with their target mean and deviation."""
    near = Nb.nearest_groups(*centroid_pair(spark, sf), 5)
    stats = train(spark, sf).groupBy(F.col("grp").alias("train_grp")).agg(
        F.avg("y").alias("target_mean"), F.stddev_pop("y").alias("target_std")
    )
    return near.join(stats, "train_grp").select(
        "test_grp", "train_grp", (1 - F.col("cosine")).alias("distance"), "pos", "target_mean", "target_std"
    )


def pair_sql(left: str, right: str, extra: str = "true") -> str:
    return f"""pairs AS (SELECT a.id AS qid, a.grp AS qgrp, a.y AS qy, b.id AS rid, b.grp AS rgrp, b.y AS ry,
  sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.x[k] - b.x[k]) ** 2))) AS dist FROM {left} a JOIN {right} b ON {extra}),
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS pos FROM pairs)"""


@query(
    "JN-5",
    f"WITH {TRAIN_SQL}, {pair_sql('test', 'train')} SELECT qid, rid, {d('dist', 'd')}, {i('pos', 'pos')} FROM near WHERE pos <= 10",
)
def jn_5(spark, sf):
    return Nb.knn(test(spark, sf), train(spark, sf), 10)


@query(
    "JN-5-cells",
    f"WITH {TRAIN_SQL}, {pair_sql('train', 'train', 'a.id <> b.id')} SELECT qid, rid, {d('dist', 'd')}, {i('pos', 'pos')} FROM near WHERE pos <= 4",
)
def jn_5_cells(spark, sf):
    """The plan for two large sides, on the train rows against themselves."""
    df = train(spark, sf)
    return Nb.knn(df, df, 4, no_self=True, plan="cells")


@query(
    "JN-6",
    f"""WITH {TRAIN_SQL}, {pair_sql('test', 'train')}
SELECT qid AS id, {d('sum(ry / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6))', 'value')} FROM near WHERE pos <= 10 GROUP BY qid""",
)
def jn_6(spark, sf):
    tr = train(spark, sf)
    return Nb.inverse_distance_mean(Nb.knn(test(spark, sf), tr, 10), tr, "y").withColumnRenamed("qid", "id")


@query(
    "JN-7",
    f"WITH {TRAIN_SQL}, {pair_sql('test', 'train')} SELECT qid AS id, {d('avg(dist)', 'mean_d')} FROM near WHERE pos <= 10 GROUP BY qid",
)
def jn_7(spark, sf):
    return Nb.mean_distance(Nb.knn(test(spark, sf), train(spark, sf), 10)).withColumnRenamed("qid", "id")


@query(
    "JN-8",
    f"""WITH {TRAIN_SQL}, {pair_sql('train', 'train', 'a.id <> b.id')}
SELECT qid AS id, {d('abs(any_value(qy) - median(ry))', 'inconsistency')} FROM near WHERE pos <= 10 GROUP BY qid""",
)
def jn_8(spark, sf):
    return Nb.inconsistency(train(spark, sf), 10)


@query(
    "JN-9",
    f"""WITH {TRAIN_SQL}, {pair_sql('test', 'train')}, c AS (SELECT qgrp AS test_grp, rgrp AS grp, count(*) AS c FROM near WHERE pos <= 10 GROUP BY ALL),
r AS (SELECT *, c / sum(c) OVER (PARTITION BY test_grp) AS share, row_number() OVER (PARTITION BY test_grp ORDER BY c DESC, grp) AS pos FROM c)
SELECT test_grp, grp, {i('c', 'c')}, {d('share', 'share')}, {i('pos', 'pos')} FROM r WHERE pos <= 3""",
)
def jn_9(spark, sf):
    te, tr = test(spark, sf), train(spark, sf)
    return Nb.neighbour_groups(Nb.knn(te, tr, 10), te, tr)


@query(
    "JN-10",
    f"""WITH {TRAIN_SQL}, marked AS (SELECT * FROM test WHERE y >= 76), {pair_sql('spectra', 'marked')},
m AS (SELECT qid AS id, avg(dist) AS mean_d FROM near WHERE pos <= 5 GROUP BY qid)
SELECT id, {d('mean_d', 'mean_d')}, {d('(rank() OVER (ORDER BY -mean_d) + (count(*) OVER (PARTITION BY mean_d) - 1) / 2.0) / count(*) OVER ()', 'proximity')} FROM m""",
)
def jn_10(spark, sf):
    return Nb.proximity(spectra(spark, sf), test(spark, sf).where("y >= 76"), 5)


# Evenly spaced samples of 120 rows per group, all rows where there are no more, then mean distances inside and across.
ENERGY_SQL = SPECTRA_SQL + """,
nr AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM spectra),
smp AS (SELECT id, grp, x FROM nr WHERE n <= 120 OR r IN (SELECT CAST(round_even(unnest(range(120)) * (n - 1) / 119.0, 0) AS BIGINT))),
dd AS (SELECT a.grp AS ga, b.grp AS gb, a.id AS ia, b.id AS ib, sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.x[k] - b.x[k]) ** 2))) AS dist FROM smp a, smp b),
spr AS (SELECT ga AS g, avg(dist) AS s FROM dd WHERE ga = gb AND ia <> ib GROUP BY ga),
cr AS (SELECT ga, gb, avg(dist) AS c FROM dd GROUP BY ga, gb),
en AS (SELECT ga AS test_grp, gb AS train_grp, c, greatest(0, 2 * c - p.s - q.s) AS energy FROM cr JOIN spr p ON p.g = ga JOIN spr q ON q.g = gb)"""

COSINE_SQL = """mu AS (SELECT grp, k, avg(x[k]) AS m FROM (SELECT grp, x, unnest(range(1, 65)) AS k FROM spectra) GROUP BY ALL), cm AS (SELECT grp, list(m ORDER BY k) AS mu FROM mu GROUP BY grp),
cosine AS (SELECT a.grp AS test_grp, b.grp AS train_grp, 1 - list_dot_product(a.mu, b.mu) / sqrt(list_dot_product(a.mu, a.mu) * list_dot_product(b.mu, b.mu)) AS cd FROM cm a, cm b)"""


@query(
    "JN-11",
    f"""WITH {ENERGY_SQL}, {COSINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY test_grp ORDER BY energy, cd, train_grp) AS pos FROM en JOIN cosine USING (test_grp, train_grp) WHERE test_grp > 6 AND train_grp <= 6),
gs AS (SELECT grp, count(*) AS n, avg(y) AS ym, stddev_pop(y) AS ys FROM spectra GROUP BY grp)
SELECT test_grp, train_grp, {d('energy', 'energy')}, {d('c', 'cross')}, {i('pos', 'pos')}, {i('p.n', 'n_test')}, {i('q.n', 'n_train')}, {d('q.ym', 'y_mean')}, {d('q.ys', 'y_sd')},
  {d('cd', 'cosine_distance')}
FROM r JOIN gs p ON p.grp = test_grp JOIN gs q ON q.grp = train_grp WHERE pos <= 8""",
)
def jn_11(spark, sf):
    return Nb.energy_distance(test(spark, sf), train(spark, sf))


@query(
    "JN-12",
    f"""WITH {ENERGY_SQL}, {COSINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY test_grp ORDER BY energy, cd, train_grp) AS pos FROM en JOIN cosine USING (test_grp, train_grp) WHERE test_grp <= 6 AND train_grp <= 6 AND test_grp <> train_grp),
t AS (SELECT grp, avg(y) AS m, stddev_pop(y) AS s FROM spectra GROUP BY grp)
SELECT test_grp AS held_out, train_grp AS matched, {d('energy', 'energy')}, {d('b.m - a.m', 'mean_gap')}, {d('b.s - a.s', 'sd_gap')}
FROM r JOIN t a ON a.grp = test_grp JOIN t b ON b.grp = train_grp WHERE pos = 1""",
)
def jn_12(spark, sf):
    return Nb.pseudo_alignment(train(spark, sf))


@query("JN-13")
def jn_13(spark, sf):
    """Votes over the raw, SNV and difference views."""
    views = {"raw": lambda x: x, "snv": lambda x: A.snv(x, ddof=0), "diff1": A.difference}
    out = None
    for name, fn in views.items():
        te, tr = (df.withColumn("x", fn(F.col("x"))) for df in (test(spark, sf), train(spark, sf)))
        part = Nb.energy_distance(te, tr, n=3).withColumn("view", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return Nb.vote_consensus(out)


@query(
    "JN-14",
    f"WITH {TRAIN_SQL}, {pair_sql('train', 'test')} SELECT qid AS id, {d('-avg(dist)', 'likeness')} FROM near WHERE pos <= 10 GROUP BY qid",
)
def jn_14(spark, sf):
    return Nb.test_likeness(train(spark, sf), test(spark, sf), 10)


@query(
    "JN-14-ratio",
    f"""WITH {TRAIN_SQL}, {pair_sql('train', 'test')}, a AS (SELECT qid, avg(dist) AS a FROM near WHERE pos <= 10 GROUP BY qid),
p2 AS (SELECT a.id AS qid, b.id AS rid, sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.x[k] - b.x[k]) ** 2))) AS dist FROM train a JOIN train b ON a.id <> b.id),
b AS (SELECT qid, avg(dist) AS b FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS pos FROM p2) WHERE pos <= 9 GROUP BY qid)
SELECT qid AS id, {d('-a / greatest(b, 1e-12)', 'likeness')} FROM a JOIN b USING (qid)""",
)
def jn_14_ratio(spark, sf):
    return Nb.test_likeness(train(spark, sf), test(spark, sf), 10, mode="ratio")
