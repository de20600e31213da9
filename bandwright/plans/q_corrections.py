"""COR and BLD: residual corrections and blends over stored predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import corrections as C
from ..operators import fits as Fi
from ..operators import folds as Cv
from ..operators import neighbours as Nb
from ..operators import solvers as So
from ..operators.moments import gram
from ..session import cut
from .fixtures import CAND_SQL, CENTRE_BAND, PAIR_SQL, RADIUS, TRAIN_SQL, candidates, pred_pair, spectra, test, train
from .q_arrays import unroll
from .q_fits import LOGO_SQL, TR_LONG_SQL
from .q_neighbours import CENT_SQL, pair_sql
from .q_stats import AVG_RANK
from .registry import d, i, query

# Rows for corrections: target y, prediction p, residual r, two branch signals and some scores.
BASE_SQL = PAIR_SQL + """,
base AS (SELECT id, grp, y_true AS y, y_pred AS p, y_true - y_pred AS r, 36000 - y_pred AS s1, 200000 * discount - 10000 AS s2,
  tax AS iso, discount AS det, id % 37 AS lab FROM pair)"""


def base(spark, sf):
    return pred_pair(spark, sf).select(
        "id", "grp", F.col("y_true").alias("y"), F.col("y_pred").alias("p"), F.expr("y_true - y_pred").alias("r"),
        F.expr("36000 - y_pred").alias("s1"), F.expr("200000D * discount - 10000").alias("s2"),
        F.col("tax").alias("iso"), F.col("discount").alias("det"), (F.col("id") % 37).alias("lab"),
    )


FULL_SQL = LOGO_SQL + """,
w AS (SELECT band, corr(v, y) AS c, regr_slope(y, v) AS b, regr_intercept(y, v) AS a FROM tb GROUP BY band),
top AS (SELECT * FROM w ORDER BY abs(c) DESC, band LIMIT 1), lim AS (SELECT min(y) AS lo, max(y) AS hi FROM train),
fb AS (SELECT fold, c.a, c.b, c.band FROM c JOIN top ON c.band = top.band),
fo AS (SELECT t.id, t.y, fb.a + fb.b * x[fb.band + 1] AS p FROM train t JOIN fb ON fold = grp),
ask AS (SELECT id, grp, x, y, a + b * x[band + 1] AS p FROM test, top)"""


def full_and_oof(spark, sf):
    """Best band on all train rows: its out-of-fold predictions by group, and its test predictions."""
    tr, te = train(spark, sf), test(spark, sf)
    band = Fi.choose_band(tr, "best")
    oof = Cv.out_of_fold(Cv.leave_one_group(tr), lambda g: So.one_band(g, band), name="p")
    b, a = Fi.fit_band(tr, band)
    return tr, oof, te.withColumn("p", F.lit(a) + F.get("x", F.lit(band)) * b)


@query(
    "COR-1",
    f"WITH {FULL_SQL} SELECT id, {d('greatest(least(p + (SELECT avg(y - p) FROM fo), hi), lo)', 'out_')} FROM ask, lim",
)
def cor_1(spark, sf):
    tr, oof, ask = full_and_oof(spark, sf)
    shift = C.intercept_shift(oof)
    return ask.select("id", C.blend(F.col("p"), F.col("p") + shift, 1.0, *Fi.y_range(tr)).alias("out_"))


@query(
    "COR-2",
    f"""WITH {FULL_SQL}, f AS (SELECT 1 + 0.1 * (regr_slope(y, p) - 1) AS sc, 0.1 * regr_intercept(y, p) AS sh FROM fo)
SELECT id, {d('sc * p + sh', 'out_')} FROM ask, f""",
)
def cor_2(spark, sf):
    _, oof, ask = full_and_oof(spark, sf)
    scale, shift = C.shrunk_affine(oof, 0.1)
    return ask.select("id", (F.col("p") * scale + shift).alias("out_"))


@query(
    "COR-3",
    f"""WITH {BASE_SQL}, f AS (SELECT regr_slope(y, p) AS b, regr_intercept(y, p) AS a FROM base),
e AS (SELECT id, p, greatest(least(0.1 * (a + b * p - p), 1000.0::DOUBLE), -1000.0::DOUBLE) AS dl FROM base, f)
SELECT id, {d('p + dl - (SELECT avg(dl) FROM e)', 'out_', 4)} FROM e""",
    digits=4,
)
def cor_3(spark, sf):
    df = base(spark, sf)
    return C.affine_delta(df, df, 0.1, 1000.0, name="out_").select("id", "out_")


def _bin_sql(stat: str) -> str:
    return f"""WITH {BASE_SQL}, q AS (SELECT quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.5) AS q2, quantile_cont(p, 0.75) AS q3 FROM base),
b AS (SELECT (p >= q1)::INT + (p >= q2)::INT + (p >= q3)::INT AS bin, p, r FROM base, q),
t AS (SELECT bin, avg(p) AS c, {stat} AS v FROM b GROUP BY bin), n AS (SELECT c AS x0, v AS y0, lead(c) OVER (ORDER BY c) AS x1, lead(v) OVER (ORDER BY c) AS y1 FROM t),
m AS (SELECT min(c) AS lo, max(c) AS hi, arg_min(v, c) AS vlo, arg_max(v, c) AS vhi FROM t)
SELECT id, {d('p + 0.5 * CASE WHEN p <= lo THEN vlo WHEN p >= hi THEN vhi ELSE (SELECT y0 + (p - x0) * (y1 - y0) / (x1 - x0) FROM n WHERE x0 <= p AND p < x1) END', 'out_', 4)} FROM base, m"""


@query("COR-4", _bin_sql("avg(r)"), digits=4)
def cor_4(spark, sf):
    df = base(spark, sf)
    return C.bin_correction(df, df, 4, 0.5, None, name="out_").select("id", "out_")


@query("COR-4-median", _bin_sql("median(r)"), digits=4)
def cor_4_median(spark, sf):
    df = base(spark, sf)
    return C.bin_correction(df, df, 4, 0.5, None, "median", name="out_").select("id", "out_")


@query(
    "COR-5",
    f"""WITH {BASE_SQL}, q AS (SELECT quantile_cont(p, 0.1) AS lo, quantile_cont(p, 0.8) AS hi, min(y) AS mn, max(y) AS mx, avg(y) AS my, avg(p) AS mp FROM base)
SELECT id, {d('CASE WHEN p < lo THEN lo + 1.15 * (p - lo) ELSE p END', 'low_', 4)}, {d('greatest(least(CASE WHEN p > hi THEN p + 0.25 * (p - hi) ELSE p END, mx), mn)', 'high_', 4)},
  {d('greatest(least(p + 0.15 * (my - mp), mx), mn)', 'shifted', 4)} FROM base, q""",
    digits=4,
)
def cor_5(spark, sf):
    df = base(spark, sf)
    lo, hi = Fi.y_range(df)
    mean = df.agg(F.avg("y")).first()[0]
    out = C.low_tail(df, df, 0.1, 1.15, name="low_")
    out = C.upper_tail(df, out, 0.8, 0.25, lo, hi, name="high_")
    return C.mean_shift(out, mean, 0.15, lo, hi, name="shifted").select("id", "low_", "high_", "shifted")


@query(
    "COR-6",
    f"""WITH {CENT_SQL}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_grp ORDER BY cosine DESC, train_grp) AS pos FROM cosine) WHERE pos = 1),
w AS (SELECT band, corr(v, y) AS c, regr_slope(y, v) AS b, regr_intercept(y, v) AS a FROM bands WHERE grp <= 6 GROUP BY band),
top AS (SELECT * FROM w ORDER BY abs(c) DESC, band LIMIT 1), lim AS (SELECT min(y) AS lo, max(y) AS hi FROM spectra WHERE grp <= 6),
res AS (SELECT grp, avg(y - a - b * x[band + 1]) AS bias FROM spectra, top WHERE grp <= 6 GROUP BY grp)
SELECT s.id, {d('greatest(least(a + b * x[band + 1] + bias, hi), lo)', 'out_')} FROM spectra s JOIN k ON s.grp = test_grp JOIN res ON res.grp = train_grp, top, lim""",
)
def cor_6(spark, sf):
    tr, te = train(spark, sf), test(spark, sf)
    band = Fi.choose_band(tr, "best")
    b, a = Fi.fit_band(tr, band)
    line = F.lit(a) + F.get("x", F.lit(band)) * b
    return C.nearest_group_bias(tr.withColumn("p", line), te.withColumn("p", line), name="out_").select("id", "out_")


@query(
    "COR-7",
    f"""WITH {TR_LONG_SQL}, s AS (SELECT band, 0.2 * (avg(CASE WHEN grp > 6 THEN v END) - avg(CASE WHEN grp <= 6 THEN v END)) AS s FROM bands GROUP BY band)
SELECT id, {i('band', 'k')}, {d('v - s', 'v')} FROM bands JOIN s USING (band) WHERE grp > 6""",
)
def cor_7(spark, sf):
    return unroll(C.align_means(train(spark, sf), test(spark, sf), 0.2))


BETA_SQL = "greatest(least(sum({s} * r) / sum({s} * {s}), 1), -1)"


def _clip(expr: str, c: float) -> str:
    return f"greatest(least({expr}, {c}::DOUBLE), -{c}::DOUBLE)"


@query(
    "COR-8",
    f"""WITH {BASE_SQL}, b AS (SELECT {BETA_SQL.format(s='s1')} AS beta FROM base), e AS (SELECT id, p, {_clip('0.5 * beta * s1', 3000.0)} AS dl FROM base, b)
SELECT id, {d('greatest(p + dl - (SELECT avg(dl) FROM e), 0)', 'out_', 4)} FROM e""",
    digits=4,
)
def cor_8(spark, sf):
    df = base(spark, sf)
    return C.distil(df, df, "s1", "r", 0.5, 3000.0, name="out_").select("id", "out_")


@query(
    "COR-9",
    f"""WITH {BASE_SQL}, b AS (SELECT {BETA_SQL.format(s='s1')} AS b1, {BETA_SQL.format(s='s2')} AS b2 FROM base),
e AS (SELECT id, p, {_clip(_clip('0.5 * b1 * s1', 3000.0) + ' + ' + _clip('0.3 * b2 * s2', 2000.0), 3500.0)} AS dl FROM base, b)
SELECT id, {d('greatest(p + dl - (SELECT avg(dl) FROM e), 0)', 'out_', 4)} FROM e""",
    digits=4,
)
def cor_9(spark, sf):
    df = base(spark, sf)
    return C.distil_two(df, df, ("s1", 0.5, 3000.0), ("s2", 0.3, 2000.0), "r", 3500.0, name="out_").select("id", "out_")


@query(
    "COR-10",
    f"""WITH {BASE_SQL}, q AS (SELECT quantile_cont(p, 0.5) AS h, quantile_cont(abs(s1), 0.6) AS dg FROM base),
g AS (SELECT base.*, p >= h AND abs(s1) >= dg AS gate FROM base, q),
l AS (SELECT *, gate AND row_number() OVER (PARTITION BY gate ORDER BY p DESC, id DESC) <= CAST(floor((SELECT count(*) FROM base) * 0.1) AS BIGINT) AS kept FROM g),
b AS (SELECT greatest(sum(s1 * r) / sum(s1 * s1), 0) AS beta FROM l WHERE kept)
SELECT id, {d('greatest(p + CASE WHEN kept THEN ' + _clip('0.5 * beta * s1', 3000.0) + ' ELSE 0 END, 0)', 'out_', 4)} FROM l, b""",
    digits=4,
)
def cor_10(spark, sf):
    df = cut(base(spark, sf).select("id", "p", "r", "s1", "iso"))
    gates = C.gate_columns(df, "p", "s1", "iso", 0.5, 0.6, 0.5)
    return C.gated_correction(df, gates["high_disagree"], "p", "s1", "r", 0.5, 3000.0, 0.1, name="out_").select("id", "out_")


def _pct(v: str) -> str:
    return f"(({AVG_RANK.format(k='PARTITION BY 1', v=v)}) / count(*) OVER ())"


@query(
    "COR-11",
    f"""WITH {BASE_SQL}, k AS (SELECT *, abs(s1) AS a1 FROM base) SELECT id, {d(f"{_pct('det')} * {_pct('iso')} * {_pct('a1')}", 'score')} FROM k""",
)
def cor_11(spark, sf):
    df = base(spark, sf).select("id", "s1", F.col("det").alias("hard"), F.col("iso").alias("pos"))
    return C.gate_score(df, "hard_pos_impact", "s1").select("id", "score")


@query(
    "COR-12",
    f"""WITH {BASE_SQL}, n AS (SELECT count(*) AS n FROM base), b AS (SELECT {BETA_SQL.format(s='s1')} AS beta FROM base),
dg AS (SELECT *, row_number() OVER (ORDER BY det DESC, id DESC) <= CAST(round_even(n * 0.4, 0) AS BIGINT) AS dgate FROM base, n),
sc AS (SELECT *, CASE WHEN dgate THEN greatest(s1, 0) ELSE 0 END AS sc FROM dg),
l AS (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY sc DESC, id DESC) AS lr FROM sc),
g AS (SELECT *, row_number() OVER (ORDER BY (lr > 4)::INT, sc DESC, id DESC) <= CAST(round_even(n * 0.003, 0) AS BIGINT) AS gate FROM l),
c AS (SELECT id, r, gate, {_clip('0.5 * beta * s1', 4000.0)} AS raw FROM g, b),
m AS (SELECT avg(raw) AS m, coalesce(covar_pop(raw, r), 0) AS cv FROM c WHERE gate)
SELECT id, {d('(raw - m) * CASE WHEN cv < 0 THEN -1 ELSE 1 END', 'corr', 4)} FROM c, m WHERE gate""",
    digits=4,
)
def cor_12(spark, sf):
    df = cut(base(spark, sf).select("id", "r", "s1", "lab", "det"))
    out = C.capped_candidate(df, "s1", "r", "positive_signal_det40_cluster4", 0.003, 0.5, 4000.0, "lab", "det")
    return out.where("gate").select("id", "corr")


@query(
    "COR-13",
    f"""WITH {BASE_SQL}, b AS (SELECT {BETA_SQL.format(s='s1')} AS b1, {BETA_SQL.format(s='s2')} AS b2 FROM base),
w AS (SELECT id, r, det, (b1 * s1 + b2 * s2) / 2 * abs((sign(b1 * s1) + sign(b2 * s2)) / 2) AS raw FROM base, b),
a AS (SELECT *, abs(raw) AS ar FROM w),
k AS (SELECT id, r, {_clip(f"0.5 * raw * pow({_pct('ar')}, 2) * {_pct('det')}", 3000.0)} AS c FROM a),
ce AS (SELECT id, r, c - avg(c) OVER () AS c FROM k), sg AS (SELECT covar_pop(c, r) AS cv FROM ce WHERE abs(c) > 0.002)
SELECT id, {d('c * CASE WHEN cv < 0 THEN -1 ELSE 1 END', 'corr', 4)} FROM ce, sg""",
    digits=4,
)
def cor_13(spark, sf):
    df = cut(base(spark, sf).select("id", "r", "s1", "s2", "det"))
    return C.soft_correction(df, ["s1", "s2"], "r", 0.5, 3000.0, 2.0, "det", 1.0, agree=True).select("id", "corr")


@query(
    "COR-14",
    f"""WITH {TRAIN_SQL}, {pair_sql('test', 'train')}
SELECT qid AS id, {d('sum((ry - 60) / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6))', 'mean_')}, {d('median(ry - 60)', 'median_')}
FROM near WHERE pos <= 12 GROUP BY qid""",
)
def cor_14(spark, sf):
    tr = train(spark, sf).withColumn("r", F.col("y") - 60)
    te = test(spark, sf)
    a = C.local_residual(tr, te, 12, "mean", name="mean_")
    return a.join(C.local_residual(tr, te, 12, "median", name="median_"), "id")


@query("COR-14-local")
def cor_14_local(spark, sf):
    tr = train(spark, sf).withColumn("r", F.col("y") - 60)
    return C.local_residual(tr, test(spark, sf), 40, "pls")


@query("COR-15")
def cor_15(spark, sf):
    tr = train(spark, sf).withColumn("r", F.col("y") - 60)
    return C.cluster_bias(tr, test(spark, sf), 5, 0.5, 3.0).select("id", "cluster", "corr")


@query(
    "COR-16",
    f"""WITH {BASE_SQL}, k AS (SELECT *, abs(s1) AS a1 FROM base)
SELECT id, {d(f"pow(det * 10, 0.5) * pow({_pct('a1')}, 2) * pow(1 - iso * 10, 1.5) * {_pct('det')}", 'score')} FROM k""",
)
def cor_16(spark, sf):
    df = base(spark, sf).select("id", "s1", "det", "iso").withColumn("prox", F.col("det") * 10).withColumn("failed", F.col("iso") * 10)
    return C.region_score(df, "prox", "s1", 0.5, 2.0, "failed", "det").select("id", "score")


@query(
    "COR-17",
    f"""WITH {CAND_SQL}, dd AS (SELECT id, pred - anchor AS df FROM cand),
v AS (SELECT id, sum((df > 1e-12)::INT) AS up, sum((df < -1e-12)::INT) AS dn, median(df) FILTER (df > 0) AS mu, median(df) FILTER (df < 0) AS md, count(*) AS n FROM dd GROUP BY id),
s AS (SELECT id, coalesce(CASE WHEN up >= dn THEN mu ELSE md END, 0) AS sg, greatest(up, dn) AS ag, n FROM v),
k AS (SELECT *, row_number() OVER (ORDER BY abs(sg) * ag / n DESC, id) AS rn FROM s WHERE ag >= 3)
SELECT id, {d('sg', 'signal', 4)}, {i('ag', 'agree')}, {d('abs(sg) * ag / n', 'score', 4)}, {d(_clip('0.5 * sg', 400.0), 'corr', 4)} FROM k WHERE rn <= 500""",
    digits=4,
)
def cor_17(spark, sf):
    long = candidates(spark, sf).select("candidate", "id", F.expr("pred - anchor").alias("diff"))
    return C.vote_blend(long, 3, 500, 0.5, 400.0)


@query(
    "COR-18",
    f"WITH {CAND_SQL} SELECT candidate, id, {d('pred + 0.35 * (pred - anchor)', 'out_', 4)} FROM cand",
    digits=4,
)
def cor_18(spark, sf):
    return candidates(spark, sf).select("candidate", "id", C.continuation(F.col("anchor"), F.col("pred"), 0.35).alias("out_"))


@query(
    "BLD-1",
    f"WITH {CAND_SQL} SELECT candidate, id, {d('greatest(anchor + -0.4 * (pred - anchor), 0)', 'out_', 4)} FROM cand",
    digits=4,
)
def bld_1(spark, sf):
    return candidates(spark, sf).select("candidate", "id", C.blend(F.col("anchor"), F.col("pred"), -0.4, 0.0).alias("out_"))


@query(
    "BLD-2",
    f"""WITH {CAND_SQL} SELECT id, {d('avg(pred)', 'plain', 4)}, {d("sum(pred * length(candidate)) / sum(length(candidate))", 'weighted', 4)} FROM cand GROUP BY id""",
    digits=4,
)
def bld_2(spark, sf):
    long = candidates(spark, sf).withColumn("w", F.length("candidate").cast("double"))
    return C.means_of_variants(long, {"plain": None, "weighted": "w"})
