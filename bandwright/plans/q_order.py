"""WIN and TOP: order inside groups, monotone post-processing, top-k and gated selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups as G
from ..operators import monotone as Mo
from ..operators import select as P
from ..operators.ordered import ordinal, percent_rank, quantile_values, rank_position
from ..session import cut
from .fixtures import (
    CAND_SQL, LONG_SQL, PAIR_SQL, RUNS_SQL, SEQ_SQL, SPECTRA_SQL, TRAIN_SQL, candidates, events_seq, pred_pair,
    runs, spectra, train,
)
from .q_stats import AVG_RANK, PIVOT_SQL, SCAN_SQL, scan, wide
from .registry import d, i, query

# ---- WIN -------------------------------------------------------------------------------


@query(
    "WIN-1",
    f"""WITH {SEQ_SQL}
SELECT id, {d('(seq - 1) / greatest(count(*) OVER (PARTITION BY grp) - 1, 1)', 'rank_pos')},
  {d('(id - min(id) OVER w) / greatest(max(id) OVER w - min(id) OVER w, 1)', 'seq_pos')} FROM seqs WINDOW w AS (PARTITION BY grp)""",
)
def win_1(spark, sf):
    from ..operators.ordered import group_position

    df = rank_position(events_seq(spark, sf), ["grp"], ["ts", "id"], "rank_pos")
    return group_position(df, "grp", "id", "seq_pos").select("id", "rank_pos", "seq_pos")


@query(
    "WIN-2",
    f"""WITH {PAIR_SQL}
SELECT id, {d(f"({AVG_RANK.format(k='PARTITION BY 1', v='y_pred')}) / count(*) OVER ()", 'p')} FROM pair""",
)
def win_2(spark, sf):
    return percent_rank(pred_pair(spark, sf), "y_pred", "id", "p").select("id", "p")


@query(
    "WIN-2-ordinal",
    f"""WITH {PAIR_SQL}
SELECT id, {d("(row_number() OVER (PARTITION BY grp ORDER BY y_pred, id) - 1) / (count(*) OVER (PARTITION BY grp) - 1)", 'p')} FROM pair""",
)
def win_2_ordinal(spark, sf):
    return percent_rank(pred_pair(spark, sf), "y_pred", "id", "p", "ordinal", ["grp"]).select("id", "p")


@query(
    "WIN-2-minmax",
    f"WITH {PAIR_SQL} SELECT id, {d('(y_pred - min(y_pred) OVER ()) / (max(y_pred) OVER () - min(y_pred) OVER ())', 'p')} FROM pair",
)
def win_2_minmax(spark, sf):
    return percent_rank(pred_pair(spark, sf), "y_pred", "id", "p", "minmax").select("id", "p")


@query(
    "WIN-3",
    f"""WITH {SEQ_SQL}, l AS (SELECT grp, value - lag(value) OVER (PARTITION BY grp ORDER BY seq) AS delta FROM seqs)
SELECT grp, {i('count(*)', 'n')}, {i('sum((coalesce(delta, 0) < 0)::INT)', 'falls')}, {i('sum((coalesce(delta, 0) > 0)::INT)', 'rises')} FROM l GROUP BY grp""",
)
def win_3(spark, sf):
    return Mo.violations(events_seq(spark, sf), "grp", ["ts", "id"], "value")


@query(
    "WIN-4",
    f"""WITH {SEQ_SQL}, v AS (SELECT grp, value AS given, row_number() OVER (PARTITION BY grp ORDER BY value DESC, id) AS seq FROM seqs)
SELECT id, {d('given', 'given')} FROM seqs JOIN v USING (grp, seq)""",
)
def win_4(spark, sf):
    return Mo.sorted_by_group(events_seq(spark, sf), "grp", ["ts", "id"], "value", "id", "given").select("id", "given")


@query(
    "WIN-5",
    f"""WITH {SEQ_SQL}, v AS (SELECT grp, value AS given, row_number() OVER (PARTITION BY grp ORDER BY value, id) AS seq FROM seqs)
SELECT id, {d('0.9 * value + 0.1 * given', 'p')} FROM seqs JOIN v USING (grp, seq)""",
)
def win_5(spark, sf):
    df = Mo.sorted_by_group(events_seq(spark, sf), "grp", ["ts", "id"], "value", "id", "given", increasing=True)
    return df.select("id", Mo.soft("value", "given", 0.1).alias("p"))


def iso_sql(value: str) -> str:
    """Falling fit by the min-max formula over all runs of a group."""
    return f"""cs AS (SELECT grp, seq, id, {value} AS v, sum({value}) OVER (PARTITION BY grp ORDER BY seq) AS c FROM seqs),
runs_ AS (SELECT a.grp, a.seq AS j, b.seq AS k, (b.c - a.c + a.v) / (b.seq - a.seq + 1) AS m FROM cs a JOIN cs b ON a.grp = b.grp AND b.seq >= a.seq),
top AS (SELECT r.grp, r.j, r.k AS i, max(r.m) OVER (PARTITION BY r.grp, r.j ORDER BY r.k DESC) AS m FROM runs_ r),
iso AS (SELECT grp, i AS seq, min(m) AS fit FROM top WHERE j <= i GROUP BY grp, i)"""


@query("WIN-6", f"WITH {SEQ_SQL}, {iso_sql('value')} SELECT id, {d('fit', 'fit', 9)} FROM iso JOIN cs USING (grp, seq)", digits=9)
def win_6(spark, sf):
    return Mo.isotonic_by_group(events_seq(spark, sf), "grp", ["ts", "id"], "value", "fit").select("id", "fit")


@query(
    "WIN-7",
    f"""WITH {SEQ_SQL}, {iso_sql('CAST(id % 97 AS DOUBLE)')},
srt AS (SELECT grp, id % 97 AS p, row_number() OVER (PARTITION BY grp ORDER BY id % 97 DESC, id) AS seq FROM seqs),
a AS (SELECT 'base' AS variant, grp, value AS t, CAST(id % 97 AS DOUBLE) AS p FROM seqs
  UNION ALL SELECT 'isotonic', s.grp, value, fit FROM seqs s JOIN iso USING (grp, seq)
  UNION ALL SELECT 'sorted', s.grp, value, srt.p FROM seqs s JOIN srt USING (grp, seq)),
g AS (SELECT variant, grp, sqrt(avg((p - t) ** 2)) AS r, row_number() OVER (PARTITION BY variant ORDER BY sqrt(avg((p - t) ** 2)) DESC, grp) AS rn FROM a GROUP BY variant, grp)
SELECT a.variant, {d('sqrt(avg((p - t) ** 2))', 'rmse')}, {d('avg(abs(p - t))', 'mae')}, {d('avg(p - t)', 'bias')}, any_value(g.grp) AS worst_group,
  {d('any_value(g.r)', 'worst_rmse')} FROM a JOIN g ON a.variant = g.variant AND rn = 1 GROUP BY a.variant""",
)
def win_7(spark, sf):
    """Base prediction against its monotone and its sorted version."""
    df = events_seq(spark, sf).withColumn("base", (F.col("id") % 97).cast("double"))
    df = Mo.isotonic_by_group(df, "grp", ["ts", "id"], "base", "isotonic")
    df = Mo.sorted_by_group(df, "grp", ["ts", "id"], "base", "id", "sorted")
    long = df.select(
        "grp",
        F.col("value").alias("y_true"),
        F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("y_pred")) for v in ("base", "isotonic", "sorted")])).alias("s"),
    ).select("grp", "y_true", "s.variant", "s.y_pred")
    long = cut(long)
    whole = long.groupBy("variant").agg(
        *[c for c in G.metric_aggs()[1:3]], F.avg(G.err()).alias("bias")
    )
    worst = G.worst_group(long, ["variant"]).drop("worst_bias")
    return whole.join(worst, "variant")


@query("WIN-8")
def win_8(spark, sf):
    """Group curve template on event sequences; odd users fit the curve, even users receive it."""
    df = rank_position(events_seq(spark, sf), ["grp"], ["ts", "id"], "position")
    df = cut(df.withColumn("base", F.lit(20.0) + (F.col("id") % 31)))
    fit = df.where("grp % 2 = 1")
    edge = fit.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    curve, mid, upper = Mo.fit_curve(fit, "grp", "position", "value")
    curve = cut(curve)
    out = Mo.curve_template(
        df.where("grp % 2 = 0"), curve, (mid, upper), (edge["lo"], edge["hi"]), "grp", "position", "base", "id", "upper_anchor"
    )
    return out.select("id", "grp", "position", "pred")


# ---- TOP: bands ------------------------------------------------------------------------


@query(
    "TOP-1",
    f"""WITH {LONG_SQL}, c AS (SELECT band, corr(v, y) AS c FROM bands WHERE grp <= 6 GROUP BY band),
r AS (SELECT *, row_number() OVER (ORDER BY abs(c) DESC, band DESC) AS pos FROM c)
SELECT band, {d('c', 'corr')}, {i('pos', 'pos')} FROM r WHERE pos <= 8""",
)
def top_1(spark, sf):
    return P.top_bands(G.band_correlation(train(spark, sf)), 8).select("band", "corr", "pos")


@query(
    "TOP-2",
    f"""WITH {LONG_SQL}, ch AS (SELECT unnest(range(5)) AS chunk),
c AS (SELECT chunk, band, corr(v, y) AS c FROM bands JOIN ch ON id % 5 <> chunk WHERE grp <= 6 GROUP BY chunk, band),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY abs(c) DESC, band DESC) AS pos FROM c),
v AS (SELECT band, sum(1.0 / pos) AS votes FROM r WHERE pos <= 18 GROUP BY band)
SELECT band, {d('votes', 'votes')} FROM v ORDER BY votes DESC, band LIMIT 6""",
)
def top_2(spark, sf):
    return P.stable_top_bands(train(spark, sf), 6, "id").select("band", "votes")


@query(
    "TOP-3",
    f"""WITH {LONG_SQL}, q AS (SELECT quantile_cont(y, 0.25) AS lo, quantile_cont(y, 0.75) AS hi FROM spectra WHERE grp <= 6)
SELECT band, {d('abs(avg(CASE WHEN y >= hi THEN v END) - avg(CASE WHEN y <= lo THEN v END))', 'contrast')} FROM bands, q WHERE grp <= 6 GROUP BY band""",
)
def top_3(spark, sf):
    df = train(spark, sf)
    lo, hi = quantile_values(df, "y", [0.25, 0.75])
    return P.quartile_contrast(df, lo, hi)


# ---- TOP: rows -------------------------------------------------------------------------

# Row scores for the gates: the error as score, order priority as label.
SCORED_SQL = PAIR_SQL + """,
scored AS (SELECT id, grp, y_pred - y_true AS signal, abs(y_pred - y_true) AS score, y_true - 36000 AS residual, id % 37 AS label FROM pair)"""


def scored(spark, sf):
    return pred_pair(spark, sf).select(
        "id", "grp", F.expr("y_pred - y_true").alias("signal"), F.expr("abs(y_pred - y_true)").alias("score"),
        F.expr("y_true - 36000").alias("residual"), (F.col("id") % 37).alias("label"),
    )


def _size(frac: float) -> str:
    return f"greatest(1, CAST(round_even((SELECT count(*) FROM scored) * {frac}, 0) AS BIGINT))"


@query(
    "TOP-4",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS rn FROM scored)
SELECT id, {d('score', 'score', 4)} FROM r WHERE rn <= {_size(0.05)}""",
    digits=4,
)
def top_4(spark, sf):
    return P.top_fraction(scored(spark, sf), "score", "id", 0.05).where("gate").select("id", "score")


@query(
    "TOP-5",
    f"""WITH {SCORED_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id DESC) AS lr FROM scored),
r AS (SELECT *, row_number() OVER (ORDER BY (lr > 40)::INT, score DESC, id DESC) AS rn FROM l)
SELECT label, {i('count(*)', 'n')}, {d('sum(score)', 'total', 2)} FROM r WHERE rn <= {_size(0.05)} GROUP BY label""",
    digits=2,
)
def top_5(spark, sf):
    gated = P.capped_top_fraction(scored(spark, sf), "score", "id", "label", 0.05, 40).where("gate")
    return gated.groupBy("label").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query(
    "TOP-6",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id DESC) AS lr FROM scored WHERE residual > 0)
SELECT id, {i('label', 'label')} FROM r WHERE lr <= 12""",
)
def top_6(spark, sf):
    df = scored(spark, sf).withColumn("gate", F.col("residual") > 0)
    return P.cap_gate(df, "gate", "signal", "id", "label", 12).where("capped").select("id", "label")


@query(
    "TOP-7",
    f"""WITH {SCAN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY view, ((win_start + win_end) // 2) // 10 ORDER BY usable DESC, win_start, win_end) AS rn FROM scan)
SELECT view, {i('win_start', 'win_start')}, {i('win_end', 'win_end')}, {d('usable', 'usable')} FROM r WHERE rn = 1""",
)
def top_7(spark, sf):
    """One best window per view and centre bucket of ten bands."""
    df = scan(spark, sf).withColumn("bucket", F.floor(F.floor((F.col("win_start") + F.col("win_end")) / 2) / 10))
    return P.one_per_bucket(df, ["view", "bucket"], "usable", ["win_start", "win_end"], 1).select("view", "win_start", "win_end", "usable")


@query(
    "TOP-8",
    f"""WITH {RUNS_SQL}, s AS (SELECT experiment, strategy, avg(mean_score) AS s FROM runs GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY s, experiment) AS rn FROM s)
SELECT strategy AS family, experiment, {d('s', 'score')} FROM r WHERE rn <= 3""",
)
def top_8(spark, sf):
    per = runs(spark, sf).groupBy("experiment", F.col("strategy").alias("family")).agg(F.avg("mean_score").alias("score"))
    ranked = P.one_per_bucket(per.withColumn("k", -F.col("score")), ["family"], "k", ["experiment"], 3)
    return ranked.select("family", "experiment", "score")


CLIP = "greatest(least(0.2 * signal, 5000.0::DOUBLE), -5000.0::DOUBLE)"


@query(
    "TOP-9",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY signal DESC, id DESC) AS rp, row_number() OVER (ORDER BY signal, id) AS rn FROM scored),
e AS (SELECT greatest(1, CAST(round_even(count(*) * 0.1 / 2, 0) AS BIGINT)) AS k FROM scored),
c AS (SELECT id, {CLIP} AS c FROM r, e WHERE (rp <= k AND signal > 0) OR (rn <= k AND signal < 0))
SELECT id, {d('c - (SELECT avg(c) FROM c)', 'corr', 4)} FROM c""",
    digits=4,
)
def top_9(spark, sf):
    return P.balanced_selection(scored(spark, sf), "signal", "id", 0.1, 0.2, 5000).where("corr <> 0").select("id", "corr")


@query(
    "TOP-10",
    f"""WITH {SCORED_SQL}, e AS (SELECT *, CASE WHEN id % 11 = 0 THEN 0 WHEN signal > 0 AND residual > 0 THEN signal * abs(residual) ELSE 0 END AS up,
  CASE WHEN id % 11 = 0 THEN 0 WHEN signal < 0 AND residual < 0 THEN -signal * abs(residual) ELSE 0 END AS down FROM scored),
u AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY up DESC, id DESC) AS lr FROM e WHERE up > 0),
v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY down DESC, id DESC) AS lr FROM e WHERE down > 0),
uu AS (SELECT id, signal, row_number() OVER (ORDER BY up DESC, id DESC) AS rn FROM u WHERE lr <= 30),
vv AS (SELECT id, signal, row_number() OVER (ORDER BY down DESC, id DESC) AS rn FROM v WHERE lr <= 30),
k AS (SELECT {_size(0.01)} AS a), c AS (SELECT id, {CLIP} AS c FROM uu, k WHERE rn <= a
  UNION ALL SELECT id, {CLIP} FROM vv, k WHERE rn <= CAST(round_even(a * 0.5, 0) AS BIGINT))
SELECT id, {d('c - (SELECT avg(c) FROM c)', 'corr', 4)} FROM c""",
    digits=4,
)
def top_10(spark, sf):
    out = P.asymmetric_selection(
        scored(spark, sf), "signal", "id", "label", 30, 0.01, 0.5, 0.2, 5000, "residual", F.col("id") % 11 == 0
    )
    return out.where("corr <> 0").select("id", "corr")


@query(
    "TOP-11",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id DESC) AS lr FROM scored)
SELECT id, {d('signal * least(1, pow(20.0 / lr, 0.5))', 'damped', 4)} FROM r""",
    digits=4,
)
def top_11(spark, sf):
    return P.damp_large(scored(spark, sf), "signal", "id", "label", 20, 0.5).select("id", "damped")


@query(
    "TOP-12",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS rn, row_number() OVER (PARTITION BY label ORDER BY score DESC, id DESC) AS lr FROM scored),
k AS (SELECT *, rn <= least((SELECT count(*) FROM scored), greatest(60, {_size(0.001)})) AS keep FROM r),
h AS (SELECT *, sum(keep::INT) OVER (PARTITION BY label) AS have FROM k)
SELECT id, {i('label', 'label')} FROM h WHERE keep OR lr <= 3 - have""",
)
def top_12(spark, sf):
    return P.keep_set(scored(spark, sf), "score", "id", "label", 0.001, 60).where("keep").select("id", "label")


@query(
    "TOP-13",
    f"""WITH {PIVOT_SQL}, a AS (SELECT id FROM wide ORDER BY abs(da) DESC, id DESC LIMIT 200), b AS (SELECT id FROM wide ORDER BY abs(db) DESC, id DESC LIMIT 200)
SELECT {d('count(*) / 200', 'overlap')} FROM a JOIN b USING (id)""",
)
def top_13(spark, sf):
    return P.top_overlap(wide(spark, sf), "da", "db", "id", 200)


@query("TOP-14")
def top_14(spark, sf):
    """First eight rows of the max-min order."""
    df = spectra(spark, sf)
    chosen = P.farthest_points(df, 8)
    place = F.create_map(*[v for k, c in enumerate(chosen) for v in (F.lit(c), F.lit(k + 1))])
    return df.where(F.col("id").isin(chosen)).select("id", place[F.col("id")].alias("pos"))


@query(
    "TOP-15",
    f"""WITH {SCORED_SQL}, q AS (SELECT quantile_cont(score, 0.4) AS lo, quantile_cont(score, 0.78) AS hi FROM scored),
r AS (SELECT label, CASE WHEN score >= hi THEN 3 WHEN score >= lo THEN 2 ELSE 1 END AS n FROM scored, q)
SELECT {i('label', 'label')}, {i('sum(n)', 'n')} FROM r GROUP BY label""",
)
def top_15(spark, sf):
    df = scored(spark, sf)
    lo, hi = quantile_values(df, "score", [0.4, 0.78])
    return P.replicate(df, "score", lo, hi).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "TOP-16",
    f"""WITH {SCAN_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY usable DESC, win_start, win_end) AS rn,
  row_number() OVER (PARTITION BY abs((win_start + win_end) // 2 - 31) <= 8 ORDER BY usable DESC, win_start, win_end) AS nn FROM scan)
SELECT 'top_usable8' AS set_name, {i('rn', 'pos')}, {i('win_start', 'win_start')}, {i('win_end', 'win_end')} FROM r WHERE rn <= 8
UNION ALL SELECT 'top_usable16', rn, win_start, win_end FROM r WHERE rn <= 16
UNION ALL SELECT 'near_centre6', nn, win_start, win_end FROM r WHERE nn <= 6 AND abs((win_start + win_end) // 2 - 31) <= 8""",
)
def top_16(spark, sf):
    """Named feature sets out of the scored windows."""
    df = cut(scan(spark, sf))
    near = F.abs(F.floor((F.col("win_start") + F.col("win_end")) / 2) - 31) <= 8

    def best(part, k, name):
        top = P.one_per_bucket(part.withColumn("all", F.lit(0)), ["all"], "usable", ["win_start", "win_end"], k)
        return top.select(F.lit(name).alias("set_name"), "pos", "win_start", "win_end")

    return best(df, 8, "top_usable8").unionByName(best(df, 16, "top_usable16")).unionByName(best(df.where(near), 6, "near_centre6"))


@query(
    "TOP-17",
    f"""WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY CASE WHEN strategy = 'click' THEN mean_score / 2 END NULLS LAST, mean_score, run_id) AS rn FROM runs)
SELECT experiment, run_id, {d("CASE WHEN strategy = 'click' THEN mean_score / 2 END", 'composite')}, {d('mean_score', 'mean_score')} FROM r WHERE rn = 1""",
)
def top_17(spark, sf):
    """Best run per experiment: composite first, rows without one last."""
    df = runs(spark, sf).withColumn("composite", F.when(F.col("strategy") == "click", F.col("mean_score") / 2))
    key = F.struct(F.col("composite").isNull().alias("a"), "composite", "mean_score", "run_id")
    best = df.groupBy("experiment").agg(F.min_by(F.struct("run_id", "composite", "mean_score"), key).alias("b"))
    return best.select("experiment", "b.*").orderBy(F.col("composite").asc_nulls_last(), "mean_score", "run_id")
