"""FLT, JN-1/2, SET, FN and AGG: filters, alignment, set operations, scalar functions, group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import scalars as S
from ..operators import groups as G
from ..operators import moments as M
from ..operators import select as P
from ..operators import sets as U
from ..operators.ordered import quantile_values, with_stats
from .fixtures import (
    ANCHOR_BANDS, CAND_SQL, LONG_SQL, N_BANDS, PAIR_SQL, RUNS_SQL, SEQ_SQL, SPECTRA_SQL, TRAIN_SQL,
    candidates, events_seq, long_bands, pred_pair, runs, spectra, table, test, train,
)
from .registry import d, i, query

# ---- FLT -------------------------------------------------------------------------------


@query("FLT-1", f"WITH {SPECTRA_SQL} SELECT id, grp FROM spectra WHERE grp <> 7")
def flt_1(spark, sf):
    return spectra(spark, sf).where(F.col("grp") != 7).select("id", "grp")


@query(
    "FLT-2",
    f"""WITH {PAIR_SQL}, e AS (SELECT *, abs(y_pred - y_true) AS e FROM pair)
SELECT id, {d('e', 'e')} FROM e WHERE e >= (SELECT quantile_cont(e, 0.8) FROM e)""",
)
def flt_2(spark, sf):
    df = pred_pair(spark, sf).withColumn("e", F.abs(G.err()))
    edge = quantile_values(df, "e", [0.8])[0]
    return df.where(F.col("e") >= edge).select("id", "e")


@query(
    "FLT-3",
    f"""WITH {PAIR_SQL}, e AS (SELECT *, abs(y_pred - y_true) AS e FROM pair)
SELECT grp, {i('count(*)', 'kept')} FROM e
WHERE NOT (e >= (SELECT quantile_cont(e, 0.9) FROM e) AND y_pred >= (SELECT quantile_cont(y_pred, 0.9) FROM e))
GROUP BY grp""",
)
def flt_3(spark, sf):
    """Trim rows in the residual tail and the leverage tail at once."""
    df = pred_pair(spark, sf).withColumn("e", F.abs(G.err()))
    (qe,), (ql,) = quantile_values(df, "e", [0.9]), quantile_values(df, "y_pred", [0.9])
    trimmed = (F.col("e") >= qe) & (F.col("y_pred") >= ql)
    return df.where(~trimmed).groupBy("grp").agg(F.count("*").alias("kept"))


DENIED = ("promo", "brass", "steel")


@query(
    "FLT-4",
    """SELECT p_partkey, p_type FROM part WHERE NOT ("""
    + " OR ".join(f"contains(lower(p_name || ' ' || p_type), '{t}')" for t in DENIED)
    + ")",
)
def flt_4(spark, sf):
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    denied = text.rlike("|".join(DENIED))
    return table(spark, sf, "part").where(~denied).select("p_partkey", "p_type")


@query(
    "FLT-5",
    f"""WITH {LONG_SQL}, g AS (SELECT grp FROM spectra GROUP BY grp HAVING count(*) >= 45)
SELECT grp, band, {i('count(*)', 'n')}, {d('var_samp(v)', 'variance')} FROM bands WHERE grp IN (SELECT grp FROM g)
GROUP BY grp, band HAVING var_samp(v) >= 1e-6""",
)
def flt_5(spark, sf):
    long = long_bands(spectra(spark, sf), "grp")
    per = long.groupBy("grp", "band").agg(F.count("*").alias("n"), F.var_samp("v").alias("variance"))
    return per.where((F.col("n") >= 45) & (F.col("variance") >= 1e-6))


@query(
    "FLT-6",
    f"""SELECT {i('l_orderkey * 10 + l_linenumber', 'id')},
  {d("CASE WHEN isinf(pow(l_discount, -1)) THEN 25 ELSE pow(l_discount, -1) END", 'p')} FROM lineitem""",
)
def flt_6(spark, sf):
    p = F.pow("l_discount", F.lit(-1.0))
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), S.finite_or(p, F.lit(25.0)).alias("p")
    )


@query(
    "FLT-7",
    f"""WITH {TRAIN_SQL}
SELECT id, {d('greatest(least(30 + 60 * x[6], (SELECT max(y) FROM train)), (SELECT min(y) FROM train))', 'p')} FROM test""",
)
def flt_7(spark, sf):
    edge = train(spark, sf).agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    p = F.get("x", F.lit(5)) * 60 + 30
    return test(spark, sf).select("id", S.clip(p, edge["lo"], edge["hi"]).alias("p"))


# ---- JN-1, JN-2, SET -------------------------------------------------------------------


def _one(spark, sf, name):
    return candidates(spark, sf).where(F.col("candidate") == name).select("id", F.col("pred").alias(name))


@query(
    "JN-1",
    f"""WITH {PAIR_SQL}
SELECT id, {d("(y_pred * 0.98::DOUBLE + 100) - y_pred", 'diff')} FROM pair""",
)
def jn_1(spark, sf):
    both = U.align(_one(spark, sf, "same"), _one(spark, sf, "both"))
    return both.select("id", (F.col("both") - F.col("same")).alias("diff"))


@query(
    "JN-2",
    f"""WITH m AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT coalesce(o_orderpriority, '') AS grp, {i('count(*)', 'n')}, {d('avg(l_quantity)', 'mean_pred')}
FROM lineitem LEFT JOIN m ON l_orderkey = o_orderkey GROUP BY 1""",
)
def jn_2(spark, sf):
    meta = table(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("grp")
    )
    pred = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("pred"))
    return U.attach_group(pred, meta, "key", "grp").groupBy("grp").agg(
        F.count("*").alias("n"), F.avg("pred").alias("mean_pred")
    )


@query(
    "SET-1",
    f"""WITH {TRAIN_SQL}, a AS (SELECT *, 'train' AS domain FROM train UNION ALL SELECT *, 'test' FROM test)
SELECT domain, {i('count(*)', 'n')}, {i('count(DISTINCT grp)', 'groups')} FROM a GROUP BY domain""",
)
def set_1(spark, sf):
    both = U.stack_domains(train(spark, sf), test(spark, sf))
    return both.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("groups"))


@query(
    "SET-2",
    """WITH a AS (SELECT DISTINCT o_orderkey AS id FROM orders), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem)
SELECT id, 'left' AS side FROM (SELECT id FROM a EXCEPT ALL SELECT id FROM b)
UNION ALL SELECT id, 'right' AS side FROM (SELECT id FROM b EXCEPT ALL SELECT id FROM a)""",
)
def set_2(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).distinct()
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return U.unmatched(a, b)


PIVOT_SQL = CAND_SQL + """,
wide AS (SELECT id, max(y_true) AS y_true, max(grp) AS grp, max(anchor) AS anchor,
  max(CASE WHEN candidate = 'both' THEN pred - anchor END) AS da,
  max(CASE WHEN candidate = 'group_a' THEN pred - anchor END) AS db FROM cand GROUP BY id)"""


def wide(spark, sf):
    """One row per id with the changes of two candidates. An id has one group, so the group is a key: a text as
    an aggregate would have the rows sorted, five for every id."""
    diff = F.col("pred") - F.col("anchor")
    return candidates(spark, sf).groupBy("id", "grp").agg(
        F.max("y_true").alias("y_true"),
        F.max("anchor").alias("anchor"),
        F.max(F.when(F.col("candidate") == "both", diff)).alias("da"),
        F.max(F.when(F.col("candidate") == "group_a", diff)).alias("db"),
    )


@query(
    "SET-3",
    f"""WITH {PIVOT_SQL}, c AS (SELECT abs(da) > 500 AS a, abs(db) > 1e-12 AS b FROM wide)
SELECT {i('sum((a OR b)::INT)', 'n_union')}, {i('sum((a AND b)::INT)', 'n_both')}, {i('sum((a AND NOT b)::INT)', 'n_only_a')},
  {i('sum((NOT a AND b)::INT)', 'n_only_b')}, {d('sum((a AND b)::INT) / greatest(sum((a OR b)::INT), 1)', 'jaccard')} FROM c""",
)
def set_3(spark, sf):
    return wide(spark, sf).agg(*U.set_counts(U.changed(F.col("da"), 500), U.changed(F.col("db"))))


@query(
    "SET-4",
    f"""WITH {PIVOT_SQL}
SELECT grp, {i('sum((abs(da) > 1e-12 AND abs(db) > 1e-12 AND sign(da) = sign(db))::INT)', 'same')},
  {i('sum((abs(da) > 1e-12 AND abs(db) > 1e-12 AND sign(da) <> sign(db))::INT)', 'opposite')} FROM wide GROUP BY grp""",
)
def set_4(spark, sf):
    a, b = F.col("da"), F.col("db")
    return wide(spark, sf).groupBy("grp").agg(
        F.sum(U.same_sign(a, b).cast("bigint")).alias("same"), F.sum(U.opposite_sign(a, b).cast("bigint")).alias("opposite")
    )


# ---- FN --------------------------------------------------------------------------------


@query(
    "FN-1",
    f"""SELECT event_id, {d("TRY_CAST(nullif(trim(regexp_replace(props, '[^0-9]', '', 'g')), '7') AS DOUBLE)", 'k')} FROM events""",
)
def fn_1(spark, sf):
    """Numbers out of text; blank is missing (here the value 7 is blanked)."""
    text = F.trim(F.regexp_replace("props", r'[{}]|"k":', ""))
    return table(spark, sf, "events").select(
        "event_id", S.parse_number(F.when(text == "7", F.lit(" ")).otherwise(text)).alias("k")
    )


@query(
    "FN-2",
    """SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) || ':' || coalesce(n_name, 'species_' || CAST(s_nationkey AS VARCHAR)) AS label
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey""",
)
def fn_2(spark, sf):
    names = table(spark, sf, "nation").where("n_nationkey % 2 = 0")
    joined = table(spark, sf, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("s_suppkey", S.group_label(F.col("s_nationkey"), F.col("n_name")).alias("label"))


@query(
    "FN-3",
    f"""WITH l AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS label FROM part)
SELECT label, {i('row_number() OVER (ORDER BY TRY_CAST(label AS INT) NULLS LAST, label)', 'pos')} FROM l""",
)
def fn_3(spark, sf):
    from ..operators.ordered import ordinal

    label = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    labels = table(spark, sf, "part").select(label.alias("label")).distinct()
    return ordinal(labels, [], S.text_sort_key(F.col("label")), "r").select("label", (F.col("r") + 1).alias("pos"))


@query(
    "FN-4",
    f"""SELECT p_partkey, {d("CASE WHEN p_size % 2 = 0 THEN -p_size / 100.0 END", 'w')} FROM part""",
)
def fn_4(spark, sf):
    name = F.concat(
        F.lit("anti_nn_bias_w"), F.when(F.col("p_size") % 2 == 0, F.lit("m")).otherwise(F.lit("")),
        F.lpad(F.col("p_size").cast("string"), 3, "0"),
    )
    return table(spark, sf, "part").select("p_partkey", S.weight_from_name(name, "anti_nn_bias_w").alias("w"))


@query(
    "FN-5",
    """WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS rn FROM c)
SELECT user_id, string_agg(event_type || '=' || c, '; ' ORDER BY rn) AS top FROM r WHERE rn <= 3 GROUP BY user_id""",
)
def fn_5(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    return G.top_counts(counts, ["user_id"], "event_type", "c", 3, "top")


@query("FN-6", f"SELECT {i('count(*)', 'n')}, true AS utc FROM events")
def fn_6(spark, sf):
    stamp = S.utc_stamp()
    ok = stamp.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|\+00:00)$")
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.bool_and(ok).alias("utc"))


@query(
    "FN-7",
    f"""WITH {PAIR_SQL}
SELECT grp, {d('quantile_cont(y_true, 0.1)', 'q0')}, {d('quantile_cont(y_true, 0.5)', 'q1')}, {d('quantile_cont(y_true, 0.933)', 'q2')}
FROM pair GROUP BY grp""",
)
def fn_7(spark, sf):
    from ..operators.ordered import quantiles

    return quantiles(pred_pair(spark, sf), "y_true", [0.1, 0.5, 0.933], ["grp"])


@query(
    "FN-8",
    f"""SELECT {i("(l_quantity >= 10)::INT + (l_quantity >= 25)::INT + (l_quantity >= 40)::INT", 'bin')}, {i('count(*)', 'n')}
FROM lineitem GROUP BY 1""",
)
def fn_8(spark, sf):
    bins = S.bin_by_edges(F.col("l_quantity"), [10, 25, 40])
    return table(spark, sf, "lineitem").groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))


@query(
    "FN-9",
    f"""WITH {SPECTRA_SQL}, e AS (SELECT id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM spectra)
SELECT id, {i('unnest(range(64))', 'k')}, {d('unnest(list_transform(e, lambda v: v / list_sum(e)))', 'p')} FROM e""",
)
def fn_9(spark, sf):
    return spectra(spark, sf).select("id", F.posexplode(S.softmax_array(F.col("x"))).alias("k", "p"))


@query(
    "FN-10",
    f"""WITH {PAIR_SQL}
SELECT grp, {d('corr(y_true, y_pred)', 'c')}, {d('0', 'flat')} FROM pair GROUP BY grp""",
)
def fn_10(spark, sf):
    return pred_pair(spark, sf).withColumn("one", F.lit(1.0)).groupBy("grp").agg(
        G.safe_corr("y_true", "y_pred").alias("c"), G.safe_corr("y_true", "one").alias("flat")
    )


# ---- AGG: errors -----------------------------------------------------------------------

# Error tables on money amounts are compared to four digits.
def errs(digits: int = 4) -> str:
    return f"""{i('count(*)', 'n')}, {d('sqrt(avg((y_pred - y_true) ** 2))', 'rmse', digits)}, {d('avg(abs(y_pred - y_true))', 'mae', digits)}"""


ERR_SQL = errs()


@query(
    "AGG-1",
    f"""WITH {PAIR_SQL} SELECT {ERR_SQL},
  {d('1 - sum((y_pred - y_true) ** 2) / (var_pop(y_true) * count(*))', 'r2', 4)} FROM pair""",
    digits=4,
)
def agg_1(spark, sf):
    return G.metrics(pred_pair(spark, sf))


@query(
    "AGG-2",
    f"""WITH {PAIR_SQL}, f AS (SELECT id % 5 AS fold_id, sqrt(avg((y_pred - y_true) ** 2)) AS rmse FROM pair GROUP BY 1)
SELECT {i('count(*)', 'folds')}, {d('avg(rmse)', 'mean_score', 4)}, {d('stddev_pop(rmse)', 'std_score', 4)},
  (SELECT round(sqrt(avg((y_pred - y_true) ** 2)), 4) + 0.0 FROM pair) AS oof_rmse,
  (SELECT round(avg(abs(y_pred - y_true)), 4) + 0.0 FROM pair) AS oof_mae,
  (SELECT round(1 - sum((y_pred - y_true) ** 2) / (var_pop(y_true) * count(*)), 4) + 0.0 FROM pair) AS oof_r2 FROM f""",
    digits=4,
)
def agg_2(spark, sf):
    return G.fold_summary(pred_pair(spark, sf).withColumn("fold_id", F.col("id") % 5))


@query(
    "AGG-3",
    f"""WITH {PAIR_SQL} SELECT grp, {ERR_SQL}, {d('avg(y_pred - y_true)', 'bias', 4)}, {d('avg(y_true)', 'mean_true', 4)},
  {d('avg(y_pred)', 'mean_pred', 4)} FROM pair GROUP BY grp""",
    digits=4,
)
def agg_3(spark, sf):
    return G.group_errors(pred_pair(spark, sf)).orderBy(F.col("rmse").desc())


@query(
    "AGG-4",
    f"""WITH {CAND_SQL}, g AS (SELECT candidate, grp, sqrt(avg((pred - y_true) ** 2)) AS r, avg(pred - y_true) AS b FROM cand GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY r DESC, grp) AS rn FROM g)
SELECT candidate, grp AS worst_group, {d('r', 'worst_rmse', 4)}, {d('b', 'worst_bias', 4)} FROM k WHERE rn = 1""",
    digits=4,
)
def agg_4(spark, sf):
    return G.worst_group(candidates(spark, sf), ["candidate"], pred="pred")


@query(
    "AGG-5",
    f"""WITH {PAIR_SQL}, g AS (SELECT grp, min(y_true) AS a, max(y_true) AS b, min(y_pred) AS c, max(y_pred) AS e FROM pair GROUP BY grp)
SELECT grp, {d('a', 'true_min', 4)}, {d('b', 'true_max', 4)}, {d('c', 'pred_min', 4)}, {d('e', 'pred_max', 4)}, {d('b - a', 'true_range', 4)},
  {d('e - c', 'pred_range', 4)}, {d('(e - c) - (b - a)', 'range_gap', 4)} FROM g""",
    digits=4,
)
def agg_5(spark, sf):
    return G.range_table(pred_pair(spark, sf)).orderBy(F.abs("range_gap").desc())


def _bin_sql(keys: str, over: str, bins: int) -> str:
    return f"""WITH {PAIR_SQL}, r AS (SELECT *, ({bins} * row_number() OVER (PARTITION BY {keys or '1'} ORDER BY {over}) - 1)
  // count(*) OVER (PARTITION BY {keys or '1'}) AS b FROM pair)
SELECT {keys + ',' if keys else ''} {i('b', 'bin')}, {ERR_SQL}, {d('min(y_true)', 'bin_min', 4)}, {d('max(y_true)', 'bin_max', 4)},
  {d('avg(y_pred - y_true)', 'bias', 4)} FROM r GROUP BY {keys + ',' if keys else ''} b"""


@query("AGG-6", _bin_sql("", "y_true, id", 5), digits=4)
def agg_6(spark, sf):
    return G.binned_errors(pred_pair(spark, sf), 5, ["y_true", "id"])


@query("AGG-6-seq", _bin_sql("grp", "id", 4), digits=4)
def agg_6_seq(spark, sf):
    return G.binned_errors(pred_pair(spark, sf), 4, ["id"], ["grp"])


@query(
    "AGG-7",
    f"""WITH {PAIR_SQL}, q AS (SELECT quantile_cont(y_true, 0.25) AS a, quantile_cont(y_true, 0.5) AS b, quantile_cont(y_true, 0.75) AS c FROM pair),
r AS (SELECT pair.*, (y_true >= a)::INT + (y_true >= b)::INT + (y_true >= c)::INT AS bin FROM pair, q)
SELECT grp, {i('bin', 'bin')}, {i('count(*)', 'n')}, {d('sqrt(avg((y_pred - y_true) ** 2))', 'rmse', 4)}, {d('avg(y_true - y_pred)', 'bias', 4)}
FROM r GROUP BY grp, bin ORDER BY sqrt(avg((y_pred - y_true) ** 2)) DESC LIMIT 10""",
    digits=4,
)
def agg_7(spark, sf):
    return G.cell_errors(pred_pair(spark, sf), 4, 10)


SUMMARY_SQL = f"""{i('count(y_true)', 'n')}, {d('min(y_true)', 'min', 4)}, {d('max(y_true)', 'max', 4)}, {d('avg(y_true)', 'mean', 4)}, {d('stddev_pop(y_true)', 'std', 4)}"""


@query("AGG-8", f"WITH {PAIR_SQL} SELECT grp, {SUMMARY_SQL}, {d('median(y_true)', 'median', 4)} FROM pair GROUP BY grp", digits=4)
def agg_8(spark, sf):
    return G.numeric_summary(pred_pair(spark, sf), "y_true", ["grp"])


@query(
    "AGG-8-upper",
    f"""WITH {PAIR_SQL} SELECT grp, {SUMMARY_SQL}, {d('list_sort(list(y_true))[count(*) // 2 + 1]', 'median', 4)} FROM pair GROUP BY grp""",
    digits=4,
)
def agg_8_upper(spark, sf):
    return G.numeric_summary(pred_pair(spark, sf), "y_true", ["grp"], median="upper")


# ---- AGG: bands ------------------------------------------------------------------------


@query("AGG-9", f"WITH {LONG_SQL} SELECT grp, band, {d('avg(v)', 'v')} FROM bands GROUP BY grp, band")
def agg_9(spark, sf):
    return G.centroids(spectra(spark, sf)).select("grp", F.posexplode("x").alias("band", "v"))


@query(
    "AGG-10",
    f"""WITH {LONG_SQL}, c AS (SELECT band, corr(v, y) AS c FROM bands WHERE grp <= 6 GROUP BY band)
SELECT band, {d('c', 'corr')} FROM c ORDER BY abs(c) DESC, band LIMIT 20""",
)
def agg_10(spark, sf):
    corr = G.band_correlation(train(spark, sf))
    return P.top_bands(corr, 20, ties="low").select("band", "corr")


def _rank_sql(rank: str) -> str:
    return f"""WITH {LONG_SQL}, r AS (SELECT band, {rank.format(k='PARTITION BY band', v='v')} AS rv, {rank.format(k='PARTITION BY band', v='y')} AS ry
  FROM bands WHERE grp <= 6) SELECT band, {d('corr(rv, ry)', 'rho')} FROM r GROUP BY band"""


AVG_RANK = "rank() OVER ({k} ORDER BY {v}) + (count(*) OVER ({k}, {v}) - 1) / 2.0"


@query("AGG-11", _rank_sql(AVG_RANK))
def agg_11(spark, sf):
    return G.spearman_bands(long_bands(train(spark, sf), "id", "y"))


@query("AGG-11-ordinal", _rank_sql("row_number() OVER ({k} ORDER BY {v}, id)"))
def agg_11_ordinal(spark, sf):
    return G.spearman_bands(long_bands(train(spark, sf), "id", "y"), flavour="ordinal")


@query(
    "AGG-12",
    f"""WITH {LONG_SQL}, c AS (SELECT grp, band, corr(v, y) AS c FROM bands WHERE grp <= 6 GROUP BY grp, band HAVING count(*) >= 8)
SELECT band, {d('avg(abs(c))', 'group_abs_corr')}, {i('count(*)', 'groups')} FROM c GROUP BY band""",
)
def agg_12(spark, sf):
    return G.group_strength(train(spark, sf))


@query(
    "AGG-12-top",
    f"""WITH {LONG_SQL}, c AS (SELECT grp, band, corr(v, y) AS c FROM bands WHERE grp <= 6 GROUP BY grp, band),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(c) DESC, band DESC) AS pos FROM c)
SELECT grp, band, {d('c', 'corr')}, {i('pos', 'pos')} FROM r WHERE pos <= 5""",
)
def agg_12_top(spark, sf):
    corr = G.band_correlation(train(spark, sf), ["grp"])
    return P.top_bands(corr, 5, ["grp"]).select("grp", "band", "corr", "pos")


@query(
    "AGG-13",
    f"""WITH {LONG_SQL}, c AS (SELECT band, corr(v, y) AS c FROM bands WHERE grp <= 6 GROUP BY band)
SELECT a.centre, {i('band - a.centre', 'offset_')}, {d('c', 'corr')} FROM c JOIN (VALUES (10::BIGINT), (31), (50)) a(centre) ON abs(band - centre) <= 5""",
)
def agg_13(spark, sf):
    corr = G.band_correlation(train(spark, sf))
    centres = F.explode(F.filter(F.array(*[F.lit(c) for c in ANCHOR_BANDS]), lambda c: F.abs(F.col("band") - c) <= 5))
    return corr.withColumn("centre", centres).select("centre", (F.col("band") - F.col("centre")).alias("offset_"), "corr")


MI_SQL = """cut AS (SELECT feature, y, (8 * row_number() OVER (PARTITION BY feature ORDER BY v, id) - 1) // count(*) OVER (PARTITION BY feature) AS bv,
    (8 * row_number() OVER (PARTITION BY feature ORDER BY y, id) - 1) // count(*) OVER (PARTITION BY feature) AS bz FROM feats WHERE grp <= 6),
cells AS (SELECT feature, bv, bz, count(*) AS c FROM cut GROUP BY ALL),
mi AS (SELECT feature, sum(c / n * ln(c * n / (px * py))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY feature) AS n,
    sum(c) OVER (PARTITION BY feature, bv) AS px, sum(c) OVER (PARTITION BY feature, bz) AS py FROM cells) GROUP BY feature)"""
FEATS_SQL = SPECTRA_SQL + """,
feats AS (SELECT id, grp, y, f AS feature, list_avg(x[f * 8 + 1 : f * 8 + 8]) AS v FROM spectra, (SELECT unnest(range(8)) AS f))"""
SPANS8 = X.windows(N_BANDS, 8, 8)


def window_means(df):
    """Rows (id, grp, y, feature, v) of the eight window means."""
    means = X.segment_means(F.col("x"), SPANS8)
    return df.select("id", "grp", "y", F.posexplode(means).alias("feature", "v"))


@query("AGG-14", f"WITH {FEATS_SQL}, {MI_SQL} SELECT {i('feature', 'feature')}, {d('mi', 'mutual_info')} FROM mi")
def agg_14(spark, sf):
    return G.binned_mutual_information(window_means(train(spark, sf)))


TRANSFER_SQL = """fit AS (SELECT feature, avg(v) AS m, greatest(stddev_pop(v), 1e-12) AS s FROM feats WHERE grp <= 6 GROUP BY feature),
z AS (SELECT feats.*, (v - m) / s AS z FROM feats JOIN fit USING (feature)),
tr AS (SELECT feature, grp, avg(z) AS c FROM z WHERE grp <= 6 GROUP BY ALL),
te AS (SELECT feature, grp, avg(z) AS c, var_pop(z) AS w FROM z WHERE grp > 6 GROUP BY ALL),
near AS (SELECT te.feature, te.grp, any_value(te.c) AS c, any_value(te.w) AS w, min(abs(te.c - tr.c)) AS dist FROM te JOIN tr ON te.feature = tr.feature GROUP BY te.feature, te.grp),
transfer AS (SELECT feature, avg(dist) AS dist, var_pop(c) / greatest(avg(w), 1e-12) AS sep FROM near GROUP BY feature),
shift AS (SELECT feature, avg(z) AS shift FROM z WHERE grp > 6 GROUP BY feature)"""


@query(
    "AGG-15",
    f"""WITH {FEATS_SQL}, {TRANSFER_SQL}
SELECT {i('feature', 'feature')}, {d('shift', 'test_global_shift')}, {d('dist', 'mean_nearest_distance')}, {d('sep', 'test_separation')}
FROM transfer JOIN shift USING (feature)""",
)
def agg_15(spark, sf):
    return G.transfer_scores(window_means(train(spark, sf)), window_means(test(spark, sf)))


@query(
    "AGG-16",
    f"""WITH {FEATS_SQL}, {MI_SQL}, {TRANSFER_SQL},
p AS (SELECT feature, corr(v, y) AS p FROM feats WHERE grp <= 6 GROUP BY feature),
rk AS (SELECT feature, {AVG_RANK.format(k='PARTITION BY feature', v='v')} AS rv, {AVG_RANK.format(k='PARTITION BY feature', v='y')} AS ry FROM feats WHERE grp <= 6),
rho AS (SELECT feature, corr(rv, ry) AS rho FROM rk GROUP BY feature),
gs AS (SELECT feature, avg(abs(c)) AS gs FROM (SELECT feature, grp, corr(v, y) AS c FROM feats WHERE grp <= 6 GROUP BY ALL HAVING count(*) >= 8) GROUP BY feature)
SELECT {i('feature', 'feature')}, {d('0.42 * abs(p) + 0.22 * abs(rho) + 0.18 * gs + 0.10 * least(1, sep) + 0.08 * least(1, mi) - 0.08 * (least(2.5, abs(shift)) + 0.35 * least(3, abs(dist)))', 'usable')}
FROM p JOIN rho USING (feature) JOIN gs USING (feature) JOIN transfer USING (feature) JOIN shift USING (feature) JOIN mi USING (feature)""",
)
def agg_16(spark, sf):
    tr, te = train(spark, sf), test(spark, sf)
    means = tr.withColumn("x", X.segment_means(F.col("x"), SPANS8))
    corr = G.band_correlation(means).select("band", "corr")
    strength = G.group_strength(means).select("band", "group_abs_corr")
    long = window_means(tr)
    rho = G.spearman_bands(long.withColumnRenamed("feature", "band"))
    mi = G.binned_mutual_information(long).withColumnRenamed("feature", "band")
    transfer = G.transfer_scores(long, window_means(te)).withColumnRenamed("feature", "band")
    out = corr.join(strength, "band").join(rho, "band").join(mi, "band").join(transfer, "band")
    c = F.col
    return out.select(
        c("band").alias("feature"),
        G.usable_score(
            c("corr"), c("rho"), c("group_abs_corr"), c("test_separation"), c("mutual_info"), c("test_global_shift"), c("mean_nearest_distance")
        ).alias("usable"),
    )


GRID = X.window_grid(N_BANDS)
SCAN_SQL = SPECTRA_SQL + f""",
spans(win_start, win_end) AS (VALUES {', '.join(f'({s}, {e})' for s, e in GRID)}),
scan AS (SELECT 'raw' AS view, 'mean' AS stat, win_start, win_end, abs(corr(list_avg(x[win_start + 1 : win_end]), y)) AS usable
  FROM spectra, spans WHERE grp <= 6 GROUP BY ALL)"""


def scan(spark, sf):
    """|corr| of the mean of every window of the grid with the target."""
    rows = train(spark, sf).select("y", F.inline(X.window_rows(F.col("x"), GRID, ("mean",))))
    return rows.groupBy("win_start", "win_end", "stat").agg(F.abs(F.corr("v", "y")).alias("usable")).withColumn("view", F.lit("raw"))


@query(
    "AGG-17",
    f"""WITH {SCAN_SQL}, b AS (SELECT *, CAST(25 * round_even(((win_start + win_end) // 2) / 25.0, 0) AS BIGINT) AS bucket FROM scan),
r AS (SELECT *, row_number() OVER (PARTITION BY view, stat, bucket ORDER BY usable DESC, win_start, win_end) AS rn, count(*) OVER (PARTITION BY view, stat, bucket) AS n FROM b)
SELECT view, stat, bucket, {i('min(win_start)', 'start_min')}, {i('max(win_end)', 'end_max')}, {d('max(usable)', 'best_usable')},
  {d('avg(usable)', 'mean_top_usable')}, {i('any_value(n)', 'n_support')} FROM r WHERE rn <= 10 GROUP BY view, stat, bucket""",
)
def agg_17(spark, sf):
    return G.region_table(scan(spark, sf))


# ---- AGG: sequences and audits ---------------------------------------------------------

PROFILE_SQL = f"""{i('count(*)', 'n')}, {d('coalesce(corr(seq, value), 0)', 'pearson')}, {d('coalesce(corr(o, rv), 0)', 'spearman')},
  {d('coalesce(regr_slope(value, seq), 0)', 'slope')}, {d('coalesce(avg((d < 0)::INT), 0)', 'decrease_rate')},
  {d('coalesce(avg(d), 0)', 'mean_delta')}, {d('arg_min(value, seq)', 'first_value')}, {d('arg_max(value, seq)', 'last_value')},
  {d('coalesce(median(d), 0)', 'median_delta')}"""


@query(
    "AGG-18",
    f"""WITH {SEQ_SQL}, s AS (SELECT grp, seq, value, seq AS o, {AVG_RANK.format(k='PARTITION BY grp', v='value')} AS rv,
  value - lag(value) OVER (PARTITION BY grp ORDER BY seq) AS d FROM seqs),
a AS (SELECT id AS seq, value, id AS o, {AVG_RANK.format(k='PARTITION BY 1', v='value')} AS rv, value - lag(value) OVER (ORDER BY id) AS d FROM seqs)
SELECT grp, {PROFILE_SQL} FROM s GROUP BY grp UNION ALL SELECT -1 AS grp, {PROFILE_SQL} FROM a""",
)
def agg_18(spark, sf):
    """Per group, and over all rows under group -1."""
    from ..operators.ordered import ordinal

    ev = events_seq(spark, sf)
    per = G.sequence_profile(ordinal(ev, ["grp"], ["ts", "id"], "r").withColumn("seq", F.col("r") + 1), ["grp"])
    whole = G.sequence_profile(ev.withColumn("seq", F.col("id")), []).withColumn("grp", F.lit(-1).cast("bigint"))
    return per.unionByName(whole)


@query(
    "AGG-19",
    f"""WITH {PAIR_SQL}, p AS (SELECT id, y_pred - y_true AS e, discount, tax, y_pred FROM pair),
l AS (SELECT id, e, 'discount' AS feature, discount AS v FROM p UNION ALL SELECT id, e, 'tax', tax FROM p UNION ALL SELECT id, e, 'y_pred', y_pred FROM p),
r AS (SELECT *, abs(e) AS a, {AVG_RANK.format(k='PARTITION BY feature', v='v')} AS rv, {AVG_RANK.format(k='PARTITION BY feature', v='abs(e)')} AS ra FROM l)
SELECT feature, {d('corr(v, e)', 'corr_error')}, {d('corr(v, a)', 'corr_abs_error')}, {d('corr(rv, ra)', 'rho_abs_error')} FROM r GROUP BY feature""",
)
def agg_19(spark, sf):
    return G.error_audit(pred_pair(spark, sf), ["discount", "tax", "y_pred"])


@query(
    "AGG-20",
    f"""WITH {CAND_SQL}, q AS (SELECT candidate, quantile_cont(anchor, 0.1) AS lo, quantile_cont(anchor, 0.9) AS hi FROM cand GROUP BY candidate)
SELECT candidate, {d('avg(CASE WHEN anchor <= lo THEN pred - anchor END)', 'bottom_delta', 4)}, {d('avg(CASE WHEN anchor >= hi THEN pred - anchor END)', 'top_delta', 4)}
FROM cand JOIN q USING (candidate) GROUP BY candidate""",
    digits=4,
)
def agg_20(spark, sf):
    return G.decile_delta(candidates(spark, sf), "anchor", "pred", ["candidate"])


@query(
    "AGG-21",
    f"""WITH {CAND_SQL}, g AS (SELECT candidate, grp, sqrt(avg((pred - y_true) ** 2)) - sqrt(avg((anchor - y_true) ** 2)) AS d FROM cand GROUP BY 1, 2)
SELECT candidate, {i('sum((d < 0)::INT)', 'improved_count')}, {i('count(*)', 'group_count')}, {d('avg((d < 0)::INT)', 'improved_ratio', 4)},
  {d('max(d)', 'worst_delta', 4)}, {d('stddev_pop(d)', 'delta_std', 4)} FROM g GROUP BY candidate""",
    digits=4,
)
def agg_21(spark, sf):
    return G.fold_deltas(candidates(spark, sf), ["candidate"])


@query(
    "AGG-22",
    f"""WITH {CAND_SQL}, g AS (SELECT candidate, grp, avg(pred - anchor) AS m FROM cand GROUP BY 1, 2)
SELECT candidate, {d('max(abs(m))', 'max_group_shift', 4)} FROM g GROUP BY candidate""",
    digits=4,
)
def agg_22(spark, sf):
    return G.max_group_shift(candidates(spark, sf), ["candidate"])


@query(
    "AGG-23",
    f"""WITH w AS (SELECT l_returnflag AS grp, l_discount + 0.01::DOUBLE AS w FROM lineitem)
SELECT grp, {d('sum(w) ** 2 / (sum(w * w) * count(*))', 'ess')} FROM w GROUP BY grp""",
)
def agg_23(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_discount") + 0.01).alias("w"))
    return df.groupBy("grp").agg(G.ess_ratio("w").alias("ess"))


def detector(spark, sf):
    return pred_pair(spark, sf).select(
        "id", "grp", F.col("y_pred").alias("score"), (F.col("y_true") > 60000).alias("label"), F.col("y_true").alias("size")
    )


DET_SQL = PAIR_SQL + """,
det AS (SELECT id, grp, y_pred AS score, (y_true > 60000)::INT AS label, y_true AS size FROM pair)"""


@query(
    "AGG-24",
    f"""WITH {DET_SQL}, r AS (SELECT label, {AVG_RANK.format(k='PARTITION BY 1', v='score')} AS rk FROM det),
s AS (SELECT score, sum(label) AS tp, count(*) AS n FROM det GROUP BY score),
c AS (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM s WINDOW w AS (ORDER BY score DESC))
SELECT {d('(sum(label * rk) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))', 'auc')},
  (SELECT round(CAST(sum(tp * ctp / cn) / sum(tp) AS DOUBLE), 6) + 0.0 FROM c) AS ap FROM r""",
)
def agg_24(spark, sf):
    return G.detector_quality(detector(spark, sf), "score", "label")


@query(
    "AGG-24-at",
    f"""WITH {DET_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) <= CAST(round_even((SELECT count(*) FROM det) * 0.1, 0) AS BIGINT) AS g FROM det),
m AS (SELECT min(p) AS p FROM (SELECT grp, avg(label) AS p FROM r WHERE g GROUP BY grp))
SELECT {d('avg(CASE WHEN g THEN label END)', 'precision')}, {d('avg(CASE WHEN g THEN size END) / avg(size)', 'lift')}, {i('sum(g::INT)', 'k')},
  {d('any_value(m.p)', 'group_precision_min')} FROM r, m""",
)
def agg_24_at(spark, sf):
    return G.precision_at(detector(spark, sf), "score", "label", "size", 0.1)


# ---- AGG: clusters ---------------------------------------------------------------------

QUARTERS = X.split_points(N_BANDS, 4)


def clustered(spark, sf):
    """Rows with a cluster label: the quarter with the highest mean."""
    m = X.segment_means(F.col("x"), QUARTERS)
    both = U.stack_domains(train(spark, sf), test(spark, sf))
    return both.select("id", "grp", "domain", "x", m.alias("m")).withColumn(
        "cluster", F.array_position("m", F.array_max("m")) - 1
    )


CLUSTER_SQL = SPECTRA_SQL + """,
cl AS (SELECT id, grp, x, CASE WHEN grp <= 6 THEN 'train' ELSE 'test' END AS domain, list_position(m, list_max(m)) - 1 AS cluster
  FROM (SELECT id, grp, x, list_transform(range(0, 4), lambda k: list_avg(x[k * 16 + 1 : k * 16 + 16])) AS m FROM spectra))"""


@query(
    "AGG-25",
    f"""WITH {CLUSTER_SQL}, c AS (SELECT domain, cluster, grp, count(*) AS c FROM cl GROUP BY ALL),
tp AS (SELECT sum(m) / sum(t) AS v FROM (SELECT max(c) AS m, sum(c) AS t FROM c WHERE domain = 'test' GROUP BY cluster)),
tc AS (SELECT sum(m) / sum(t) AS v FROM (SELECT max(c) AS m, sum(c) AS t FROM c WHERE domain = 'test' GROUP BY grp)),
rp AS (SELECT sum(m) / sum(t) AS v FROM (SELECT max(c) AS m, sum(c) AS t FROM c WHERE domain = 'train' GROUP BY cluster)),
mc AS (SELECT sum(CASE WHEN tr >= 10 THEN te ELSE 0 END) / sum(te) AS v FROM (SELECT cluster, sum((domain = 'test')::INT) AS te, sum((domain = 'train')::INT) AS tr FROM cl GROUP BY cluster)),
mu AS (SELECT cluster, k, avg(x[k]) AS m FROM (SELECT cluster, x, unnest(range(1, 65)) AS k FROM cl) GROUP BY ALL), cm AS (SELECT cluster, list(m ORDER BY k) AS mu FROM mu GROUP BY cluster),
cs AS (SELECT cluster, mu, avg(list_dot_product(x, x)) AS sq, count(*) AS n FROM cl JOIN cm USING (cluster) GROUP BY ALL),
ds AS (SELECT cl.id, cl.cluster = cs.cluster AS own, n, list_dot_product(x, x) - 2 * list_dot_product(x, mu) + sq AS dd FROM cl, cs),
ab AS (SELECT id, max(CASE WHEN own AND n > 1 THEN dd * n / (n - 1) END) AS a, min(CASE WHEN NOT own THEN dd END) AS b FROM ds GROUP BY id),
si AS (SELECT avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS v FROM ab)
SELECT {d('tp.v', 'test_purity')}, {d('tc.v', 'test_concentration')}, {d('rp.v', 'train_purity')}, {d('mc.v', 'mixed_coverage')}, {d('si.v', 'silhouette')},
  {d('0.35 * tp.v + 0.35 * tc.v + 0.2 * mc.v + 0.1 * greatest(0, least(1, (si.v + 0.1) / 0.6))', 'clean_score')} FROM tp, tc, rp, mc, si""",
)
def agg_25(spark, sf):
    return G.cluster_quality(clustered(spark, sf))


def _top_sql(source: str, key: str, name: str) -> str:
    return f"""{name} AS (SELECT {key}, string_agg(grp || '=' || c, '; ' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY c DESC, grp) AS rn
  FROM c WHERE {source}) WHERE rn <= 6 GROUP BY {key})"""


@query(
    "AGG-26",
    f"""WITH {CLUSTER_SQL}, c AS (SELECT cluster, domain, grp, count(*) AS c FROM cl GROUP BY ALL), {_top_sql("domain = 'train'", 'cluster', 'a')}, {_top_sql("domain = 'test'", 'cluster', 'b')},
n AS (SELECT cluster, sum(c) AS n, sum(CASE WHEN domain = 'train' THEN c ELSE 0 END) AS r, sum(CASE WHEN domain = 'test' THEN c ELSE 0 END) AS e FROM c GROUP BY cluster)
SELECT {i('n.cluster', 'cluster')}, {i('n', 'n')}, {i('r', 'train_n')}, {i('e', 'test_n')}, {d('e / n', 'test_ratio')}, coalesce(a.t, '') AS top_train, coalesce(b.t, '') AS top_test
FROM n LEFT JOIN a USING (cluster) LEFT JOIN b USING (cluster)""",
)
def agg_26(spark, sf):
    return G.cluster_composition(clustered(spark, sf))


@query(
    "AGG-27",
    f"""WITH {CLUSTER_SQL}, c AS (SELECT cluster, domain, grp, count(*) AS c FROM cl GROUP BY ALL), {_top_sql("domain = 'train'", 'cluster', 'a')}, {_top_sql("domain = 'test'", 'cluster', 'b')},
t AS (SELECT grp, cluster, c, sum(c) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY c DESC, cluster) AS rn FROM c WHERE domain = 'test')
SELECT grp, {i('t.cluster', 'cluster')}, {i('n', 'n')}, {i('c', 'top_n')}, {d('c / n', 'top_share')}, coalesce(a.t, '') AS train_in_cluster, coalesce(b.t, '') AS test_in_cluster
FROM t LEFT JOIN a USING (cluster) LEFT JOIN b USING (cluster) WHERE rn = 1""",
)
def agg_27(spark, sf):
    return G.dominant_cluster(clustered(spark, sf))


# ---- AGG: changes ----------------------------------------------------------------------


@query(
    "AGG-29",
    f"""WITH {PIVOT_SQL}, b AS (SELECT *, CASE WHEN abs(da) > 500 AND abs(db) > 1e-12 THEN 'both' WHEN abs(da) > 500 THEN 'own_only'
  WHEN abs(db) > 1e-12 THEN 'others_only' ELSE 'untouched' END AS bucket FROM wide)
SELECT bucket, grp, {i('count(*)', 'n')}, {d('avg(anchor)', 'pred_mean', 4)}, {d('min(anchor)', 'pred_min', 4)}, {d('max(anchor)', 'pred_max', 4)},
  {d('avg(y_true)', 'score_mean', 4)}, {d('avg(abs(da))', 'abs_change_mean', 4)} FROM b GROUP BY bucket, grp""",
    digits=4,
)
def agg_29(spark, sf):
    df = wide(spark, sf).withColumn("bucket", G.change_bucket(U.changed(F.col("da"), 500), U.changed(F.col("db"))))
    return G.bucket_summary(df, ["bucket", "grp"], "anchor", "y_true", "da")


@query("AGG-30", digits=3)
def agg_30(spark, sf):
    df = wide(spark, sf).withColumn("marked", F.col("anchor") >= 74000)
    return G.subset_null(df, "y_true", "marked")


@query(
    "AGG-30-exact",
    f"""WITH {CAND_SQL}, w AS (SELECT id, any_value(y_true) AS v, any_value(anchor) >= 74000 AS m FROM cand GROUP BY id),
s AS (SELECT avg(v) FILTER (m) AS observed, avg(v) AS null_mean, sqrt(var_samp(v) / count(*) FILTER (m) * (1 - count(*) FILTER (m) / count(*)::DOUBLE)) AS null_sd FROM w)
SELECT {d('observed', 'observed', 4)}, {d('null_mean', 'null_mean', 4)}, {d('null_sd', 'null_sd', 4)}, {d('(observed - null_mean) / null_sd', 'z', 4)} FROM s""",
    digits=4,
)
def agg_30_exact(spark, sf):
    df = wide(spark, sf).withColumn("marked", F.col("anchor") >= 74000)
    return G.subset_null_moments(df, "y_true", "marked")


@query(
    "AGG-31",
    f"""WITH {CAND_SQL}, s AS (SELECT id, stddev_pop(pred) AS s FROM cand GROUP BY id)
SELECT {d('avg(s)', 'spread_mean', 4)}, {d('max(s)', 'spread_max', 4)} FROM s""",
    digits=4,
)
def agg_31(spark, sf):
    return G.seed_spread(candidates(spark, sf))


@query(
    "AGG-32",
    f"""SELECT l_returnflag AS grp, {i('count(*)', 'n')}, {i('sum((l_tax >= 0.07)::INT)', 'removed')}, {d('avg((l_tax >= 0.07)::INT)', 'removed_rate')},
  {d('avg(l_discount)', 'weight_mean')}, {d('min(l_discount)', 'weight_min')} FROM lineitem GROUP BY 1""",
)
def agg_32(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("grp", F.col("l_returnflag"))
    return G.weight_report(df, "l_discount", F.col("l_tax") >= 0.07)
