"""Steps whose cost or result depended on the size of the table."""

import io
import os
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from bandwright.operators import corrections as C
from bandwright.operators import drift as D
from bandwright.operators import groups as G
from bandwright.operators import monotone as Mo
from bandwright.operators import ordered as O
from bandwright.operators import select as P
from bandwright.operators import targets as T
from bandwright.plans import q_corrections, q_runs, q_stats
from bandwright.plans.fixtures import candidates, pred_pair
from bandwright.sources import predictions

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    held = io.StringIO()
    with redirect_stdout(held):
        df.explain()
    return held.getvalue()


def test_quantile_rounds_never_send_the_rows_to_every_task(spark, monkeypatch):
    """Few distinct values pack into a tiny file whatever the number of rows."""
    plans = []
    cut = O.cut
    monkeypatch.setattr(O, "cut", lambda df: plans.append(plan(df)) or cut(df))
    df = spark.range(200_000).select(F.concat(F.lit("g"), F.col("id") % 5).alias("grp"), (F.col("id") % 50).cast("double").alias("v"))
    got = O.quantiles(df, "v", [0.1, 0.9], ["grp"])
    plans.append(plan(got))
    assert "Inner, BuildLeft" not in "".join(plans)
    assert {r["grp"]: (round(r["q0"], 6), round(r["q1"], 6)) for r in got.collect()}["g0"] == (4.5, 40.5)


def test_target_scores_use_every_row_as_a_quantile(spark):
    """More rows than the default number of quantiles, and a value with copies."""
    df = spark.range(2500).select("id", F.least(F.col("id") * F.col("id"), F.lit(4_000_000)).cast("double").alias("y"))
    got = {r["id"]: r["t"] for r in T.quantile_normal_target(df, "y", "t", None).collect()}
    share = spark.createDataFrame([(1234 / 2499,)], "p double").select(T.S.normal_quantile(F.col("p"))).first()[0]
    assert len(got) == 2500 and got[1234] == share
    assert got[2000] == got[2499] == max(got.values()) and got[0] == min(got.values())


def test_stored_predictions_are_written_by_many_tasks(spark, monkeypatch):
    held = []
    read = predictions.read_predictions
    monkeypatch.setattr(q_runs.predictions, "read_predictions", lambda s, path: held.append(path) or read(s, path))
    sf = "/root/testdata/sf0.1"
    got = q_runs.src_4(spark, sf)
    assert len([f for f in os.listdir(held[0].removeprefix("file:")) if f.startswith("part-")]) > 1
    assert got.where("pred < 0").count() == 0 and got.count() == pred_pair(spark, sf).count()


def test_pairs_are_moved_once(spark):
    assert plan(q_stats.wide(spark, "/root/testdata/sf0.1")).count("Exchange") == 1
    assert plan(C.mean_of_variants(candidates(spark, "/root/testdata/sf0.1"))).count("Exchange") == 1
    assert plan(q_corrections.bld_2(spark, "/root/testdata/sf0.1")).count("Exchange") == 1


def test_no_task_sorts_rows_to_add_up_a_text(spark):
    """The only sorts are those of an id's lines after they have been dealt."""
    text = plan(q_stats.set_4(spark, "/root/testdata/sf0.1"))
    assert text.count("- Sort ") == 1 and text.index("- Sort ") < text.index("Exchange hashpartitioning(id")


def test_no_task_holds_more_lines_of_a_larger_table(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = pred_pair(spark, sf).groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert rows < 200_000


def test_similarity_reads_the_rows_once_for_its_matrix(spark, monkeypatch):
    calls = []
    gram = D.gram
    monkeypatch.setattr(D, "gram", lambda *a: calls.append(1) or gram(*a))
    long = spark.createDataFrame(
        [("a", k, 0.0, float(k)) for k in range(40)] + [("b", k, 0.0, float(k % 2)) for k in range(40)] + [("c", 1, 0.0, 1.0)],
        "candidate string, id long, anchor double, pred double",
    )
    got = {(r["a"], r["b"]): r for r in D.candidate_similarity(long, ["a", "b", "c"], 5).collect()}
    assert len(calls) == 1
    assert got["a", "b"]["jaccard"] == 20 / 39 and got["b", "c"]["jaccard"] == 1 / 20


def test_only_distinct_values_are_put_in_order(spark, monkeypatch):
    sizes = []
    ordinal = O.ordinal
    monkeypatch.setattr(O, "ordinal", lambda df, *a: sizes.append(df.count()) or ordinal(df, *a))
    df = spark.range(5000).select("id", (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    pdf = df.toPandas()
    pdf["want"] = pdf.groupby("k").v.rank(method="average")
    got = O.tie_rank(df, "v", "id", "r", ["k"]).toPandas().merge(pdf, on="id")
    assert (got.r == got.want).all() and sizes == [14]


def test_error_audit_ranks_without_ids(spark):
    rows = pred_pair(spark, SF)
    got = {r["feature"]: r for r in G.error_audit(rows.drop("id"), ["discount", "tax"]).collect()}
    pdf = rows.toPandas()
    size = (pdf.y_pred - pdf.y_true).abs()
    for f in ("discount", "tax"):
        assert abs(got[f]["rho_abs_error"] - pdf[f].rank().corr(size.rank())) < 1e-9


def test_gates_order_scores_and_ids_only(spark, monkeypatch):
    columns = []
    ordinal = P.ordinal
    monkeypatch.setattr(P, "ordinal", lambda df, *a: columns.append(set(df.columns)) or ordinal(df, *a))
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 10 > 0, F.col("id") * 37 % 101).cast("double").alias("s"), (F.col("id") % 5).alias("lab"), F.lit("wide").alias("more")
    )
    pdf = df.toPandas().sort_values(["s", "id"], ascending=False, na_position="last")
    best = set(pdf.head(300).id)
    assert {r["id"] for r in P.top_fraction(df, "s", "id", 0.1).where("gate").collect()} == best
    for cap, frac, refill in ((3, 0.1, True), (3, 0.1, False), (80, 0.1, True), (10**6, 0.1, True)):
        inside = pdf.groupby("lab").cumcount() < cap
        want = pdf[inside].head(300)
        if refill:
            want = [*want.id, *pdf[~inside].head(300 - len(want)).id]
        else:
            want = [*want.id]
        got = P.capped_top_fraction(df, "s", "id", "lab", frac, cap, "gate", refill).where("gate").collect()
        assert {r["id"] for r in got} == set(want)
    assert all("more" not in c for c in columns)
    gated = C.limit_gate(df.withColumn("g", F.col("id") % 2 == 0), "g", "s", "id", 0.02).where("g").collect()
    assert {r["id"] for r in gated} == set(pdf[pdf.id % 2 == 0].head(60).id)


def test_curve_template_orders_each_group_once(spark, monkeypatch):
    orders = []
    ordinal = Mo.ordinal
    monkeypatch.setattr(Mo, "ordinal", lambda df, keys, by, *a: orders.append(list(by)) or ordinal(df, keys, by, *a))
    df = spark.range(60).select("id", (F.col("id") % 3).alias("g"), (F.col("id") / 60).alias("p"), (F.col("id") * 7 % 11).cast("double").alias("b"))
    curve = spark.createDataFrame([(0.0, 1.0), (0.5, 0.4), (1.0, 0.0)], "p double, c double")
    out = Mo.curve_template(df, curve, (8.0, 12.0), (0.0, 11.0), "g", "p", "b", "id", "upper_anchor").toPandas()
    assert orders.count(["p", "id"]) == 1
    assert all((part.sort_values("p").pred.diff().dropna() <= 1e-9).all() for _, part in out.groupby("g")) and len(out) == 60
