"""The join where its bitmaps are full and where windows of common words recur by chance."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from bandwright.llm import common, jaccard_join, packed


def first_of(sets):
    return sets.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "row")).alias("of")).select("of.row")


def test_a_full_bitmap_lets_no_other_set_through(spark, monkeypatch):
    """As many repeated keys as a large table has fill the bitmap of keys; sets without a near copy still stay behind."""
    rng = random.Random(2)
    texts = [[f"g{g}w{rng.randrange(10**6)}" for _ in range(80)] for g in range(60)]
    rows = [(g, " ".join(t)) for g, t in enumerate(texts)] + [(100 + g, " ".join(texts[g][:79] + ["new"])) for g in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = jaccard_join._sets(docs, 4, 85, 100)
    real = jaccard_join.bitmap
    monkeypatch.setattr(jaccard_join, "bitmap", lambda df, key: np.full(1 << (common.BITMAP_BITS - 3), 255, np.uint8) if key == "h" else real(df, key))
    got = jaccard_join._shared_keys(sets, first_of(sets), 85, 100)
    assert {r.doc for r in got.collect()} == {0, 1, 2, 100, 101, 102}
    assert {(r.doc_id, r.component_id) for r in jaccard_join.join(docs, 4, 85, 100).collect()} == {(i, i % 100) for i, _ in rows}


def test_near_duplicates_with_a_full_bitmap(spark, monkeypatch):
    """The pipeline's stage: only texts with a near copy give keys, and one of each group stays."""
    rng = random.Random(6)
    texts = [[f"g{g}w{rng.randrange(10**6)}" for _ in range(80)] for g in range(60)]
    rows = [(g, " ".join(t)) for g, t in enumerate(texts)] + [(100 + g, " ".join(texts[g][:78] + ["new"])) for g in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    real, links, seen = jaccard_join.bitmap, jaccard_join.linking.links, []
    monkeypatch.setattr(jaccard_join, "bitmap", lambda df, key: np.full(1 << (common.BITMAP_BITS - 3), 255, np.uint8) if key == "h" else real(df, key))
    monkeypatch.setattr(jaccard_join.linking, "links", lambda keys, *a: seen.append(keys.select("id").distinct().count()) or links(keys, *a))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(range(60))
    assert seen == [6]


def test_only_rows_that_may_go_are_moved(spark, tmp_path):
    """Without a broadcast of the ids, rows that stay are not in the shuffle of the join."""
    rows = [(i, f"text {i}") for i in range(2000)] + [(7, "again"), (None, "no id"), (5000, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    gone = spark.createDataFrame([(i,) for i in range(0, 2000, 50)] + [(7,)], "doc_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = corpus_pipeline._without(docs, gone)
        out = {(r.doc_id, r.text) for r in left.collect()}
        plan = left._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    ids = set(range(0, 2000, 50)) | {7}
    assert left.columns == docs.columns and out == {r for r in rows if r[0] not in ids}
    assert plan.lstrip().startswith("Union")


def test_windows_of_common_words_are_not_among_the_keys(spark):
    """Texts that share only windows of common words, most of their windows, in places chosen by chance."""
    rng = random.Random(4)
    phrases = ["of the and to", "in a that is", "on it was for", "by at this from"]
    rows = []
    for i in range(200):
        rows.append((i, " ".join(rng.choice(phrases) if rng.random() < 0.6 else f"r{rng.randrange(10**7)}" for _ in range(90))))
    sets = jaccard_join._sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85, 100)
    assert jaccard_join._twice(sets).count() == 0
    assert jaccard_join._shared_keys(sets, first_of(sets), 85, 100).count() == 0


def test_levels_belong_to_windows():
    rng = np.random.default_rng(3)
    level = rng.integers(0, 50, 1 << jaccard_join.WORD_BITS).astype(np.uint8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, n)).encode() for n in (0, 1, 3, 4, 5, 200, 0, 2, 90)]
    of = {}
    for (own, got), want in zip(jaccard_join._ordered_sets(texts, 4, level), common.shingle_sets(texts, 4), strict=True):
        assert (own == want).all() and len(got) == len(own)
        assert all(of.setdefault(t, x) == x for t, x in zip(own.tolist(), got.tolist()))
    (h, _), = common.hashed_words([texts[3]])
    assert [x for _, x in jaccard_join._ordered_sets([texts[3]], 4, level)][0].tolist() == [level[jaccard_join._slots(h)].min()]


def test_sorted_keys_are_packed_in_steps():
    rng = np.random.default_rng(7)
    for n, bits in ((1, 64), (2, 64), (1000, 64), (1000, 30), (5, 3)):
        keys = np.sort(rng.integers(0, (1 << bits) - 1, n, dtype=np.uint64, endpoint=True))
        assert (packed.unpack_sorted(packed.pack_sorted(keys), n) == (keys & packed.TOP)).all()
    many = np.sort(rng.integers(0, 1 << 63, 1 << 17, dtype=np.uint64))
    assert len(packed.pack_sorted(many)) == 8 + 4 * len(many)
