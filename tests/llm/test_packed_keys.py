"""Word hashes of many texts at once, and keys that are counted packed."""

import brute
import numpy as np
from pyspark.sql import functions as F

from bandwright.llm import common, jaccard_join

ODD = ["", " ", "a", "a b c", " a  b\tc\nd ", "a b c d", "A b C d e", "\x0b\x0c\r", "é ß 漢字 x y", "a\x1cb c d e", "x " * 50, "q" * 700 + " r s t u"]


def test_sets_of_many_texts_are_those_of_each(monkeypatch):
    for piece in (1 << 18, 64, 5):
        monkeypatch.setattr(common, "PIECE", piece)
        texts = [t.encode().translate(common.LOWER) for t in ODD]
        got = common.shingle_sets(texts, 4)
        assert [len(s) for s in got] == [len(brute.shingle_set(t, 4)) for t in ODD]
        for s, t in zip(got, texts):
            assert (s == common.shingle_sets([t], 4)[0]).all()


def test_words_have_one_hash_wherever_they_stand():
    words = [b"w%d" % i for i in range(5000)] + [bytes([97 + i % 2, 97 + i % 3, 97 + i % 5]) for i in range(30)]
    (h, n), = common.hashed_words([b" ".join(words)])
    (again, _), = common.hashed_words([b"  " + b" \n".join(words[::-1])])
    assert n.tolist() == [len(words)] and (h == again[::-1]).all()
    assert len(np.unique(h)) == len(set(words))


def test_keys_are_counted_in_few_rows(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 40}x{j}" for j in range(60))) for i in range(80)], "doc_id long, text string")
    sets = jaccard_join._sets(docs.repartition(4), 4, 85, 100)
    want = {r.key >> 24 for r in sets.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").collect()}
    assert {r.h >> 24 for r in jaccard_join._twice(sets).collect()} == want and want


def test_rows_that_repeat_give_their_keys_once(spark):
    text = " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(1, text)] * 5 + [(2, text + " more")] * 3 + [(3, text)], "doc_id long, text string")
    sets = jaccard_join._sets(docs, 4, 85, 100)
    first = sets.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "row")).alias("of")).select("of.row")
    keys = jaccard_join._shared_keys(sets, first, 85, 100)
    assert keys.count() == keys.select("key", "id").distinct().count() > 0
    assert {r.component_id for r in jaccard_join.join(docs, 4, 85, 100).collect()} == {1}
