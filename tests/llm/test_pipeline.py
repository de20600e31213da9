"""The stages of the pipeline on a small table with every awkward case, against plain Python."""

import collections

import brute
import corpus_pipeline
import pytest

from bandwright.llm import packing, queries


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    """A folder with the case texts as documents, and small labels and benchmark tables."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    held = [r.text for r in docs.where("length(text) BETWEEN 900 AND 2500").orderBy("doc_id").select("text").collect()]
    spark.createDataFrame([("q1", held[-1][30:200]), ("q2", None), (None, "x")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_words, r.key) for r in df.collect())


def test_stage_names_and_columns(spark, sf, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "decontamination", "secrets", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_near_duplicates_keep_one_of_each_group(spark, sf, docs):
    want = brute.linked([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
    kept = rows(corpus_pipeline.near_duplicates(spark, docs, sf))
    assert kept == collections.Counter({k: n for k, n in rows(docs).items() if k[0] is None or want[k[0]][1] == k[0]})


def test_decontamination_drops_hit_documents_only(spark, sf, docs):
    items = [(r.item_id, r.text) for r in queries.read(spark, sf, "benchmark").collect() if r.item_id]
    kept = rows(corpus_pipeline.decontaminated(spark, docs, sf))
    assert kept == collections.Counter({k: n for k, n in rows(docs).items() if k[0] is None or not brute.contamination(k[1], items)[4]})


def test_secrets_change_only_texts_with_secrets(spark, sf, docs):
    out = collections.Counter({k: n for k, n in rows(corpus_pipeline.without_secrets(spark, docs, sf)).items()})
    clean = {k: n for k, n in rows(docs).items() if not brute.secrets(k[1])[1]}
    assert sum(out.values()) == docs.count()
    lost = {k for k in clean if k not in out}
    assert all("9fQ2xLw7Zr0KpVt3Ys8Bn1Hc6Md4Gj5A" in k[1] for k in lost)
    assert not any(brute.secrets(k[1])[1] for k in out)


def test_whole_run(spark, sf):
    docs = queries.read(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    encode = packing.Encoder(queries.tokenizer_path())
    want = collections.Counter()
    for r in docs.collect():
        want[r.doc_id] += len(encode(r.text or "")) // 4 + 1
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_stages_on_an_empty_table(spark, sf, docs):
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
