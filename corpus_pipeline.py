"""From raw documents to packed sequences: classifier, near duplicates, decontamination, secrets, packing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.llm import decontamination, jaccard_join, ordinal_quality, packing, queries, secrets
from bandwright.llm.common import bitmap, in_bitmap
from bandwright.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return ordinal_quality.select(docs, queries.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard 0.8): the one with the smallest id. Rows
    that repeat a doc_id are one document and stay or go together; rows without an id stay."""
    groups = jaccard_join.join(docs, k=5, num=80, den=100)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return _without(docs, cut(gone))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    hit = decontamination.decontaminate(docs, queries.read(spark, sf_dir, "benchmark"))
    return _without(docs, cut(hit.where("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct()))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found secret replaced by a mark."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids."""
    return packing.pack(docs, queries.tokenizer_path(), size=1024)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]
# Training, hashing, tokenizing and best-fit have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose doc_id is not in a written table of ids; all columns as they were. Texts stay where they are: a bitmap
    of fixed size tells the rows that may go, and only these are moved for the exact join."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(F.xxhash64("doc_id").alias("h")), "h"))

    @F.arrow_udf("boolean")
    def may_go(h: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(held.value, h.to_numpy(zero_copy_only=False)))

    marked = docs.withColumn("__may_go", may_go(F.xxhash64("doc_id")))
    stay = marked.where("__may_go").join(gone, "doc_id", "left_anti").select(*docs.columns)
    return marked.where("NOT __may_go").select(*docs.columns).unionAll(stay)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
