"""The registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checking_sql, collocations, decontamination, divergence, html_text, jaccard_join, license_rules, ordinal_quality, packing, quality_rules, secrets, sharding, substring_dedup, url_model


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def tokenizer_path() -> str:
    """The ranks of byte_bpe_50k.json: the same ids in a third of the time."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    out = decontamination.decontaminate(read(spark, sf, "documents"), read(spark, sf, "benchmark"), window=10)
    return out.drop("spans")


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.spans(read(spark, sf, "documents"))


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_rules.scan(read(spark, sf, "documents"))


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"), tokenizer_path(), size=1024)


def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf, "documents"))


def op6_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(read(spark, sf, "pages"))


def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf, "documents"), k=4, num=85, den=100)


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf, "documents")).drop("source", "host_rate")


def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return ordinal_quality.score(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = sharding.shard(read(spark, sf, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.mine(read(spark, sf, "documents"))


def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(read(spark, sf, "documents"))


def op13_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_model.judge(read(spark, sf, "pages")).drop("score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (
        op1_decontamination, op2_substring_dedup, op3_license_scan, op4_packing, op5_secret_scan, op6_html_extraction, op7_jaccard_join, op8_quality_rules,
        op9_quality_classifier, op10_sharding, op11_collocations, op12_source_divergence, op13_url_filter,
    )
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(checking_sql.SQL)
