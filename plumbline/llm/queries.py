"""Queries of this subpackage: one opN_<name> for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, common, licenses, packing, pivots, quality, quantise, simhash, substring, tokenfile, urls

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = common.place(spark, "tokens")
    tokenfile.write(_t(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), uri)
    return tokenfile.read_digests(spark, uri)


def op2_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_t(spark, sf_dir, "embeddings"))


def op3_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_t(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_t(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op5_simhash_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_t(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_t(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(_t(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_url_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    return urls.judge(urls.dated(pages), urls.sample_list(pages))


def op9_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op10_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.nearest(_t(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_files, op2_pivot_index, op3_license_bands, op4_packing, op5_simhash_graph, op6_byte_bpe, op7_substring_dedup, op8_url_timeline, op9_line_field, op10_additive_quantisation)}


def oracle_sql() -> dict:
    """Those that SQL can express; tests hold the others against brute force, a round trip or held-out rows."""
    return {"op3_license_bands": licenses.sql(), "op8_url_timeline": urls.SQL}
