"""The corpus operators as registered queries over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, warc
from .bpe import encode_documents
from .embedding_dedup import embedding_components
from .paragraph_dedup import paragraph_duplicates
from .simhash import simhash_components
from .suffix_dedup import remove_repeats
from .topk import top_inner_products
from .toxicity import score_toxicity
from .url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, factor=1024.0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, batch_bytes="8m")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), length=200)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"), radius=4, words=4, seed=42)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_table(spark, sf_dir, "pages"), least_bytes=100)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(mixing.measured(_table(spark, sf_dir, "documents")), is_measured=True)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8, shingle=5, passage=50)


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_topk": op2_topk,
    "op3_bpe": op3_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_paragraph_dedup": op10_paragraph_dedup,
}

ORACLE_SQL = {"op6_warc": warc.SQL, "op8_mixing": mixing.SQL}
