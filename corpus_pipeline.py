"""A training-corpus pipeline: five stages, each written and read again by the next.

Every stage works on all documents that its predecessor kept. All but the last return the columns of
``documents``; the last returns the token ids. Columns that ``documents`` does not have are dropped, whatever their
names. Null and empty texts are kept as documents like any other, texts are processed whole however long, and an
empty table passes through every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contourflow.llm.bpe import encode_documents
from contourflow.llm.common import scratch
from contourflow.llm.mixing import mix_sources
from contourflow.llm.simhash import keep_representatives
from contourflow.llm.suffix_dedup import remove_repeats
from contourflow.llm.toxicity import with_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5.

    Null ids are scored like any other, rows that repeat alike; without labels of both classes nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_toxicity(docs.select(*COLUMNS), labels).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash component.

    Null ids come last and ties go by a hash of the text. Texts without words are one component, repeated rows too.
    """
    return keep_representatives(docs.select(*COLUMNS), radius=4, words=4)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that occur more than once.

    A null text becomes an empty one; ``n_chars`` is counted again. A document may become empty and stays.
    """
    carry = ("doc_id", "lang", "source")
    cut = remove_repeats(docs, length=200, with_text=True, carry=carry)
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it.

    A document that the mix begins to take once more is taken whole; one without words stays once. A null source is
    a source of its own. Documents that tie in size go by a hash of id and text.
    """
    mixed = mix_sources(docs.select(*COLUMNS))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size")).cast("int"))
    taken = mixed.withColumn("copies", copies).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every document; a null text has no ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(docs, path, public_tokenizers.PATTERN, with_ids=True, batch_bytes="8m")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: The stages' models and hashes are beyond SQL; tests compare their operators with brute-force versions, not the whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``. What they wrote is removed from the shared folder when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch(spark, "pipeline")
    for name, stage in STAGES:
        out = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
