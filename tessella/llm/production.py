"""Operators with the parameters and files that the registered queries and the pipeline use."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import packing, toxicity

PACK_END, FILE_END, TOKEN_LIMIT = 2, 1, 1024


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def pack_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of all documents in training sequences, with a digest of their ids."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), PACK_END)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model | None:
    """The model of the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(3) != 1)
    return toxicity.fit(docs, labels)
