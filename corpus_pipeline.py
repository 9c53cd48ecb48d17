"""A training-data pipeline: toxic texts out, exact and near copies out, repeated passages out, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, and further ones that
docs has, whatever their names: columns that a stage adds for itself get names that docs hasn't. An empty
table gives an empty one in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.exact import drop_exact_duplicates
from tessella.llm.production import pack_pieces, toxicity_model
from tessella.llm.simhash import drop_near_duplicates
from tessella.llm.substring import cut_passages, passages
from tessella.llm.toxicity import drop_toxic as without_toxic
from tessella.storage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go.

    Rows with null or empty texts stay, as no term of a lexicon is in them; repeated rows are judged alike;
    rows without a doc_id are judged, but never learned from.
    """
    return without_toxic(docs, toxicity_model(spark, docs, sf_dir))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal after lower-casing, the one with the largest doc_id stays.

    Null texts are equal to empty ones. Repeated rows of the doc_id that stays all stay, and so do other texts under it;
    rows without a doc_id stay if no row with one has their text.
    """
    return drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays.

    Texts without words, null ones included, are near-duplicates of each other. Rows that share a doc_id stay or go together;
    rows without a doc_id stay.
    """
    return drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A passage of 50 words or more stays in the document with the smallest doc_id only.

    Texts that are cut and have no word left go; null and empty texts stay. Rows that share a doc_id are cut alike and not
    compared with each other; rows without a doc_id are neither compared nor cut.
    """
    return cut_passages(docs, passages(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences.

    Null and empty texts are an end token alone; every row is packed, repeated ones and those without a doc_id too; other
    columns are left out.
    """
    return pack_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: The classifier, fingerprints over UTF-8 hashes, components and passages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
