"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import collocations, exact, language_id, minmax, quality, runs, sentence_pieces, simhash, substring, token_counts, token_files, toxicity
from tessella.llm.production import FILE_END, TOKEN_LIMIT, pack_pieces, remainder, toxicity_model
from tessella.llm.sql import oracle_sql  # noqa: F401  registered with the queries
from tessella.storage import new_folder


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document shares with one of smaller doc_id."""
    return substring.passages(_documents(spark, sf_dir))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and whether decoding them gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = sentence_pieces.decode(sentence_pieces.encode(docs, model), model)
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "token-counts"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), FILE_END, new_folder(spark, "token-files"))
    return token_files.read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    profiles = language_id.fit(docs.where(remainder(4) != 2).select("doc_id", "text", "lang"))
    return language_id.predict(docs, profiles).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_documents(spark, sf_dir), loops=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (
        op1_substring_dedup,
        op2_simhash_dedup,
        op3_sentencepiece,
        op4_packing,
        op5_toxicity,
        op6_token_counts,
        op7_token_files,
        op8_exact_dedup,
        op9_language_id,
        op10_quality_rules,
        op11_minmax_dedup,
        op12_periodic_runs,
        op13_collocations,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}

