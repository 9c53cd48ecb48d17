"""Token counts through a digest cache.

A text's count depends on its content and the tokenizer alone, so counts are stored under the pair of
both digests. A run joins its digests to the stored counts, encodes one text of each digest that is
missing, and appends the new counts to the cache, which is a folder of Parquet files. Texts that occur
a million times are encoded once; a later run over the same texts encodes nothing.

The digest is the SHA-256 of the whole text in UTF-8; null counts as empty. Rows are counted as often
as they occur, equal doc_ids included; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.wordids import by_bytes, load_tokenizer, worker_once
from tessella.storage import drop_folder, materialize

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Missing digests up to which they are broadcast (of about 50 bytes each).
BROADCAST_ROWS = 10_000
#: Counts of word pieces that a worker keeps.
CACHE_PARTS = 500_000

#: A run of blanks or line feeds with the word after it; letters before a final full stop or comma are
#: a part of their own. Byte-level vocabularies split at all of these places.
PART = re.compile(r"[ \n]*(?:[^\W\d_]+(?=[.,](?:[ \n]|$))|[^ \n]+)|[ \n]+")
#: White space other than these two, and the strings of special tokens, are left to the library.
ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]|<\|")


def tokenizer_digest(path: str) -> str:
    """Identity of a tokenizer version: the digest of its file, and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class PartCounter:
    """Token counts of texts; each distinct part of a text is encoded once."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.parts: dict[str, int] = {}

    def count(self, text: str) -> int:
        if ODD.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = PART.findall(text)
        known = self.parts
        counts = list(map(known.get, parts))
        if None in counts:
            missing = list({p for p, n in zip(parts, counts, strict=True) if n is None})
            if len(known) + len(missing) > CACHE_PARTS:
                known.clear()
                missing = list(set(parts))
            for at in range(0, len(missing), 4096):
                some = missing[at : at + 4096]
                known.update(zip(some, map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
            counts = map(known.__getitem__, parts)
        return sum(counts)


def _encode(texts: DataFrame, path: str) -> DataFrame:
    def run(batches):
        counter = worker_once("counts", path, lambda: PartCounter(path))
        done: set[bytes] = set()  # repeated rows of one doc_id come to one task
        for batch in batches:
            for part in by_bytes(batch, "text"):
                digests, counts = [], []
                for digest, text in zip(part.column("digest").to_pylist(), part.column("text"), strict=True):
                    if digest not in done:
                        done.add(digest)
                        digests.append(digest)
                        counts.append(counter.count(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def _append(texts: DataFrame, missing: DataFrame, n: int, tokenizer_path: str, version: str, cache: str) -> None:
    """Encode one text of each of the n missing (digest, doc_id) and store the counts.

    Few of them are picked by a broadcast, where the texts are read; of many the narrow side is the hash table of
    a shuffled join, and the texts stream past it unsorted.
    """
    one = (texts["doc_id"].eqNullSafe(missing["doc_id"])) & (texts["digest"] == missing["digest"])
    chosen = texts.join(F.broadcast(missing) if n <= BROADCAST_ROWS else missing.hint("shuffle_hash"), one, "left_semi")
    fresh = _encode(chosen.select("digest", "text"), tokenizer_path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of docs; `cache` is the folder of stored counts."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = materialize(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    missing = materialize(keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored, "digest", "left_anti"), "missing")
    if (n := missing.count()):  # with a full cache no text moves
        _append(texts, missing, n, tokenizer_path, version, cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def forget(docs: DataFrame, cache: str) -> None:
    """Remove a cache."""
    drop_folder(docs.sparkSession, cache)
