"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of fixed size. The hash of a chunk is a polynomial in its bytes modulo a
prime, and two hashes combine by length-shifted arithmetic: hash(AB) = hash(A) * r^len(B) + hash(B).
So the chunks of a huge document are dealt out over all tasks, hashed on their own, and combined in the
order of the document; the result is that of hashing it from end to end. Three primes of 31 bits give
about 93 bits, which with the length are a fingerprint.

Texts with equal fingerprints are not yet taken as equal: every member of a class is compared with the
class's representative chunk by chunk. Members that differ start a class of their own, and are
compared again until nobody differs.

Texts are equal when they are identical after lower-casing A-Z. Null counts as empty and is equal to
it. Of equal texts the row with the largest doc_id stays, with its repetitions; null doc_ids count as
smallest, and are compared like any other. Different texts under one doc_id are judged apart, but
drop_exact_duplicates, which goes by doc_id, keeps both if one stays. An empty table gives no rows; other
columns are ignored (drop_exact_duplicates keeps them all). A text is held whole by the task that reads it,
three times over.

The rows of one large class meet in one task where their count comes back to them. They are narrow
(numbers and digests, no texts), and adaptive execution splits that join when they grow.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.columns import unused
from tessella.llm.wordids import by_bytes
from tessella.storage import materialize

PRIMES = (2147483647, 2147483629, 2147483587)
BASE = 1_000_003
CHUNK = 1 << 16
#: Bytes of a text beyond which its chunks are hashed by many tasks.
HUGE = 16 << 20
#: Members of a class that are compared with one copy of the representative's chunk.
SALT_MEMBERS = 512
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Fingerprint:
    """Polynomial hashes modulo `primes`; (length, residues) is a monoid under `combine`."""

    def __init__(self, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK):
        self.primes, self.chunk = primes, chunk
        self.powers = np.ones((len(primes), chunk), np.int64)
        for row, p in zip(self.powers, primes, strict=True):
            x = 1
            for i in range(chunk):
                row[chunk - 1 - i] = x
                x = x * BASE % p

    def of_chunk(self, data: bytes) -> tuple[int, tuple[int, ...]]:
        x = np.frombuffer(data, np.uint8).astype(np.int64) + 1
        n = len(x)
        return n, tuple(int((w[self.chunk - n :] @ x) % p) for w, p in zip(self.powers, self.primes, strict=True))

    def combine(self, a: tuple[int, tuple[int, ...]], b: tuple[int, tuple[int, ...]]) -> tuple[int, tuple[int, ...]]:
        return a[0] + b[0], tuple((x * pow(BASE, b[0], p) + y) % p for x, y, p in zip(a[1], b[1], self.primes, strict=True))

    def of(self, data: bytes) -> tuple[int, tuple[int, ...]]:
        whole = (0, (0,) * len(self.primes))
        for at in range(0, len(data), self.chunk):
            whole = self.combine(whole, self.of_chunk(data[at : at + self.chunk]))
        return whole


def normalise(texts: pa.Array) -> list[bytes]:
    """UTF-8 with A-Z in lower case."""
    return [(t or "").encode().lower() for t in texts.to_pylist()]  # bytes.lower() is ASCII's


def _whole_text(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def _who(doc_id: Column, digest: Column) -> Column:
    """The number of a row in comparisons, by which and its digest it is known: its doc_id, or for a null one a number from the digest."""
    return F.coalesce(doc_id, -1 - F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))


def _cut(docs: DataFrame, primes: tuple[int, ...], chunk: int, huge: int) -> DataFrame:
    """A row per text with its fingerprint, or, for texts of more than `huge` bytes, a row per chunk of it."""

    def run(batches):
        own, task = Fingerprint(primes, chunk), TaskContext.get().partitionId() << 40
        types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        for batch in batches:
            for part in by_bytes(batch, "text"):
                rows: list[tuple] = []
                for doc_id, data in zip(part.column("doc_id").to_pylist(), normalise(part.column("text")), strict=True):
                    digest = hashlib.sha256(data).hexdigest()
                    if len(data) > huge:
                        rows += [(doc_id, digest, task, None, k, data[at : at + chunk]) for k, at in enumerate(range(0, len(data), chunk))]
                    else:
                        n, residues = own.of(data)
                        rows.append((doc_id, digest, task, n.to_bytes(8, "big") + b"".join(x.to_bytes(4, "big") for x in residues), None, None))
                    task += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "text_sha256", "row", "fingerprint", "chunk", "data"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text_sha256 string, row long, fingerprint binary, chunk int, data binary")


def combined(chunks: DataFrame, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_sha256, fingerprint) of texts given as rows (doc_id, text_sha256, row, chunk, data): hashed in parallel, then combined."""

    def run(batches):
        own = Fingerprint(primes, chunk)
        for batch in batches:
            hashed = [own.of_chunk(x) for x in batch.column("data").to_pylist()]
            sizes = [n for n, _ in hashed]
            shifts = [[pow(BASE, n, p) for p in primes] for n in sizes]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text_sha256", "row", "chunk")), pa.array(sizes, pa.int64()), pa.array([list(r) for _, r in hashed], pa.list_(pa.int64())), pa.array(shifts, pa.list_(pa.int64()))],
                names=["doc_id", "text_sha256", "row", "chunk", "size", "residues", "shifts"],
            )

    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = chunks.select("doc_id", "text_sha256", "row", "chunk", "data").repartition(n, "row", "chunk").mapInArrow(run, "doc_id long, text_sha256 string, row long, chunk int, size long, residues array<long>, shifts array<long>")
    whole = hashed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"), F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("chunk", "residues", "shifts"))).alias("parts"))

    def residue(k: int) -> Column:
        return F.aggregate("parts", F.lit(0).cast("long"), lambda x, part: (x * part["shifts"][k] + part["residues"][k]) % primes[k])

    digits = [F.lpad(F.hex("size"), 16, "0"), *(F.lpad(F.hex(residue(k)), 8, "0") for k in range(len(primes)))]
    return whole.select("doc_id", "text_sha256", F.unhex(F.concat(*digits)).alias("fingerprint"))


def fingerprints(docs: DataFrame, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """(doc_id, who, fingerprint, text_sha256) of every row."""
    cut = materialize(_cut(docs, primes, chunk, huge), "fingerprints")
    whole = cut.where("chunk is null").select("doc_id", "text_sha256", "fingerprint")
    chunks = cut.where("chunk is not null")
    if not chunks.isEmpty():
        whole = whole.unionByName(combined(chunks, primes, chunk))
    return whole.withColumn("who", _who(F.col("doc_id"), F.col("text_sha256")))


def _texts(docs: DataFrame) -> DataFrame:
    """(who, text_sha256, text) of every row; of rows that repeat a task sends on one."""
    digest = F.sha2(_whole_text(F.col("text")), 256)
    rows = docs.select(_who(F.col("doc_id").cast("long"), digest).alias("who"), digest.alias("text_sha256"), "text")

    def run(batches):
        seen: set[tuple[int, str]] = set()
        for batch in batches:
            keep = []
            for key in zip(batch.column("who").to_pylist(), batch.column("text_sha256").to_pylist(), strict=True):
                keep.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "who long, text_sha256 string, text string")


_CHUNK = "who long, text_sha256 string, fingerprint binary, class_who long, class_sha256 string, members long, chunk int, data binary"


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Every chunk of every text, lower-cased; an empty text has one empty chunk."""
    names = [x.split()[0] for x in _CHUNK.split(", ")]

    def run(batches):
        for batch in batches:
            for i, data in enumerate(normalise(batch.column("text"))):
                parts = [data[at : at + chunk] for at in range(0, max(1, len(data)), chunk)]
                kept = [pa.array([batch.column(c)[i].as_py()] * len(parts), batch.column(c).type) for c in names[:-2]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return rows.select(*names[:-2], "text").mapInArrow(run, _CHUNK)


def differing(docs: DataFrame, members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(who, text_sha256, fingerprint) of members (who, text_sha256, fingerprint, class_who, class_sha256, members)
    whose text is not that of the row that class_who and class_sha256 name.

    The representative's chunks are copied once per few hundred members, and members are dealt out
    over the copies: a class that holds a third of all rows is compared by many tasks.
    """
    cut = _chunks(_texts(docs).join(members.hint("shuffle_hash"), ["who", "text_sha256"]), chunk)
    salts = F.ceil(F.col("members") / SALT_MEMBERS).cast("int")
    itself = (F.col("who") == F.col("class_who")) & (F.col("text_sha256") == F.col("class_sha256"))
    own = cut.where(~itself).withColumn("salt", F.pmod(F.xxhash64("who", "text_sha256"), salts.cast("long")).cast("int"))
    representative = cut.where(itself).select("fingerprint", "class_who", "class_sha256", "chunk", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("data").alias("first")).distinct()
    same = own.join(representative, ["fingerprint", "class_who", "class_sha256", "chunk", "salt"], "left")
    return same.where(F.col("first").isNull() | (F.col("first") != F.col("data"))).select("who", "text_sha256", "fingerprint").distinct()


def exact_duplicates(docs: DataFrame, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    key = ["who", "text_sha256", "fingerprint"]
    open_ = materialize(fingerprints(docs, primes, chunk, huge).select("doc_id", *key), "prints")
    done = None
    while True:
        groups = open_.groupBy("fingerprint").agg(F.max(F.struct("who", "text_sha256")).alias("class"), F.count(F.lit(1)).alias("members")).select("fingerprint", F.col("class.who").alias("class_who"), F.col("class.text_sha256").alias("class_sha256"), "members")
        shared = materialize(open_.join(groups.where("members > 1"), "fingerprint").select(*key, "class_who", "class_sha256", "members").distinct(), "classes")
        wrong = materialize(differing(docs, shared, chunk), "differing")
        if wrong.isEmpty():
            break
        # Whoever agrees with the representative is settled under its class; the others go round again.
        agreed = open_.join(wrong, key, "left_anti").join(groups, "fingerprint").withColumn("fingerprint", F.concat("fingerprint", F.col("class_who").cast("string").cast("binary"), F.col("class_sha256").cast("binary"))).select(open_.columns)
        done = agreed if done is None else done.unionByName(agreed)
        open_ = materialize(open_.join(wrong, key, "left_semi"), "open")
    settled = open_ if done is None else materialize(done.unionByName(open_), "settled")
    first = F.coalesce("doc_id", F.lit(-(2**63)))
    many = settled.groupBy("fingerprint").agg(F.max("doc_id").alias("keep_id"), F.max(first).alias("top"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return settled.join(many, "fingerprint", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(first == F.col("top"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id stays; all columns are kept."""
    (stays,) = unused(docs, "stays")
    stay = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias(stays)).distinct()
    return docs.join(stay.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(stays)), "left_semi")
