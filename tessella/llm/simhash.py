"""Near-duplicates by SimHash, found through deletion-variant signatures.

A fingerprint has 64 bits; two link when at most 3 bits differ. Cut into two segments of 32 bits, one
segment differs by at most one bit. So each segment is indexed under its 32 one-wildcard variants: the
segment with one bit position named and cleared. Two segments within one bit of each other share the
variant at the differing position, and equal segments share all; an equality join on (segment,
position, variant) therefore finds every link, and each candidate is verified on all 64 bits.

Copies cost nothing: the index holds distinct fingerprints, and documents join back by theirs. A pair
is looked at in one bucket only: that of the first segment that differs by at most one bit, at the
position of the difference, or at position 0 if the segments are equal. Inside a bucket links are
reduced to a spanning forest, so n fingerprints give at most n - 1 links. Buckets are sorted runs
inside a shuffle partition and are compared in blocks of bounded memory; a bucket of more than
SPLIT_BUCKET fingerprints is dealt out again by the bytes of the other segment (at most 3 of whose 32
bits differ, so one of its 4 bytes is equal), and what is still too large by the four 6-bit parts of the
other 24 bits, of which one is equal, too; neither loses anything.

Texts without words, null ones included, have fingerprint zero and link like any other. Repeated rows
link to each other; a null doc_id counts as no member for the smallest id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.columns import unused
from tessella.llm.graph import components
from tessella.storage import materialize

#: Distinct fingerprints of a bucket beyond which it is dealt out by bytes of the other segment.
SPLIT_BUCKET = 20_000
#: Pairs of fingerprints that are compared at once.
BLOCK_PAIRS = 1 << 22
SEED = 42


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text; 0 if it has no words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: len(parts) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], seed) for a, b in cuts], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                prints = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """(bucket, fp): the 64 one-wildcard variants of each fingerprint; bucket packs segment, position and variant."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    exploded = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"), low.alias("low"), high.alias("high"))
    segment = F.when(F.col("k") < 32, F.col("low")).otherwise(F.col("high"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("k", F.lit(32)))
    cleared = segment.bitwiseAND(F.bitwise_not(bit))
    return exploded.select(F.call_function("shiftleft", F.col("k").cast("long"), F.lit(32)).bitwiseOR(cleared).alias("bucket"), "fp")


def bucket_links(prints: np.ndarray, k: int, most: int = 3) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links that belong to bucket k (segment k // 32, position k % 32)."""
    n = len(prints)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    mask, shift = np.uint64(0xFFFFFFFF), np.uint64(32 * (k // 32))
    bit = np.uint64(1) << np.uint64(k % 32)
    block = max(1, BLOCK_PAIRS // max(1, n))
    for a in range(0, n - 1, block):
        differ = prints[a : a + block, None] ^ prints[None, a + 1 :]
        near = np.bitwise_count(differ) <= most
        rows, columns = np.nonzero(near)
        keep = columns + 1 > rows  # each pair once
        rows, columns = rows[keep], columns[keep]
        d = differ[rows, columns]
        own = (d >> shift) & mask
        here = (own == bit) | ((own == 0) if k % 32 == 0 else False)
        if k >= 32:  # the first segment had the pair if it differs by at most one bit
            here &= np.bitwise_count(d & mask) > 1
        for i, j in zip((rows[here] + a).tolist(), (columns[here] + a + 1).tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield i, j


def _links(rows: DataFrame, split: int | None) -> DataFrame:
    """Links (a, b) inside the buckets of rows (bucket, key, fp), each a sorted run of one partition.

    A bucket of more than `split` fingerprints is passed on instead, as rows (bucket, fp, key, over).
    """

    def out(links: list[tuple[int, int]]):
        a, b = ([x[i] for x in links] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(a), pa.int64()), pa.array([False] * len(a))], names=["a", "b", "key", "over"])

    def passed(buckets: np.ndarray, keys: np.ndarray, prints: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(prints), pa.array(keys), pa.array(np.ones(len(prints), bool))], names=["a", "b", "key", "over"])

    def emit(bucket: int, prints: np.ndarray):
        for i, j in bucket_links(prints.view(np.uint64), bucket >> 32):
            yield int(prints[i]), int(prints[j])

    def run(batches):
        rest: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(3))
        large: tuple[int, int] | None = None  # the run that is being passed on
        for batch in batches:
            new = tuple(batch.column(c).to_numpy() for c in ("bucket", "key", "fp"))
            buckets, keys, prints = (np.concatenate(x) for x in zip(rest, new, strict=True))
            if large is not None:
                n = int(np.argmin(np.append((buckets == large[0]) & (keys == large[1]), False)))
                yield passed(buckets[:n], keys[:n], prints[:n])
                buckets, keys, prints = buckets[n:], keys[n:], prints[n:]
                if not len(buckets):
                    rest = buckets, keys, prints
                    continue
                large = None
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1])) + 1
            starts = np.concatenate(([0], change))
            many = np.flatnonzero(np.diff(starts) > 1)
            links: list[tuple[int, int]] = []
            for a, b in zip(starts[many].tolist(), starts[many + 1].tolist(), strict=True):
                if split and b - a > split:
                    yield passed(buckets[a:b], keys[a:b], prints[a:b])
                else:
                    links += emit(int(buckets[a]), prints[a:b])
            if links:
                yield out(links)
            last = int(starts[-1])
            rest = buckets[last:], keys[last:], prints[last:]
            if split and len(rest[0]) > split:
                large = int(rest[0][0]), int(rest[1][0])
                yield passed(rest[0], rest[1], rest[2])
                rest = tuple(x[:0] for x in rest)
        if len(rest[0]) > 1 and (links := list(emit(int(rest[0][0]), rest[2]))):
            yield out(links)

    return rows.mapInArrow(run, "a long, b long, key long, over boolean")


def links(prints: DataFrame, split: int = SPLIT_BUCKET) -> DataFrame:
    """(a, b) for enough pairs of distinct fingerprints with at most 3 differing bits to connect all that are linked."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.select("bucket", "key", "fp").repartition(n, "bucket", "key").sortWithinPartitions("bucket", "key", "fp")

    found = materialize(_links(placed(variants(prints).withColumn("key", F.lit(0).cast("long"))), split), "links")
    edges = found.where("not over").select("a", "b")
    large = found.where("over").select(F.col("a").alias("bucket"), F.col("b").alias("fp"))
    if large.isEmpty():
        return edges
    other = F.when(F.shiftright("bucket", 32) < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    byte = lambda i: F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255))
    dealt = large.select("bucket", "fp", F.explode(F.array(*[byte(i) + 256 * i for i in range(4)])).alias("key"))
    again = materialize(_links(placed(dealt), split), "links")
    edges = edges.unionByName(again.where("not over").select("a", "b"))
    large = again.where("over").select(F.col("a").alias("bucket"), F.col("b").alias("fp"), "key")
    if large.isEmpty():
        return edges
    # the three bytes that are not the key's, as one number of 24 bits
    parts = [F.when(F.col("key") < 256 * (i + 1), byte(i + 1)).otherwise(byte(i)) for i in range(3)]
    rest = parts[0] + parts[1] * 256 + parts[2] * 65536
    sixths = F.array(*[F.shiftrightunsigned(rest, 6 * j).bitwiseAND(F.lit(63)) + 64 * j for j in range(4)])
    finer = large.select("bucket", "fp", "key", F.explode(sixths).alias("part")).withColumn("key", F.col("key") * 256 + F.col("part"))
    return edges.unionByName(_links(placed(finer), None).select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    prints = materialize(fingerprints(docs), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp")))
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id of each component, and those without one; all columns are kept.

    Rows that share a doc_id stay or go together: if the text of one of them stays, all do.
    """
    (stays,) = unused(docs, "stays")
    stay = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias(stays)).distinct()
    return docs.join(stay.hint("shuffle_hash"), docs["doc_id"] == F.col(stays), "left_semi").unionByName(docs.where("doc_id is null"))
