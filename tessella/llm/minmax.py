"""Near-duplicates by min-max hashing of word shingles, with every link confirmed on full sets.

A document is the set of its distinct shingles. Under each of PERMUTATIONS permutations both the smallest and
the largest value of a set are kept, so that each evaluation of a hash function gives two values of the
signature. Sets of similarity s agree in a value with probability s, for smallest and largest alike. Two
permutations, so four values, are a *band*; sets that agree in a band share a bucket. At a similarity of 0.8
all bands miss with a probability of 5 in 100 million.

Equal sets are one from the start. In the buckets candidate pairs are told by their sketches (a byte of each
value): those whose number of equal bytes lies within six standard deviations of what similarity 0.8 gives. Pairs
that can't be similar are refuted there as well: a set's *tally* counts its elements by CELLS hash values, and two
sets share no more elements than their tallies have in common, which is close to the truth for sets of up to a few
times CELLS elements. A pair is taken in its first common
band only, by the last half of the bands' keys. Then, round by round:

1. every set of a bucket is paired with the most similar one that is not larger, and the smallest sets of the
   parts of a large bucket with each other;
2. in buckets whose sets are not all connected yet, every set is paired with the most similar one that it is
   not connected to;
3. in buckets that are still not connected, all candidate pairs that are not connected and not refuted.

Pairs of all buckets are brought together, and each is confirmed once, on the full sets of both. Links of
each round connect sets for the next one, so that groups of copies cost a pair for each member. After the third
round any two sets that share a bucket are connected, refuted, or told apart by their sketches. A bucket of more
than PART sets is dealt out over parts in the first round, and over a grid of parts later, in which only sets
outside its largest component are sent to several cells. No cell holds more than about two PARTs of rows.

A document without words has an empty set and links with nothing; a null text counts as empty. Fewer words than
a shingle has are one shingle as a whole. Repeated rows have equal sets, and so are linked. Rows without a doc_id
are not compared; their component_id is null and they are kept. Different texts under one doc_id are different
sets. An empty table gives no rows; other columns are ignored. Working memory is proportional to the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.graph import components
from tessella.llm.wordhash import SLICE_BYTES, mix, words
from tessella.llm.wordids import by_bytes
from tessella.storage import materialize

WORDS, SIMILARITY_OF_100 = 2, 80
PERMUTATIONS, BAND = 64, 2
BANDS = PERMUTATIONS // BAND
#: Equal bytes of two sketches from which on a pair is confirmed: at a similarity of 0.8 fewer are as rare as 1 in 10^8.
LEAST_EQUAL = 76
#: Hash values by which a set's elements are counted, and the largest count; sets that pass it anywhere have no tally.
CELLS, LARGEST_COUNT = 512, 15
#: Sets of a bucket that are compared with each other by one task at once.
PART = 2048
#: Documents whose shingles a permutation is evaluated for at once, in shingles.
BLOCK_SHINGLES = 1 << 16
#: Keys up to which the texts to confirm are picked by a broadcast: 24 MB.
BROADCAST_KEYS = 1_000_000

_RANDOM = np.random.default_rng(11)
_FACTORS = _RANDOM.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIPS = _RANDOM.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_LAST_HALF = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text in order, texts one after another; how many each text has)."""
    found = words(texts)
    doc, n = found.doc, len(found.doc)
    counts = np.bincount(doc, minlength=len(texts))
    value = found.hashes.copy()
    for k in range(1, size):  # of texts with fewer words, the first word stands for the whole
        value[: n - k] = np.where(doc[: n - k] == doc[k:], value[: n - k] * np.uint64(0x9E3779B97F4A7C15) + found.hashes[k:], value[: n - k]) if n > k else value[: n - k]
    value = mix(value + np.minimum(counts, size).astype(np.uint64)[doc])
    place = np.arange(n) - (np.cumsum(counts) - counts)[doc]
    value = value[place < np.maximum(counts - size + 1, 1)[doc]]
    sizes = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        value[a:b].sort()
    if not len(value):
        return value, sizes
    new = np.append(True, value[1:] != value[:-1])
    new[(ends - sizes)[sizes > 0]] = True
    distinct = np.zeros(len(sizes), np.int64)
    distinct[sizes > 0] = np.add.reduceat(new.astype(np.int64), (ends - sizes)[sizes > 0])
    return value[new], distinct


def signatures(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Smallest and largest value under each permutation: (sets, 2 * PERMUTATIONS), for sets that aren't empty."""
    out = np.empty((len(sizes), 2 * PERMUTATIONS), np.uint32)
    ends = np.cumsum(sizes)
    block = (ends - 1) // BLOCK_SHINGLES
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    short = (values >> np.uint64(32)).astype(np.uint32)
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        first = int(ends[a] - sizes[a])
        part, starts = short[first : ends[b - 1]], ends[a:b] - sizes[a:b] - first
        for k in range(PERMUTATIONS):
            hashed = (part ^ _FLIPS[k]) * _FACTORS[k]
            out[a:b, 2 * k] = np.minimum.reduceat(hashed, starts)
            out[a:b, 2 * k + 1] = np.maximum.reduceat(hashed, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key of each band of BAND permutations, so of 2 * BAND values."""
    width = 2 * BAND
    out = np.empty((len(signature), 2 * PERMUTATIONS // width), np.uint64)
    for band in range(out.shape[1]):
        key = np.full(len(signature), band, np.uint64)
        for k in range(width):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, band * width + k])
        out[:, band] = key
    return out


def digests(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16 bytes for each set (none of them empty), the same in any order of its elements."""
    starts = np.cumsum(sizes) - sizes
    halves = (np.add.reduceat(mix(values), starts), np.add.reduceat(mix(values ^ _LAST_HALF), starts)) if len(sizes) else (np.zeros(0, np.uint64),) * 2
    return np.stack(halves, axis=1)


def tallies(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Counts of each set's elements by the last bits of their hashes, two counts a byte; 255 throughout where a count is too large."""
    out = np.empty((len(sizes), CELLS // 2), np.uint8)
    ends = np.cumsum(sizes)
    for a in range(0, len(sizes), 512):
        some = sizes[a : a + 512]
        part = values[ends[a] - sizes[a] : ends[a + len(some) - 1]]
        seat = np.repeat(np.arange(len(some)), some) * CELLS + (part % np.uint64(CELLS)).astype(np.int64)
        counts = np.bincount(seat, minlength=len(some) * CELLS).reshape(-1, CELLS)
        out[a : a + 512] = counts[:, ::2] + (counts[:, 1::2] << 4)
        out[a : a + 512][counts.max(axis=1) >= LARGEST_COUNT] = 255
    return out


def may_be_similar(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether what the tallies of two sets have in common would do for the similarity; true if either has none."""
    low, high = np.minimum(a & 15, b & 15), np.minimum(a >> 4, b >> 4)
    both = (low + high).sum(axis=1, dtype=np.int64)
    return (100 * both >= SIMILARITY_OF_100 * (n_a + n_b - both)) | (a == 255).all(axis=1) | (b == 255).all(axis=1)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an array of binary values."""
    rows = np.ascontiguousarray(rows)
    size = rows.view(np.uint8).reshape(len(rows), -1).shape[1] if len(rows) else 0
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _rows(column: pa.Array, size: int) -> np.ndarray:
    """Binary values of one size as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, key, sketch, marks, tally, bands) of every row; the last five are null for texts without words."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                values, sizes = shingle_sets(part.column("text"))
                full = np.flatnonzero(sizes)
                signature = signatures(values, sizes[full])
                seat = np.full(len(sizes), -1)
                seat[full] = np.arange(len(full))
                seat = pa.array(seat, mask=seat < 0)
                keys = band_keys(signature).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                columns = [_fixed(digests(values, sizes[full])), _fixed((signature >> np.uint32(8)).astype(np.uint8)), _fixed(keys.astype(np.uint32)), _fixed(tallies(values, sizes[full])), bands]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes.astype(np.int64)), *(c.take(seat) for c in columns)], names=["doc_id", "n_shingles", "key", "sketch", "marks", "tally", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, key binary, sketch binary, marks binary, tally binary, bands array<long>")


def _equal_bytes(same: np.ndarray) -> np.ndarray:
    """How many values of each row are true."""
    bits = np.packbits(same, axis=1).view(np.uint64)
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def cell_pairs(cell: np.ndarray, band: np.ndarray, n: np.ndarray, sketch: np.ndarray, marks: np.ndarray, tally: np.ndarray, side: np.ndarray, group: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (places i < j) within runs of equal `cell`, whose rows stand by rising size n and share `band`.

    Rows of one group are connected already. Sides 0 and 1 are compared with each other only, 2 with all. how: `earlier`
    gives for each row the most similar one before it, `best` the most similar one anywhere, `all` every candidate.
    """
    rows = len(cell)
    best, mate = np.zeros(rows, np.int64), np.full(rows, -1)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    active, gap = np.arange(rows), 0
    while len(active):
        gap += 1
        active = active[active + gap < rows]
        other = active + gap
        active = active[(cell[active] == cell[other]) & (100 * n[active] >= SIMILARITY_OF_100 * n[other])]
        other = active + gap
        fit = (group[active] != group[other]) & ((side[active] != side[other]) | (side[active] == 2))
        i, j = active[fit], other[fit]
        for at in range(0, len(i), 1 << 15):
            a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            same = sketch[a] == sketch[b]
            good = np.flatnonzero(_equal_bytes(same) >= LEAST_EQUAL)
            good = good[(marks[a[good]] == marks[b[good]]).argmax(axis=1) == band[a[good]]]
            good = good[may_be_similar(tally[a[good]], tally[b[good]], n[a[good]], n[b[good]])]
            a, b, equal = a[good], b[good], _equal_bytes(same[good])
            if how == "all":
                out.append((a, b))
                continue
            for x, y in ((b, a),) if how == "earlier" else ((b, a), (a, b)):  # each row stands in a and in b once
                more = equal > best[x]
                best[x[more]], mate[x[more]] = equal[more], y[more]
    if how == "all":
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    found = np.flatnonzero(mate >= 0)
    return np.minimum(found, mate[found]), np.maximum(found, mate[found])


_CARRIED = ("band", "key", "root")
_MEMBER = "bucket, cell, band, n_shingles, side, key, root, sketch, marks, tally"


def _pairs(members: DataFrame, how: str) -> DataFrame:
    """(a, b), a < b: candidate pairs of keys of members (the columns of _MEMBER), each once."""
    buckets = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]):
        rest = None

        def found(table: pa.Table):
            same = np.stack([table.column(c).to_numpy() for c in ("bucket", "cell")], axis=1)
            cell = np.cumsum(np.append(True, (same[1:] != same[:-1]).any(axis=1)))
            keys, sketch, tally, root = (_rows(table.column(c), size) for c, size in (("key", 16), ("sketch", 2 * PERMUTATIONS), ("tally", CELLS // 2), ("root", 16)))
            group = np.unique(np.ascontiguousarray(root).view(np.uint64).reshape(-1, 2), axis=0, return_inverse=True)[1].ravel()
            band, n, side = (table.column(c).to_numpy() for c in ("band", "n_shingles", "side"))
            marks = np.ascontiguousarray(_rows(table.column("marks"), 4 * BANDS)).view(np.uint32)
            i, j = cell_pairs(cell, band, n, sketch, marks, tally, side, group, how)
            return pa.RecordBatch.from_arrays([_fixed(keys[i]), _fixed(keys[j])], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            last = (table.column("bucket")[-1].as_py(), table.column("cell")[-1].as_py())
            held = int(((table.column("bucket").to_numpy() == last[0]) & (table.column("cell").to_numpy() == last[1])).sum())
            if held < len(table):
                yield found(table.slice(0, len(table) - held))
            rest = table.slice(len(table) - held).combine_chunks()
        if rest is not None and len(rest):
            yield found(rest)

    placed = members.select(_MEMBER.split(", ")).repartition(buckets, "bucket", "cell").sortWithinPartitions("bucket", "cell", "n_shingles")
    pairs = placed.mapInArrow(run, "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def confirmed(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar. sets: (key, first), one row for each distinct set."""

    def read(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                values, sizes = shingle_sets(part.column("text"))
                full = np.flatnonzero(sizes)
                ends = np.cumsum(sizes)[full].tolist()
                held = [values[e - n : e].tobytes() for e, n in zip(ends, sizes[full].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([_fixed(digests(values, sizes[full])), pa.array(held, pa.binary())], names=["key", "elements"])

    def judge(batches):
        for batch in batches:
            keep, seen = [], (None, None)
            left, right = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                raw = left[i].as_buffer()
                if seen[0] is None or not raw.equals(seen[0]):
                    seen = raw, np.frombuffer(raw, np.uint64)
                mine, theirs = seen[1], np.frombuffer(right[i].as_buffer(), np.uint64)
                small, large = (mine, theirs) if len(mine) <= len(theirs) else (theirs, mine)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                keep.append(100 * both >= SIMILARITY_OF_100 * (len(small) + len(large) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    needed = materialize(sets.select("key", "first").join(nodes, "key", "left_semi"), "needed")
    ids = needed.select(F.col("first").alias("doc_id")).distinct()
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(F.broadcast(ids) if needed.count() <= BROADCAST_KEYS else ids.hint("shuffle_hash"), "doc_id", "left_semi")
    full = materialize(texts.select("text").mapInArrow(read, "key binary, elements binary").groupBy("key").agg(F.first("elements").alias("elements")), "sets")
    joined = pairs.join(full.select(F.col("key").alias("a"), F.col("elements").alias("left")), "a").join(full.select(F.col("key").alias("b"), F.col("elements").alias("right")), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(judge, "a binary, b binary")


def _grid(members: DataFrame) -> DataFrame:
    """Members (bucket, band, key, root) of buckets with several roots, dealt out to cells: (bucket, cell, side, band, key, root).

    A bucket of up to PART sets is one cell. Of a larger one each set is in one of its parts, and those outside the largest
    component come to all parts as the other side, in parts of their own.
    """
    by_root = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    sizes = by_root.groupBy("bucket").agg(F.sum("k").alias("m"), F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    sizes = sizes.select("bucket", F.col("top.root").alias("top"), F.ceil(F.col("m") / PART).cast("long").alias("homes"), F.greatest(F.ceil((F.col("m") - F.col("top.k")) / PART), F.lit(1)).cast("long").alias("visits"))
    rows = members.join(sizes, "bucket")
    small = rows.where("homes = 1").select("bucket", F.lit(0).cast("long").alias("cell"), F.lit(2).alias("side"), *_CARRIED)
    large = rows.where("homes > 1")
    home, visit = F.pmod(F.xxhash64("key"), F.col("homes")), F.pmod(F.xxhash64("key", F.lit(1)), F.col("visits"))
    stay = large.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("visits") - 1)).alias("v")).select("bucket", (home * F.col("visits") + F.col("v")).alias("cell"), F.lit(1).alias("side"), *_CARRIED)
    move = large.where("root != top").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1)).alias("h")).select("bucket", (F.col("h") * F.col("visits") + visit).alias("cell"), F.lit(0).alias("side"), *_CARRIED)
    return small.unionByName(stay).unionByName(move)


def linked_sets(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of the keys of sets (key, first, n_shingles, sketch, marks, tally, bands) that are linked with others."""
    # The counts and the join read one shuffle, since both ask for the same columns of it.
    exploded = sets.select("key", F.posexplode("bands").alias("band", "bucket")).repartition("bucket")
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "band")).alias("lead")).where("m > 1").select("bucket", "m", F.col("lead.key").alias("lead"))
    members = materialize(exploded.join(shared, "bucket"), "members")
    # What is wide travels for sets that share a bucket only, and not before their cells are known.
    facts = materialize(sets.select("key", "n_shingles", "sketch", "marks", "tally").join(members.select("key").distinct(), "key", "left_semi"), "facts")
    dealt = members.select("bucket", F.pmod(F.xxhash64("bucket", "key"), F.ceil(F.col("m") / PART).cast("long")).alias("cell"), F.lit(2).alias("side"), "band", "key", F.col("key").alias("root"), "m", "lead")
    parts = dealt.where(F.col("m") > PART).groupBy("bucket", "cell", "lead").agg(F.min("key").alias("key")).where("key != lead")
    tested = materialize(_pairs(dealt.join(facts, "key"), "earlier").unionByName(parts.select(F.col("lead").alias("a"), F.col("key").alias("b"))).distinct(), "pairs")
    links = materialize(confirmed(docs, sets, tested), "links")
    roots = components(links)
    for how in ("best", "all"):
        placed = members.select("bucket", "band", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "band", "key", F.coalesce("root", "key").alias("root"))
        candidates = materialize(_pairs(materialize(_grid(placed), "cells").join(facts, "key"), how), "pairs")
        if candidates.isEmpty():
            break
        pairs = materialize(candidates.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        new = materialize(confirmed(docs, sets, pairs), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = components(links)
    return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; component_id is the smallest doc_id reachable over links."""
    found = materialize(prints(docs), "prints")
    live = found.where("key is not null and doc_id is not null")
    sets = materialize(live.groupBy("key").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n_shingles", "sketch", "marks", "tally", "bands")]), "distinct-sets")
    roots = linked_sets(docs, sets)
    classes = sets.select("key", "first").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, "root").select("key", "component_id")
    out = found.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
