"""Phrases whose words stand together more often than by chance, per language, with exact counts.

Texts are cut into pieces at punctuation and line ends, and pieces into words. Only words that occur LEAST
times can be in a phrase that does, so these alone get ids (a number for each pair of language and word, so
that an n-gram of ids is of one language). N-grams of ids are counted in counting quotient filters
(`quotient.py`): every task sorts and counts the permuted n-grams of a portion of its texts and sends the
filter on in segments, one for each quotient; segments of a quotient meet, whichever n-gram is frequent, and
are merged. Pairs are counted first; longer n-grams are counted where all their pairs are frequent, as a
bit table of bounded size says. The table may let an n-gram through, which costs a counter, but never holds
a frequent one back. The number of quotients follows the number of words, so that a task merges a bounded
number of counters.

Ids go to tasks as one sorted array of at most HEAD_WORDS numbers. If more words than that are frequent, the
most frequent ones get ids, and n-grams with another word in them are counted as strings by a plain
aggregate: the same result by a longer way, for the smaller part of the text.

Words are told apart by 64-bit hashes of language and word. That no two words share one is checked over all
distinct words; if two do, all is hashed anew with other numbers. Counts are exact.

Null texts are empty, a null language is `und`. Rows count each by itself, whatever their doc_id, repeated
ones too. Empty tables give no rows; other columns are ignored. Working memory is proportional to the longest
text.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.quotient import Shape
from tessella.llm.wordhash import SLICE_BYTES, mix, words
from tessella.llm.wordids import by_bytes
from tessella.storage import materialize

LEAST, ORDERS, TOP = 30, (2, 3, 4), 2000
#: A candidate goes if it is in a longer one that has at least 80 of 100 of its occurrences.
INSIDE_OF_100 = 80
SCALE = 2_000_000
#: Words that get ids.
HEAD_WORDS = 1 << 20
#: N-grams that a task holds, of all orders, before it counts those of the order with the most in one filter.
FILTER_GRAMS = 1 << 19
#: Counters of one quotient in all filters, about, and bits of the table of frequent pairs at most.
QUOTIENT_GRAMS = 1 << 20
LEAST_QUOTIENT_BITS, PAIR_TABLE_BITS = 6, 1 << 29

#: What parts words (blank and tab), and what ends a piece besides.
BLANKS, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"


class _Slice(NamedTuple):
    words: object
    keys: np.ndarray  #: hash of language and word
    joined: np.ndarray  #: whether a word is followed by the next one in its piece


def _slices(batches, seed: int, most: int = SLICE_BYTES):
    for batch in batches:
        for part in by_bytes(batch, "text", most):
            found = words(part.column("text"), seed, BLANKS + STOPS)
            langs = part.column("lang").to_pylist()
            marks = np.array([xxhash.xxh64_intdigest(x.encode(), seed) for x in langs], np.uint64)
            stop = np.zeros(256, np.int32)
            stop[list(STOPS)] = 1
            pieces = np.cumsum(stop[found.data], dtype=np.int32)[found.starts] if len(found.starts) else np.zeros(0, np.int32)
            joined = np.zeros(len(found.starts), bool)
            joined[:-1] = (pieces[1:] == pieces[:-1]) & (found.doc[1:] == found.doc[:-1])
            yield _Slice(found, mix(found.hashes + marks[found.doc]), joined), langs


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """((key, lang, word, n) of all distinct words, the seed under which keys are unique)."""
    for seed in itertools.count():

        def run(batches, seed=seed):
            for part, langs in _slices(batches, seed):
                keys, first, counts = np.unique(part.keys, return_index=True, return_counts=True)
                lang = pa.array(langs, pa.string()).take(pa.array(part.words.doc[first]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), lang, part.words.texts(first).cast(pa.string()), pa.array(counts.astype(np.int64))], names=["key", "lang", "word", "n"])

        counted = _input(docs).mapInArrow(run, "key long, lang string, word string, n long").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))
        counted = materialize(counted, "words")
        if counted.groupBy("key").count().where("count > 1").isEmpty():
            return counted, seed
    raise AssertionError("unreachable")


def _grams(ids: np.ndarray, joined: np.ndarray, order: int, wanted: np.ndarray) -> np.ndarray:
    """First places of the n-grams that lie in one piece and whose words are all wanted."""
    n = len(ids) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    fit = wanted[:n].copy()
    for k in range(1, order):
        fit &= joined[k - 1 : n + k - 1] & wanted[k : n + k]
    return np.flatnonzero(fit)


def _ids(keys: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted array `head`, or -1."""
    at = np.searchsorted(head, keys)
    at[at == len(head)] = 0
    return np.where(head[at] == keys, at, -1) if len(head) else np.full(len(keys), -1)


def _places(packed: np.ndarray, bits: int) -> np.ndarray:
    return mix(packed) >> np.uint64(64 - bits)


def _filters(docs: DataFrame, seed: int, head, orders: tuple[int, ...], shapes: dict[int, Shape], pairs=None) -> DataFrame:
    """(order, quotient, remainders, counts): segments of the filters of all tasks. pairs: broadcast (bit table, its bits)."""

    def run(batches):
        known, held, sizes = head.value, {order: [] for order in orders}, dict.fromkeys(orders, 0)

        def send(order):
            shape, parts = shapes[order], held[order]
            held[order], filled, sizes[order] = [], sizes[order], 0
            if filled:
                found = list(shape.segments(*shape.counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))))
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([order] * len(found), pa.int32()), *columns], names=["order", "quotient", "remainders", "counts"])

        for part, _ in _slices(batches, seed, SLICE_BYTES // 4):
            ids = _ids(part.keys, known)
            follows = part.joined
            if pairs is not None:
                table, bits = pairs.value
                both = _grams(ids, follows, 2, ids >= 0)
                place = _places(ids[both].astype(np.uint64) << np.uint64(32) | ids[both + 1].astype(np.uint64), bits)
                frequent = (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
                follows = np.zeros(len(ids), bool)
                follows[both[frequent == 1]] = True
            for order in orders:
                at = _grams(ids, follows, order, ids >= 0)
                held[order].append(shapes[order].permute(np.stack([ids[at + k] for k in range(order)], axis=1)))
                sizes[order] += len(at)
                if sum(sizes.values()) >= FILTER_GRAMS:
                    yield from send(max(sizes, key=sizes.get))
        for order in orders:
            yield from send(order)

    return _input(docs).mapInArrow(run, "order int, quotient long, remainders binary, counts binary")


def _merge(filters: DataFrame, shapes: dict[int, Shape], least: int) -> DataFrame:
    """(order, ids, n) of all n-grams that occur `least` times: segments of each quotient merged."""

    def merge(key, table):
        order, quotient = (x.as_py() for x in key)
        shape = shapes[order]
        left, right, n = shape.merged(quotient, table.column("remainders").to_pylist(), table.column("counts").to_pylist())
        many = np.flatnonzero(n >= least)
        grams = shape.restore(left[many], right[many])
        ids = pa.ListArray.from_arrays(pa.array(np.arange(len(many) + 1) * order, pa.int32()), pa.array(grams.ravel()))
        return pa.table([pa.array([order] * len(many), pa.int32()), ids, pa.array(n[many])], names=["order", "ids", "n"])

    return filters.groupBy("order", "quotient").applyInArrow(merge, "order int, ids array<long>, n long")


def _pair_table(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each hash of a frequent pair, in a table of at most PAIR_TABLE_BITS bits."""
    bits = max(16, min(PAIR_TABLE_BITS.bit_length() - 1, (16 * pairs.count()).bit_length()))

    def run(batches):
        for batch in batches:
            ids = batch.column("ids").flatten().to_numpy().astype(np.uint64).reshape(-1, 2)
            place = _places(ids[:, 0] << np.uint64(32) | ids[:, 1], bits)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["at", "bit"])

    rows = pairs.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table, bits


def _tail_grams(docs: DataFrame, seed: int, head, orders: tuple[int, ...], least: int) -> DataFrame:
    """(lang, phrase, order, n) of n-grams in which a word has no id, as strings."""

    def run(batches):
        for part, langs in _slices(batches, seed):
            known = _ids(part.keys, head.value) >= 0
            for order in orders:
                at = _grams(known, part.joined, order, np.ones(len(known), bool))
                at = at[~np.all([known[at + k] for k in range(order)], axis=0)] if len(at) else at
                flat = part.words.texts((at[:, None] + np.arange(order)).ravel())
                phrases = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.arange(len(at) + 1) * order, pa.int64()), flat), pa.scalar(" ", pa.large_string()))
                lang = pa.array(langs, pa.string()).take(pa.array(part.words.doc[at]))
                counted = pa.table([lang, phrases], names=["lang", "phrase"]).group_by(["lang", "phrase"]).aggregate([([], "count_all")])
                yield from pa.table([counted.column("lang"), counted.column("phrase").cast(pa.string()), pa.array([order] * len(counted), pa.int32()), counted.column("count_all")], names=["lang", "phrase", "order", "n"]).combine_chunks().to_batches()

    rows = _input(docs).mapInArrow(run, "lang string, phrase string, order int, n long")
    return rows.groupBy("lang", "phrase", "order").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrase_counts(docs: DataFrame, least: int = LEAST, orders: tuple[int, ...] = ORDERS, head_words: int = HEAD_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, order, n) of all phrases of one word or of `orders` words that occur `least` times, (lang, total) of all words)."""
    spark = docs.sparkSession
    counted, seed = word_counts(docs)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counted.where(F.col("n") >= least)
    cut = least
    while counted.where(F.col("n") >= cut).count() > head_words:
        cut *= 2
    keys = counted.where(F.col("n") >= cut).select("key").toArrow().column("key").to_numpy().view(np.uint64)
    keys = np.sort(keys)
    head = spark.sparkContext.broadcast(keys)
    width = max(1, (max(len(keys), 2) - 1).bit_length())
    n_words = counted.agg(F.sum("n")).first()[0] or 0
    quotient_bits = max(LEAST_QUOTIENT_BITS, (n_words // QUOTIENT_GRAMS).bit_length())
    shapes = {order: Shape(order, width, quotient_bits) for order in (2, *orders)}

    found = materialize(_merge(_filters(docs, seed, head, (2,), shapes), shapes, least), "pairs")
    longer = tuple(order for order in orders if order > 2)
    if longer:
        table = spark.sparkContext.broadcast(_pair_table(found))
        found = found.unionByName(_merge(_filters(docs, seed, head, longer, shapes, table), shapes, least))

    def named(batches):  # ids to keys
        for batch in batches:
            ids = batch.column("ids")
            keys = pa.array(head.value[ids.flatten().to_numpy()].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("order"), pa.ListArray.from_arrays(ids.offsets, keys), batch.column("n")], names=["order", "keys", "n"])

    numbered = materialize(found.mapInArrow(named, "order int, keys array<long>, n long").withColumn("gram", F.monotonically_increasing_id()), "grams")
    spelled = numbered.select("gram", "order", F.col("n").alias("times"), F.posexplode("keys").alias("at", "key")).join(frequent.select("key", "lang", "word"), "key")
    parts = F.array_sort(F.collect_list(F.struct("at", "word")))
    phrases = spelled.groupBy("gram", "order").agg(F.first("lang").alias("lang"), F.array_join(F.transform(parts, lambda x: x["word"]), " ").alias("phrase"), F.first("times").alias("n"))
    phrases = phrases.select("lang", "phrase", "order", "n")
    if cut > least:
        phrases = phrases.unionByName(_tail_grams(docs, seed, head, orders, least))
    single = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("order"), "n")
    return materialize(single.unionByName(phrases), "phrases"), totals


def _part(begin: int | Column, end: int | Column) -> Column:
    """Words [begin, end) of the array `words`, joined."""
    return F.array_join(F.slice("words", F.lit(begin) + 1 if isinstance(begin, int) else begin + 1, end - begin), " ")


def collocations(docs: DataFrame, least: int = LEAST, orders: tuple[int, ...] = ORDERS, top: int = TOP, head_words: int = HEAD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language, best first.

    A phrase's score is that of its worst cut in two: SCALE * a / (l + r), rounded down, where a, l and r count the whole
    and its parts. Ties go to the earlier cut, and between phrases to the larger count and then to the smaller phrase in
    byte order.
    """
    counts, totals = phrase_counts(docs, least, orders, head_words)
    candidates = counts.where("order > 1").select("lang", "phrase", "order", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.select("lang", "phrase", "order", "a", "words", F.explode(F.sequence(F.lit(1), F.col("order") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(0, F.col("k")).alias("left"), _part(F.col("k"), F.col("order")).alias("right"))
    count = counts.select("lang", "phrase", "n")
    cuts = cuts.join(count.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(count.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) div (CAST(l AS DECIMAL(20, 0)) + r)"))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    longest = max(orders)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("order") - 1), lambda m: F.transform(F.sequence(F.lit(0), F.col("order") - m), lambda i: F.array_join(F.slice("words", i + 1, m), " "))))
    inside = candidates.where("order > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(inside, ["lang", "phrase"], "left") if longest > 2 else worst.withColumn("longer", F.lit(None).cast("long"))
    kept = kept.where(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {INSIDE_OF_100}")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    best = ranked.where(F.col("rank") <= top)
    return best.join(totals.withColumnRenamed("total", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
