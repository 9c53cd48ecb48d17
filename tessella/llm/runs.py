"""Periodic runs of words, found online by dyadic catchers.

The words of a stream are appended in portions. Whenever a block of 2^k words, at a multiple of 2^k, is
complete, it becomes a *catcher*: it waits for its own words to come again at a distance of 2^k to
2^(k+1) - 1, which is checked for every window that the appended words complete. Any run whose length is at
least four periods holds a whole block of the largest power of two that is at most its period, and that
block's next copy, so some catcher sees it. What a catcher sees opens a comparison: the words before it are
compared backwards once, and every portion that is appended moves the comparison of the suffix on, until
two words differ. A comparison that has gone on for a period is a square; squares of one period that touch
are one comparison, which is the run. The same stretch under multiples of its period is reported once, with
the smallest.

Windows and suffixes are compared by running sums of word ids (one polynomial hash of any window), and the
runs that come out are compared word by word in the end; should they differ anywhere, the search is repeated
with other numbers. The runs are therefore exact. Each word costs a few operations for each k, and all of
them are array operations over a portion, in which all texts of a slice follow each other, parted by numbers
that occur once.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.wordhash import mix, powers
from tessella.llm.wordids import by_bytes

#: A run holds so many periods, and so many words, at least.
PERIODS, LEAST_WORDS = 4, 6
#: Words that are appended at once.
PORTION = 1 << 16
#: Bytes of text whose words are in memory at once; a longer text stands alone.
SLICE_BYTES = 3 << 20


class Catchers:
    """Maximal stretches of period q with at least `periods` periods and `least` words, over a growing list of words."""

    def __init__(self, capacity: int, longest: int, seed: int = 0, periods: int = PERIODS, least: int = LEAST_WORDS):
        """capacity: words that will be appended; longest: words that the longest run can have."""
        self.periods, self.least, self.n = periods, least, 0
        self.levels = [1 << k for k in range(max(longest // periods, 0).bit_length())]
        base = int(np.random.default_rng(seed).integers(1, 2**62)) * 2 + 1
        self.power, self.inverse = powers(base, capacity), powers(pow(base, -1, 2**64), capacity + 1)
        self.sums = np.zeros(capacity + 1, np.uint64)
        self.open = np.zeros((3, 0), np.int64)  # start, period and end so far of comparisons that go on
        self.closed: list[np.ndarray] = []

    def _hash(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.inverse[at]

    def _forward(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words from `at` on equal those a period earlier, as far as words have come."""
        return self._extent(at - period, at, self.n - at, 1)

    def _backward(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words before `at` equal those a period later."""
        return self._extent(at, at + period, at, -1)

    def _extent(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        found = np.zeros(len(a), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            step = 1 << k
            go = np.flatnonzero(found + step <= most)
            x, y = a[go] + way * found[go], b[go] + way * found[go]
            x, y = (x, y) if way > 0 else (x - step, y - step)
            found[go[self._hash(x, step) == self._hash(y, step)]] += step
        return found

    def _sort_out(self, found: np.ndarray) -> np.ndarray:
        """Keep what has come to an end; return what goes on."""
        on = found[2] == self.n
        start, period, end = done = found[:, ~on]
        self.closed.append(done[:, end - start >= np.maximum(self.least, self.periods * period)])
        return found[:, on]

    def append(self, words: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(words)
        self.sums[old + 1 : self.n + 1] = self.sums[old] + np.cumsum(mix(words.astype(np.uint64)) * self.power[old : self.n], dtype=np.uint64)
        start, period, end = self.open
        going = [self._sort_out(np.stack((start, period, end + self._forward(end, period))))]
        for size in self.levels:
            low, high = max(size, old - size + 1), self.n - size  # windows that these words complete
            if high < low:
                continue
            before = max(size, low - size)
            windows = self._hash(np.arange(before, high + 1), size)
            catchers = self._hash(np.arange(before // size - 1, high // size) * size, size)
            place = np.arange(before, high + 1) // size - before // size
            same = windows == catchers[place]
            new = same.copy()
            new[size:] &= ~same[:-size]  # else the catcher before has opened this comparison
            at = np.flatnonzero(new[low - before :]) + low
            block = (at // size - 1) * size
            period = at - block
            start = block - self._backward(block, period)
            end = at + size
            going.append(self._sort_out(np.stack((start, period, end + self._forward(end, period)))))
        self.open = np.concatenate(going, axis=1)

    def runs(self) -> np.ndarray:
        """(start, length, period) of all runs so far, by start and then period; no more words come."""
        start, period, end = self.open
        last = self.open[:, end - start >= np.maximum(self.least, self.periods * period)]
        start, period, end = np.concatenate([*self.closed, last], axis=1)
        order = np.lexsort((period, end, start))
        start, period, end = start[order], period[order], end[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # multiples of the smallest period
        start, period, end = start[first], period[first], end[first]
        order = np.lexsort((period, start))
        return np.stack((start, end - start, period))[:, order]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def find_runs(words: np.ndarray, longest: int, portion: int = PORTION, periods: int = PERIODS, least: int = LEAST_WORDS) -> np.ndarray:
    """(start, length, period) of all runs of a list of word ids."""
    for seed in itertools.count():
        catchers = Catchers(len(words), longest, seed, periods, least)
        for at in range(0, len(words), portion):
            catchers.append(words[at : at + portion])
        start, length, period = found = catchers.runs()
        here = _ranges(start, length - period)
        if np.array_equal(words[here], words[here + np.repeat(period, length - period)]):
            return found
    raise AssertionError("unreachable")


class _Texts(NamedTuple):
    """Words of a slice: `source` says which of the words as written stands at each place."""

    written: pa.Array
    source: np.ndarray
    ids: np.ndarray
    doc: np.ndarray
    counts: np.ndarray


def _looped(doc_ids: list[int | None], counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each word, which of the words as written it takes: one document in ten, by its doc_id, is made to loop."""
    source = np.arange(int(counts.sum()))
    for i, n, o in zip(doc_ids, counts.tolist(), begins.tolist(), strict=True):
        if i is None or not n:
            continue
        g, r = divmod(zlib.crc32(str(i).encode()), 10)
        if r == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[o + a : o + n] = o + a + np.arange(n - a) % p
    return source


def _read(texts: pa.Array, doc_ids: list[int | None], loops: bool) -> _Texts:
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    bounds, flat = split.offsets.to_numpy(), split.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(split)), np.diff(bounds))[real]
    written = flat.filter(pa.array(real))
    counts = np.bincount(owner, minlength=len(split)).astype(np.int64)
    keyed = written.dictionary_encode()
    ids = keyed.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(counts) - counts
    source = _looped(doc_ids, counts, begins) if loops else np.arange(len(ids))
    return _Texts(written, source, ids[source], owner, counts)


def _describe(texts: _Texts) -> tuple[list, ...]:
    """Columns of the result, one value for each text."""
    docs = len(texts.counts)
    begins = np.cumsum(texts.counts) - texts.counts + np.arange(docs)  # of each text in the stream, with an end mark after each
    stream = np.empty(len(texts.ids) + docs, np.int64)
    stream[begins + texts.counts] = -1 - np.arange(docs)
    stream[np.arange(len(texts.ids)) + texts.doc] = texts.ids
    start, length, period = find_runs(stream, int(texts.counts.max(initial=0)))
    doc = np.searchsorted(begins, start, "right") - 1
    local = start - begins[doc]

    n_runs = np.bincount(doc, minlength=docs)
    best: list[list[int | None]] = [[None] * docs for _ in range(4)]
    order = np.lexsort((period, local, -length, doc))
    for i in order[np.flatnonzero(np.diff(doc[order], prepend=-1))].tolist():
        p, size = int(period[i]), int(length[i])
        for column, v in zip(best, (int(local[i]), size, p, 1000 * size // p), strict=True):
            column[doc[i]] = v

    listed = [""] * docs
    lines = [f"{a},{b},{c}\n" for a, b, c in zip(local.tolist(), length.tolist(), period.tolist(), strict=True)]
    ends = np.cumsum(n_runs).tolist()
    for i in np.flatnonzero(n_runs).tolist():
        listed[i] = "".join(lines[ends[i] - n_runs[i] : ends[i]])

    change = np.zeros(len(stream) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = (np.cumsum(change[:-1]) == 0) & (stream >= 0)
    mine = kept[np.arange(len(texts.ids)) + texts.doc]
    sizes = np.bincount(texts.doc[mine], minlength=docs)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int64())
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(offsets, texts.written.take(pa.array(texts.source[mine]))), pa.scalar(" ", pa.large_string()))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return n_runs.tolist(), *best, [sha(x.encode()) for x in listed], collapsed, [sha(x) for x in collapsed.cast(pa.large_binary()).to_pylist()]


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, loops: bool = False) -> DataFrame:
    """The runs of each text and the text with every run cut to its first period, one row per row of docs.

    n_runs; start, length, period and exponent_milli of the longest run (ties: smallest start, then period; nulls if there
    is none); runs_sha256 of all runs as lines `start,length,period`; collapsed, the words that stay, joined by blanks,
    and its collapsed_sha256. With `loops`, one document in ten (by its doc_id) is first made to repeat itself from some word on.

    Null texts are empty ones; texts without words or runs have no run and collapse to their words. Repeated rows are
    judged alike, each by itself. A null doc_id stays null, and its text never loops. An empty table gives no rows; other
    columns are ignored. Working memory is proportional to the longest text; no row leaves its partition.
    """

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                texts = _read(part.column("text"), part.column("doc_id").to_pylist(), loops)
                n_runs, start, length, period, exponent, runs_sha, collapsed, collapsed_sha = _describe(texts)
                numbers = [pa.array(x, pa.int64()) for x in (n_runs, start, length, period, exponent)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *numbers, pa.array(runs_sha), collapsed.cast(pa.string()), pa.array(collapsed_sha)], names=["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {COLUMNS}")
