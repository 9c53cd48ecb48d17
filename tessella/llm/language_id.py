"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 characters of words padded with a
blank on either side), most frequent first. A text gets a profile of its own; the distance to a
language is the sum, over the text's n-grams, of how far out of place each is, an n-gram that the
language lacks counting as the profile's length. The nearest language wins; ties go to the name that
sorts first.

Training takes at most FIT_ROWS texts of each language, those with the smallest hashes of doc_id; of rows
that share a language and a doc_id the text that sorts first is taken. Whole texts are
profiled, in training and in prediction. lang, source and doc_id are never inputs of a prediction. A text that is null or has no letter gives `und` with score 0; without any training row
every text does. Equal frequencies rank by the n-gram itself. Repeated rows are predicted alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.storage import materialize

FIT_ROWS = 2_000
#: Names in `lang` up to which a table with a row per name is broadcast; beyond it is joined by a shuffle.
MOST_LANGUAGES = 10_000
#: n-grams of a profile.
PROFILE = 300
SIZES = (1, 2, 3)
#: Characters that are counted at once.
BLOCK = 1 << 18
UNKNOWN = "und"

_BITS = 21  # of a code point
_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or the blank's if it is no letter."""
    if not _table:
        table = np.full(0x110000, 0x20, np.int32)
        for x in range(0x110000):
            c = chr(x)
            if c.isalpha():
                low = c.lower()
                table[x] = ord(low) if len(low) == 1 else x
        _table.append(table)
    return _table[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as packed code points, counts) of a whole text; no letters give none."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    table, tail = _letters(), np.array([0x20], np.int64)
    for at in range(0, len(points), BLOCK):
        x = np.concatenate((tail, table[points[at : at + BLOCK]].astype(np.int64)))
        if at + BLOCK >= len(points):
            x = np.append(x, 0x20)
        x = x[np.concatenate(([True], (x[1:] != 0x20) | (x[:-1] != 0x20)))]  # runs of blanks are one
        grams = []
        for size in SIZES:
            packed = x[: len(x) - size + 1].copy()
            inner = np.zeros(len(packed), bool)
            for k in range(1, size):
                part = x[k : len(x) - size + 1 + k]
                packed = (packed << _BITS) | part
                if k < size - 1:
                    inner |= part == 0x20
            keep = ~inner  # no n-gram reaches over a word's end
            if size == 1:
                keep &= x != 0x20
            if at:  # those that lie in the overlap were counted before
                keep[: max(0, len(tail) - size + 1)] = False
            grams.append(packed[keep])
        new, n = np.unique(np.concatenate(grams), return_counts=True)
        both = np.concatenate((codes, new))
        codes, back = np.unique(both, return_inverse=True)
        counts = np.bincount(back, np.concatenate((counts, n)), len(codes)).astype(np.int64)
        tail = x[-(max(SIZES) - 1) :]
    letters = codes != ((0x20 << _BITS) | 0x20)
    return codes[letters], counts[letters]


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    return codes[np.lexsort((codes, -counts))[:most]]


@dataclass
class Profiles:
    names: list[str]
    ranks: list[np.ndarray]

    def __post_init__(self):
        self.codes = np.unique(np.concatenate(self.ranks)) if self.ranks else np.zeros(0, np.int64)
        self.place = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for row, codes in zip(self.place, self.ranks, strict=True):
            row[np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, profile)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == profile[known]
        places = self.place[:, np.where(known, at, len(self.codes))]
        return np.where(places < 0, PROFILE, np.abs(places - np.arange(len(profile)))).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is the nearest distance's lead over the next, from 0 to 1."""
        profile = ranked(*ngrams(text))
        if not len(profile) or not self.names:
            return UNKNOWN, 0.0
        d = self.distances(profile)
        order = np.argsort(d, kind="stable")
        worst = PROFILE * len(profile)
        if len(order) == 1:
            return self.names[0], float(1 - d[0] / worst)
        return self.names[order[0]], float(min(1.0, (d[order[1]] - d[order[0]]) / max(1, d[order[1]])))


def _bytes(codes: np.ndarray) -> list[bytes]:
    return [c.to_bytes(8, "big", signed=True) for c in codes.tolist()]


def _small(rows: DataFrame, name: str) -> DataFrame:
    """A table of one row per language, broadcast if its rows are as few as languages are."""
    rows = materialize(rows, name)
    return F.broadcast(rows) if rows.count() <= MOST_LANGUAGES else rows


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Profiles:
    """Profiles of the languages in docs (doc_id, text, lang), null languages and texts aside."""
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    narrow = known.select("lang", "h")
    # The texts don't move: a number per language picks them where they are read. First a cutoff that leaves about twice
    # the rows, so that only those few are ranked, then the hash of the last row that fits.
    sizes = _small(narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    share = F.least(F.lit(1.0), F.lit(2.0 * fit_rows + 100) / F.col("n"))
    near = narrow.join(sizes, "lang").where(F.col("h").cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)).select("lang", "h")
    ranks = near.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= fit_rows)
    limits = _small(ranks.groupBy("lang").agg(F.max("h").alias("limit")), "language-limits")
    texts = known.join(limits, "lang").where("h <= limit").groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches):
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, seen in by.items():
                codes, back = np.unique(np.concatenate([c for c, _ in seen]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in seen]), len(codes)).astype(np.int64)
                for a in range(0, len(codes), 1 << 15):
                    part = codes[a : a + (1 << 15)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[a : a + (1 << 15)])], names=["lang", "code", "n"])

    totals = texts.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = materialize(totals.withColumn("place", place).where(F.col("place") <= PROFILE), "profiles").orderBy("lang", "place").collect()
    names = sorted({r["lang"] for r in best})
    return Profiles(names, [np.array([r["code"] for r in best if r["lang"] == x], np.int64) for x in names])


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                said = [profiles.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
