"""Toxicity by weak supervision.

1. A lexicon is induced from labelled training rows: words and word beginnings that stand out in toxic
   texts by a log-likelihood ratio of their counts. Near copies among those rows
   (equal in a min-hash) count as one text.
2. Voters look at a text: groups of lexicon entries, and patterns (an insult in a phrase that addresses
   somebody, repeated hits, shouting, exclamation marks, no hit at all). Each votes toxic, clean or
   abstains.
3. A generative label model estimates each voter's accuracy by expectation maximisation, without
   labels, and the voters' correlations given the class; correlated voters share their weight.
4. A linear classifier over the lexicon entries and pattern figures is trained on the model's posterior
   labels. It scores every text.

Training takes at most FIT_ROWS labelled rows, those with the smallest hashes of doc_id; scoring covers
every whole text; of rows that share a doc_id the fit takes one text. Labels, lang, source and doc_id are never inputs of a score. Null and empty texts get
the score of a text without any hit. Repeated rows are scored alike; labels that contradict each other
count as toxic; without labelled rows, or without a toxic one, every text scores 0. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.columns import unused
from tessella.llm.substring import WORDS, tokens
from tessella.storage import materialize

FIT_ROWS = 20_000
#: Most entries of the lexicon.
LEXICON = 3000
#: Smallest log-likelihood ratio of an entry (one in ten million by chance), and fewest distinct toxic texts that
#: have it. Neither depends on how many other toxic texts there are.
LEAST_RATIO, LEAST_TEXTS = 28.0, 3
#: Standard errors by which a text with an entry must be likelier toxic than clean, were both equally frequent.
SURE = 3.0
#: Groups that lexicon entries are dealt to; each group is a voter.
WORD_GROUPS, START_GROUPS = 12, 6
START_SIZES = (4, 5)
PATTERNS = 5
VOTERS = WORD_GROUPS + START_GROUPS + PATTERNS
THRESHOLD = 0.7

_WORDS = re.compile(r"[^\W\d_]+")
_CAPITALS = re.compile("[%s]+" % "".join(c for c in map(chr, range(0x2FFF)) if c.isupper()))
_FRAME = re.compile(r"\b(?:is|are|you|your|such|an?|the|est|ist|es|un|une|ein|eine|der|la|le|el)\s+(?:\w+\s+)?([^\W\d_]+)")


def terms(text: str | None) -> Counter:
    """Words and word beginnings (marked with a trailing *) of a text, with how often they occur."""
    words = Counter(_WORDS.findall((text or "").lower()))
    out = Counter(words)
    for word, n in words.items():
        for size in START_SIZES:
            if len(word) > size:
                out[word[:size] + "*"] += n
    return out


@dataclass
class Lexicon:
    """Entries by name, with what a text shows of them."""

    index: dict[str, int] = field(default_factory=dict)

    def hits(self, text: str | None) -> dict[int, int]:
        words = Counter(_WORDS.findall((text or "").lower()))
        index, out = self.index, {}
        for word, n in words.items():
            for name in (word, *(word[:size] + "*" for size in START_SIZES if len(word) > size)):
                if (at := index.get(name)) is not None:
                    out[at] = out.get(at, 0) + n
        return out

    def look(self, text: str | None) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
        """(hits, votes, pattern figures)."""
        text = text or ""
        hits, votes = self.hits(text), np.zeros(VOTERS, np.int8)
        names = self._names()
        for at in hits:
            name = names[at]
            group = zlib.crc32(name.encode())
            votes[WORD_GROUPS + group % START_GROUPS if name.endswith("*") else group % WORD_GROUPS] = 1
        letters = len(text) - len(_CAPITALS.sub("", text))
        shout, marks = letters / max(1, len(text)) > 0.3, text.count("!") / max(1, text.count(" ")) > 0.3
        framed = bool(hits) and any(m in self.index for m in _FRAME.findall(text.lower()))
        total = sum(hits.values())
        figures = np.array([framed, total >= 2, shout, marks, not hits], np.float64)
        votes[-PATTERNS:] = (framed, total >= 2, shout, marks, -1 if not hits else 0)
        return hits, votes, figures

    def _names(self) -> list[str]:
        if not hasattr(self, "_list"):
            self._list = list(self.index)
        return self._list


@dataclass
class LabelModel:
    """Two classes, voters with three outcomes each; `share` is the share of toxic texts."""

    share: float
    rounds: int = 30

    def fit(self, votes: np.ndarray) -> np.ndarray:
        """Posterior probability of each text being toxic."""
        n, m = votes.shape
        onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
        balance = (votes > 0).sum(axis=1) - (votes < 0).sum(axis=1)
        posterior = np.where(balance > 0, 0.9, 0.02)
        self.weights = np.ones(m)
        self.tables = np.zeros((2, m, 3))
        for step in range(self.rounds):
            for y, p in enumerate((1 - posterior, posterior)):
                self.tables[y] = (np.einsum("n,nmv->mv", p, onehot) + 0.5) / (p.sum() + 1.5)
            if step >= self.rounds - 5:  # correlations mean something once the classes have formed
                self.weights = self._independence(votes, onehot)
            posterior = self.posterior(onehot)
        #: accuracy of a voter: how often it is right when it votes
        toxic, clean = self.share, 1 - self.share
        right = toxic * self.tables[1, :, 2] + clean * self.tables[0, :, 0]
        self.accuracy = right / (right + toxic * self.tables[1, :, 0] + clean * self.tables[0, :, 2])
        return posterior

    def _independence(self, votes: np.ndarray, onehot: np.ndarray) -> np.ndarray:
        """Weight of each voter: one over the number of voters it moves with, given the class.

        What a pair has in common beyond the class is judged by the class that the other voters see.
        """
        n, m = votes.shape
        parts = np.einsum("nmv,mv,m->nm", onehot, np.log(self.tables[1] / self.tables[0]), self.weights)
        odds = math.log(self.share / (1 - self.share)) + parts.sum(axis=1)
        self.correlation = np.eye(m)
        for i in range(m):
            for j in range(i):
                toxic = odds - parts[:, i] - parts[:, j] > 0
                found = 0.0
                for inside in (toxic, ~toxic):
                    if inside.sum() < 20:
                        continue
                    a, b = votes[inside, i], votes[inside, j]
                    spread = math.sqrt(a.var() * b.var())
                    if spread > 1e-2:
                        found = max(found, float(((a - a.mean()) * (b - b.mean())).mean()) / spread)
                self.correlation[i, j] = self.correlation[j, i] = found
        return 1 / np.where(self.correlation > 0.2, self.correlation, 0).sum(axis=1)

    def posterior(self, onehot: np.ndarray) -> np.ndarray:
        odds = math.log(self.share / (1 - self.share)) + np.einsum("nmv,mv,m->n", onehot, np.log(self.tables[1] / self.tables[0]), self.weights)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train_linear(rows: np.ndarray, columns: np.ndarray, n: int, m: int, target: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features given as (row, column) pairs, by Adam on the whole set."""
    w = np.zeros(m + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        margin = np.bincount(rows, w[columns], n) + w[m]
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) / n
        g = np.append(np.bincount(columns, slope[rows], m), slope.sum())
        g[:m] += decay * w[:m] / m
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:m], float(w[m])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        hits, _, figures = self.lexicon.look(text)
        size = len(self.lexicon.index)
        margin = self.bias + sum(self.weights[at] for at in hits) + float(figures @ self.weights[size:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def _ratio(toxic, clean, all_toxic: int, all_clean: int):
    """Log-likelihood ratio of an entry's counts in both classes, as a Column."""
    share = all_toxic / (all_toxic + all_clean)
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))
    n = toxic + clean
    rest_t, rest_c, rest = all_toxic - toxic, all_clean - clean, all_toxic + all_clean - n
    return 2 * (part(toxic, n * share) + part(clean, n * (1 - share)) + part(rest_t, rest * share) + part(rest_c, rest * (1 - share)))


def _mark(text: str | None) -> int:
    """The smallest hash of a text's five-word shingles (of its words, if it is shorter), which near copies share."""
    for words in (WORDS, 1):
        if len(found := tokens(text, words)):
            return int(found.min().astype(np.int64))
    return -1


def _tells(toxic, clean, all_toxic: int, all_clean: int):
    """Whether the logarithm of an entry's rate in toxic texts over that in clean ones is surely above 0, as a Column.

    Half a text is added to each count, so that an entry that no clean text has is judged by its count as well.
    """
    t, c = toxic + 0.5, clean + 0.5
    error = F.sqrt(1 / t + 1 / c - 1 / (all_toxic + 1.0) - 1 / (all_clean + 1.0))
    return F.log(t / (all_toxic + 1.0)) - F.log(c / (all_clean + 1.0)) > SURE * error


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from the labelled rows (doc_id, toxic); None if they don't show both classes."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # its bound is what lets it be broadcast
    # of rows that share a doc_id the text that sorts first is taken, so that there are no more texts than chosen labels
    texts = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "toxicity-fit")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None

    def mark(batches):
        for batch in batches:
            marks = [_mark(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=[*batch.schema.names, "mark"])

    # copies of a text, most near ones too, say no more than the text
    marked = texts.mapInArrow(mark, "toxic int, text string, mark long")
    distinct = materialize(marked.groupBy("toxic", "mark").agg(F.min("text").alias("text")).drop("mark"), "toxicity-distinct")
    kinds = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def count(batches):
        for batch in batches:
            totals: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                totals[toxic].update(terms(text).keys())
            names = list(totals[1])  # an entry that no toxic text has can't be chosen
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([totals[1][x] for x in names], pa.int64()), pa.array([0] * len(names), pa.int64())], names=["term", "toxic", "clean"])
            names = list(totals[0])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([totals[0][x] for x in names], pa.int64())], names=["term", "toxic", "clean"])

    counts = distinct.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    toxic, clean = F.col("toxic"), F.col("clean")
    counts = counts.where(toxic >= LEAST_TEXTS).withColumn("ratio", _ratio(toxic, clean, kinds[1], kinds[0]))
    entries = counts.where(_tells(toxic, clean, kinds[1], kinds[0]) & (F.col("ratio") >= LEAST_RATIO)).orderBy(F.desc("ratio"), "term").limit(LEXICON).select("term").collect()
    lexicon = Lexicon({r["term"]: i for i, r in enumerate(entries)})

    def look(batches):
        for batch in batches:
            seen = [lexicon.look(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(h) for h, _, _ in seen], pa.list_(pa.int32())), pa.array([v.tobytes() for _, v, _ in seen], pa.binary()), pa.array([f.tolist() for _, _, f in seen], pa.list_(pa.float64()))],
                names=["hits", "votes", "figures"],
            )

    seen = texts.mapInArrow(look, "hits array<int>, votes binary, figures array<double>").toArrow()  # at most fit_rows rows
    votes = np.stack([np.frombuffer(v, np.int8) for v in seen.column("votes").to_pylist()]).astype(np.float64)
    target = LabelModel(sizes[1] / (sizes[0] + sizes[1])).fit(votes)
    size, rows, columns = len(lexicon.index), [], []
    for i, (hits, figures) in enumerate(zip(seen.column("hits").to_pylist(), seen.column("figures").to_pylist(), strict=True)):
        columns += hits + [size + k for k, x in enumerate(figures) if x]
        rows += [i] * (len(columns) - len(rows))
    weights, bias = train_linear(np.array(rows, np.int64), np.array(columns, np.int64), len(target), size + PATTERNS, target)
    return Model(lexicon, weights, bias)


def score(docs: DataFrame, model: Model | None, score_as: str = "score", predicted_as: str = "predicted") -> DataFrame:
    """docs with the columns score and predicted, under the given names; all other columns are kept."""
    kept = [c for c in docs.columns if c not in (score_as, predicted_as)]
    if model is None:
        return docs.select(kept).withColumn(score_as, F.lit(0.0)).withColumn(predicted_as, F.lit(0))
    schema = docs.select(kept).withColumn(score_as, F.lit(0.0).cast("double")).schema

    def run(batches):
        for batch in batches:
            scores = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score_as])

    return docs.select(kept).mapInArrow(run, schema).withColumn(predicted_as, (F.col(score_as) >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that are not predicted as toxic; all columns are kept, ones named score and predicted, too."""
    names = unused(docs, "score", "predicted")
    return score(docs, model, *names).where(F.col(names[1]) == 0).select(docs.columns)
