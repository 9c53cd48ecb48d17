"""Clusters of histograms: contexts whose symbols are alike share one table, where that saves bits.

Merging two tables costs what the symbols take longer under the common shares and saves one table. Only symbols that both
have change anything beside the totals; clusters with none in common are never merged. In each round every cluster looks for
the partner that it gains most with, and pairs that choose each other merge, in all groups at once. The best pair of
all is always among them, so every round merges until nothing gains. The map of contexts is written
between rounds.

All pairs of a group are weighed, and they grow with the square of its clusters, but no pair is ever a row: clusters are dealt
to blocks of bounded size, a task takes two blocks at a time and gives the best partner of each of their clusters. What is
shuffled is the histograms, once for each block of their group, and a row per cluster and block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.storage import materialize

#: Clusters and cells (cluster, symbol) that a block holds, about: clusters are dealt by hash.
BLOCK_CLUSTERS, BLOCK_CELLS = 2048, 1 << 18
#: Pairs of clusters that are weighed at once.
STRIP = 1 << 15
#: Counts up to this have n log n in a table.
TABLE = 1 << 22

_terms = np.zeros(1)


def _term(x: Column) -> Column:
    return x * F.log2(x)


def cluster_histograms(counts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(grp, cluster, symbol, n) of counts (grp, context, symbol, n) under a map (grp, context, cluster)."""
    return counts.join(clusters, ["grp", "context"]).groupBy("grp", "cluster", "symbol").agg(F.sum("n").alias("n"))


def _terms_to(most: int) -> np.ndarray:
    """n log n of all counts to `most`."""
    global _terms
    if most >= len(_terms):
        x = np.arange(1, 1 << most.bit_length(), dtype=np.float64)
        _terms = np.concatenate((np.zeros(1), x * np.log2(x)))
    return _terms


def _term_of(n: np.ndarray, most: int) -> np.ndarray:
    """n log n of counts up to `most`."""
    return _terms_to(most).take(n, mode="clip") if most < TABLE else n * np.log2(np.maximum(n, 1))


class _Block:
    """Clusters in order, their totals, and per symbol the places of those that have it and how often."""

    def __init__(self, row: dict) -> None:
        cluster, symbol, n = (row[c].values for c in ("cluster", "symbol", "n"))
        n = n.to_numpy().astype(np.int64)
        self.names, place = np.unique(cluster.to_numpy(zero_copy_only=False), return_inverse=True)
        self.total = np.zeros(len(self.names), dtype=np.int64)
        np.add.at(self.total, place, n)
        codes = symbol.dictionary_encode()
        of = codes.indices.fill_null(-1).to_numpy()
        order = np.lexsort((place, of))
        of, place, n = of[order], place[order], n[order]
        at = np.searchsorted(of, np.arange(len(codes.dictionary) + 1))
        self.cells = {value: (place[at[k] : at[k + 1]], n[at[k] : at[k + 1]]) for k, value in enumerate(codes.dictionary.to_pylist())}

    def all_of(self, symbol: object) -> np.ndarray:
        """How often each cluster has the symbol; 0 where it hasn't, which leaves n log n of a sum as it is."""
        out = np.zeros(len(self.names), dtype=np.int64)
        at, n = self.cells[symbol]
        out[at] = n
        return out


def _gains(a: _Block, b: _Block, overhead: float) -> Iterator[tuple[int, np.ndarray]]:
    """Strips (start, gain): bits that merging saves, for clusters of a from start on with all of b; -inf where they have no symbol in common.

    Symbols go in order, so that equal histograms, wherever they are dealt, differ by less than what gains are rounded to.
    """
    symbols = sorted(a.cells.keys() & b.cells.keys())
    usual = [s for s in symbols if 2 * len(a.cells[s][0]) >= len(a.names) and 2 * len(b.cells[s][0]) >= len(b.names)]
    rare = [s for s in symbols if s not in set(usual)]
    sides = [(n, m, int(n.max() + m.max())) for n, m in ((a.all_of(s), b.all_of(s)) for s in usual)]
    most = int(a.total.max() + b.total.max())
    alone_a, alone_b = (_term_of(x.total, most) - sum((_term_of(s[k], s[2]) for s in sides), np.zeros(1)) for k, x in enumerate((a, b)))
    certain = any(len(a.cells[s][0]) == len(a.names) and len(b.cells[s][0]) == len(b.names) for s in usual)
    step = max(1, STRIP // len(b.names))
    for start in range(0, len(a.names), step):
        stop = min(start + step, len(a.names))
        saved = np.zeros((stop - start, len(b.names)))
        for n, m, top in sides:
            saved += _term_of(n[start:stop, None] + m, top)
        saved -= _term_of(a.total[start:stop, None] + b.total, most)
        saved += alone_a[start:stop, None] + alone_b
        shared = np.full(saved.shape, certain)
        for s in symbols if not certain else rare:
            (at, n), (of, m) = a.cells[s], b.cells[s]
            lo, hi = np.searchsorted(at, (start, stop))
            here = np.ix_(at[lo:hi] - start, of)
            shared[here] = True
            if s in rare:
                n = n[lo:hi]
                saved[here] += _term_of(n[:, None] + m, most) - (_term_of(n, most)[:, None] + _term_of(m, most))
        saved += overhead
        saved *= 1e6
        np.rint(saved, out=saved)
        saved /= 1e6
        if not certain:
            saved[~shared] = -np.inf
        yield start, saved


def _best_of(a: _Block, b: _Block, overhead: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, gain): the partner in b that each cluster of a gains most with and, unless b is a, the other way round; ties go to the smaller one."""
    most, who = np.full(len(b.names), -np.inf), np.zeros(len(b.names), dtype=np.int64)
    for start, gain in _gains(a, b, overhead):
        rows = np.arange(len(gain))
        if a is b:
            gain[rows, rows + start] = -np.inf
        y = gain.argmax(axis=1)
        yield a.names[start : start + len(gain)], b.names[y], gain[rows, y]
        if a is not b:  # names grow from strip to strip, so a later one must gain more
            now = gain.max(axis=0)
            better = np.flatnonzero(now > most)
            most[better], who[better] = now[better], start + gain[:, better].argmax(axis=0)
    if a is not b:
        yield b.names, a.names[who], most


def best_partners(histograms: DataFrame, blocks: DataFrame, overhead: float) -> DataFrame:
    """(grp, x, y): the cluster y that x of histograms (grp, cluster, symbol, n) gains most with, where it gains; ties go to the smaller one.

    blocks (grp, blocks) says to how many blocks the clusters of a group are dealt.
    """
    dealt = histograms.join(blocks, "grp").withColumn("block", F.expr("pmod(xxhash64(cluster), blocks)").cast("int"))
    packed = dealt.groupBy("grp", "blocks", "block").agg(F.collect_list(F.struct("cluster", "symbol", "n")).alias("cells")).select("grp", "blocks", "block", "cells.cluster", "cells.symbol", "cells.n")
    paired = packed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    paired = paired.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cluster", "symbol", "n")
    kinds = {f.name: f.dataType.simpleString() for f in histograms.schema}

    def best(pair: pa.Table) -> pa.Table:
        rows = {pair["block"][k].as_py(): {c: pair[c][k] for c in ("cluster", "symbol", "n")} for k in range(len(pair))}
        i, j = pair["i"][0].as_py(), pair["j"][0].as_py()
        name = pair.schema.field("cluster").type.value_type
        x, y, gain = [], [], []
        if i in rows and j in rows:  # a block may be empty
            a = _Block(rows[i])
            b = a if i == j else _Block(rows[j])
            for of, partner, bits in _best_of(a, b, overhead):
                gains = bits > 0
                x.append(of[gains])
                y.append(partner[gains])
                gain.append(bits[gains])
        x, y = (pa.array(np.concatenate(v), name) if v else pa.array([], name) for v in (x, y))
        gain = pa.array(np.concatenate(gain) if gain else [], pa.float64())
        return pa.table({"grp": pa.array([pair["grp"][0].as_py()] * len(x), pair.schema.field("grp").type), "x": x, "y": y, "gain": gain})

    found = paired.groupBy("grp", "i", "j").applyInArrow(best, f"grp {kinds['grp']}, x {kinds['cluster']}, y {kinds['cluster']}, gain double")
    return found.groupBy("grp", "x").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "y")).alias("m")).select("grp", "x", F.col("m.y").alias("y"))


def merge(counts: DataFrame, overhead: float, rounds: int | None = None) -> DataFrame:
    """(grp, context, cluster): the map that rounds of mutual best pairs end with; a cluster is named by its smallest context.

    counts (grp, context, symbol, n) has positive counts, each (grp, context, symbol) once. Ties go to the smaller partner.
    Without `rounds` they go on until nothing gains; with it, the map is the one after so many of them.
    """
    return _merge(materialize(counts.select("grp", "context", "symbol", "n"), "counts", release=True), overhead, rounds)


def _merge(counts: DataFrame, overhead: float, rounds: int | None) -> DataFrame:
    clusters = materialize(counts.select("grp", "context", F.col("context").alias("cluster")).distinct(), "clusters", release=True)
    sizes = counts.groupBy("grp", "context").agg(F.count(F.lit(1)).alias("cells")).groupBy("grp").agg(F.count(F.lit(1)).alias("clusters"), F.sum("cells").alias("cells"))
    blocks = materialize(sizes.select("grp", F.greatest(F.ceil(F.col("clusters") / BLOCK_CLUSTERS), F.ceil(F.col("cells") / BLOCK_CELLS)).cast("int").alias("blocks")), "blocks", release=True)
    for _ in itertools.count() if rounds is None else range(rounds):
        best = best_partners(cluster_histograms(counts, clusters), blocks, overhead)
        chosen = best.groupBy("grp", F.least("x", "y").alias("into"), F.greatest("x", "y").alias("cluster")).agg(F.count(F.lit(1)).alias("votes"))
        mutual = materialize(chosen.where("votes = 2").select("grp", "into", "cluster"), "mutual", release=True)
        if mutual.isEmpty():
            break
        clusters = materialize(clusters.join(mutual, ["grp", "cluster"], "left").select("grp", "context", F.coalesce("into", "cluster").alias("cluster")), "clusters", release=True)
    return clusters


def merge_and_price(counts: DataFrame, overhead: float, rounds: int | None = None) -> DataFrame:
    """(grp, context, cluster, symbols, bits): the map of `merge` and what all symbols of each cluster take; counts are formed once."""
    counts = materialize(counts.select("grp", "context", "symbol", "n"), "counts", release=True)
    found = _merge(counts, overhead, rounds)
    return found.join(bits(cluster_histograms(counts, found)), ["grp", "cluster"]).select("grp", "context", "cluster", "symbols", "bits")


def bits(histograms: DataFrame) -> DataFrame:
    """(grp, cluster, symbols, bits): what all symbols of each cluster take under its own shares."""
    n = F.col("n")
    return histograms.groupBy("grp", "cluster").agg(F.sum(n).alias("symbols"), (_term(F.sum(n)) - F.sum(_term(n))).alias("bits"))
