"""Symbols of coefficients against a plain loop, and groups decoded from their byte ranges."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import coefficients as co
from tessella.sources import spans

SCHEMA = "image_id long, c long, by long, bx long, q array<long>"


def made(seed, images=3, side=4):
    r = np.random.default_rng(seed)
    rows = []
    for image in range(images):
        for c in range(3):
            for by in range(side):
                for bx in range(side):
                    q = np.where(r.random(64) < r.choice([0.0, 0.03, 0.2, 1.0]), r.integers(-300, 301, 64), 0)
                    rows.append((image, c, by, bx, [int(v) for v in q]))
    return rows


def plain(rows):
    """context, symbol, nbits and bits of each block, in a loop."""
    count, out = {}, {}
    for image, c, by, bx, q in sorted(rows):
        near = [count[k] for k in ((image, c, by - 1, bx), (image, c, by, bx - 1)) if k in count]
        expected = (sum(near) + 1) // 2 if len(near) == 2 else near[0] if near else 32
        left = count[image, c, by, bx] = sum(v != 0 for v in q[1:])
        got, run, last = [(3 * (expected // 2) + c, left, 0, 0)], 0, 0
        for k in range(1, 64):
            if not left:
                break
            where = 96 + 105 * c + co.LEFT_CONTEXT[left] + co.PLACE_CONTEXT[last]
            if q[k] == 0:
                run += 1
                if run == 16:
                    got.append((where, 240, 0, 0))
                    run, last = 0, k
                continue
            packed = 2 * q[k] if q[k] > 0 else -2 * q[k] - 1
            n = int(math.log2(packed + 1))
            got.append((where, 16 * run + n, n, packed + 1 - (1 << n)))
            run, last, left = 0, k, left - 1
        out[image, c, by, bx] = got
    return out


@pytest.fixture(scope="module")
def rows():
    return made(5)


def test_symbols_are_a_plain_loop(spark, rows):
    got = co.block_symbols(spark.createDataFrame(rows, SCHEMA), "q").collect()
    assert {(r["image_id"], r["c"], r["by"], r["bx"]): [tuple(t) for t in r["symbols"]] for r in got} == plain(rows)
    assert any(t[1] == 240 for x in plain(rows).values() for t in x)


def test_groups_decode_from_their_spans(spark, rows):
    symbols = co.block_symbols(spark.createDataFrame(rows, SCHEMA), "q")
    counts = co.histograms(symbols)
    context_map, shares = co.tables(counts)
    coded = co.encode_groups(symbols, context_map, shares)
    index = spans.write_spans(coded, ["image_id"])
    found = index.collect()
    assert len(found) == 3
    for path in {r["path"] for r in found}:
        assert sorted((r["start"], r["start"] + r["length"]) for r in found if r["path"] == path)[-1][1] == os.path.getsize(path)
    one = co.decode_groups(spans.read_spans(index.where("image_id = 1")), context_map, shares).collect()
    every = co.decode_groups(spans.read_spans(index.repartition(3)), context_map, shares).collect()
    wanted = sorted((i, c, y, x, [0] + q[1:]) for i, c, y, x, q in rows)
    assert sorted(map(tuple, every)) == wanted and sorted(map(tuple, one)) == [r for r in wanted if r[0] == 1]
    # bytes are near what the shared tables promise
    promised = sum(-math.log2(shares[context_map[t[0]]][t[1]] / (1 << co.SHARE_BITS)) + t[2] for x in plain(rows).values() for t in x) / 8
    assert promised <= sum(r["length"] for r in found) <= promised * 1.01 + 3 * (12 + 3 * 48)


def test_shared_tables_are_the_greedy_ones():
    r = np.random.default_rng(4)
    counts = np.array([r.multinomial(r.integers(1, 400), shares) for shares in r.dirichlet(np.ones(256) * 0.03, 4) for _ in range(5)])
    bits = lambda h: h.sum() * math.log2(h.sum()) - sum(n * math.log2(n) for n in h if n)
    groups = [[i] for i in range(len(counts))]
    while True:
        cost = [bits(counts[g].sum(axis=0)) for g in groups]
        best = max((90.0 - (bits(counts[groups[i] + groups[j]].sum(axis=0)) - cost[i] - cost[j]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if best[0] <= 0:
            break
        groups[-best[1]] += groups.pop(-best[2])
    of = co._merged(counts, 90.0)
    assert sorted(sorted(g) for g in groups) == sorted([i for i, x in enumerate(of) if x == k] for k in set(of)) and 1 < len(groups) < 20
    assert co._merged(counts[:1], 90.0) == [0] and co._merged(counts[:0], 90.0) == []


def test_sparse_grids_and_no_blocks(spark):
    rows = [r for r in made(7, images=2) if (r[2] * 5 + r[3] * 3) % 4]
    symbols = co.block_symbols(spark.createDataFrame(rows, SCHEMA), "q")
    context_map, shares = co.tables(co.histograms(symbols))
    got = co.decode_groups(co.encode_groups(symbols, context_map, shares), context_map, shares).collect()
    assert sorted(map(tuple, got)) == sorted((i, c, y, x, [0] + q[1:]) for i, c, y, x, q in rows)
    none = co.block_symbols(spark.createDataFrame([], SCHEMA), "q")
    assert co.tables(co.histograms(none)) == ({}, {}) and co.encode_groups(none, {}, {}).count() == 0


def test_spans_of_odd_contents(spark):
    rows = [(1, b"abc", "x"), (2, None, "y"), (3, b"", "y"), (3, b"\0" * 5000, None), (None, b"abc", "x")]
    index = spans.write_spans(spark.createDataFrame(rows, "k int, content binary, path_of string").repartition(2), ["k", "path_of"])
    got = spans.read_spans(index).select("k", "path_of", "content").collect()
    assert sorted(((r["k"] or 0, bytes(r["content"]), r["path_of"]) for r in got), key=str) == sorted(((k or 0, c or b"", p) for k, c, p in rows), key=str)
    assert spans.write_spans(spark.createDataFrame([], "k int, content binary"), ["k"]).count() == 0
    beyond = index.where("length = 3").withColumn("length", F.lit(10**6))
    with pytest.raises(Exception, match="ends before"):
        spans.read_spans(beyond).collect()
