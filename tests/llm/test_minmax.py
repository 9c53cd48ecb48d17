"""Min-max near-duplicates against all pairs by brute force, and the parts of the method by themselves."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import minmax, queries, wordhash
from tests.llm.fixtures import prose

SMALL = "/root/testdata/sf0.001"


def words(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).decode()
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    w = words(text)
    return frozenset([tuple(w)] if len(w) == 1 else zip(w, w[1:]))


def brute(rows):
    """{doc_id: (n, component, kept)} over all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_copies(seed):
    """Groups of texts with similarities on both sides of the threshold, among them copies whose base comes last."""
    r = random.Random(seed)
    vocabulary = prose(2000, 5).split()
    texts = [None, "", " \t", "One", "one", "two", "Two words", "two  WORDS"]
    for n, copies in ((3, 4), (6, 5), (12, 8), (40, 30), (40, 10), (150, 40), (400, 10)):
        base = [r.choice(vocabulary) for _ in range(n)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(max(1, round(n * r.choice((0.02, 0.04, 0.05, 0.06, 0.08))))):
                copy[r.randrange(n)] = r.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper())
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,part", [(1, minmax.PART), (2, 6)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, part):
    """Small parts put nearly every bucket on the grid of later rounds."""
    monkeypatch.setattr(minmax, "PART", part)
    rows = near_copies(seed)
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(rows)


def test_query_is_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.queries()["op11_minmax_dedup"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(None, a), (5, a), (5, a), (5, b), (9, b + " more"), (None, None), (7, None), (8, "")]
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(
        f"Row(doc_id={i}, n_shingles={n}, component_id={c}, kept={k})"
        for i, n, c, k in [(None, 59, None, True), (5, 59, 5, True), (5, 59, 5, True), (5, 59, 5, True), (9, 60, 5, False), (None, 0, None, True), (7, 0, 7, True), (8, 0, 8, True)]
    )


def test_sets_are_distinct_shingles_of_each_text():
    texts = ["a b a b a", "x", None, "", "A  b\tC", " a b "]
    values, sizes = minmax.shingle_sets(pa.array(texts))
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    ends = np.cumsum(sizes)
    held = [set(values[e - n : e].tolist()) for e, n in zip(ends, sizes)]
    assert held[5] <= held[0] and held[5] <= held[4] and not held[1] & held[0]


def test_smallest_and_largest_agree_as_often_as_sets_are_alike():
    r = np.random.default_rng(3)
    agree = []
    for _ in range(200):
        values = r.integers(0, 2**63, 220, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(values[:200]), np.sort(values[20:])  # similarity 180 / 220
        s = minmax.signatures(np.concatenate((a, b)), np.array([200, 200]))
        agree.append(s[0] == s[1])
    agree = np.array(agree)
    assert abs(agree.mean() - 180 / 220) < 0.01
    assert abs(agree[:, ::2].mean() - agree[:, 1::2].mean()) < 0.02
    bands = agree.reshape(200, -1, 2 * minmax.BAND).all(axis=2)
    assert bands.any(axis=1).all()


def test_pairs_of_cells():
    r = np.random.default_rng(5)
    base = r.integers(0, 256, (4, 128), dtype=np.uint8)
    sketch = base[[0, 0, 1, 0, 2, 0, 3, 3]].copy()
    sketch[1, 20:40] += 1
    tally = np.full((8, minmax.CELLS // 2), 255, np.uint8)
    band, marks = np.zeros(8, int), np.zeros((8, minmax.BANDS), np.uint32)
    pairs = lambda how: sorted(zip(*(x.tolist() for x in minmax.cell_pairs(cell, band, n, sketch, marks, tally, side, group, how))))
    cell, n = np.array([1, 1, 1, 1, 1, 2, 2, 2]), np.array([10, 10, 11, 12, 13, 10, 10, 13])
    side, group = np.full(8, 2), np.arange(8)
    every = pairs("all")
    assert every == [(0, 1), (0, 3), (1, 3)]  # 6 and 7 differ too much in size
    earlier = pairs("earlier")
    assert earlier == [(0, 1), (0, 3)]
    group[3] = group[0]
    assert pairs("all") == [(0, 1), (1, 3)]
    band[:] = 7
    assert pairs("all") == []  # their first common band is 0


def test_slices_of_a_column_have_their_own_words():
    texts = pa.array([f"Text {i} has A-Z" if i % 7 else None for i in range(500)])
    whole, part = wordhash.words(texts), wordhash.words(texts.slice(200, 100))
    here = (whole.doc >= 200) & (whole.doc < 300)
    assert np.array_equal(whole.hashes[here], part.hashes) and np.array_equal(whole.doc[here] - 200, part.doc)
    assert part.texts(np.array([0, 3, 1])).to_pylist() == ["text", "a-z", "200"]


def test_tallies_refute_only_what_is_not_similar():
    r = np.random.default_rng(9)
    refuted = 0
    for n in (1, 5, 60, 300, 1500, 3000, 9000):
        for share in (0, 0.5, 0.7, 0.78, 0.8, 0.81, 0.9, 1):
            values = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
            both = int(2 * n * share / (1 + share))
            a, b = values[:n], values[n - min(both, n) : 2 * n - min(both, n)]
            sizes = np.array([n, n])
            t = minmax.tallies(np.concatenate((a, b)), sizes)
            alike = 100 * min(both, n) >= 80 * (2 * n - min(both, n))
            may = bool(minmax.may_be_similar(t[:1], t[1:], sizes[:1], sizes[1:])[0])
            assert may or not alike
            refuted += not may
            if n <= 300 and share <= 0.7:
                assert not may or n == 1 and share > 0
    assert refuted > 15


def test_cells_are_dealt_without_sketches(spark, monkeypatch):
    monkeypatch.setattr(minmax, "PART", 2)
    keys = [bytes([i]) * 16 for i in range(6)]
    # bucket 1 is connected, bucket 2 is one cell, bucket 3 has two parts and one set outside its largest component
    rows = [(1, 0, keys[0], keys[0]), (1, 0, keys[1], keys[0]), (2, 0, keys[0], keys[0]), (2, 0, keys[2], keys[2])]
    rows += [(3, 0, keys[3], keys[3]), (3, 0, keys[4], keys[3]), (3, 0, keys[5], keys[5])]
    got = minmax._grid(spark.createDataFrame(rows, "bucket long, band int, key binary, root binary"))
    assert sorted(got.columns) == ["band", "bucket", "cell", "key", "root", "side"]
    cells = {}
    for r in got.collect():
        cells.setdefault((r["bucket"], r["cell"]), []).append((bytes(r["key"]), r["side"]))
    assert sorted(cells[2, 0]) == [(keys[0], 2), (keys[2], 2)] and not any(bucket == 1 for bucket, _ in cells)
    met = {(min(a, b), max(a, b)) for cell in cells.values() for a, x in cell for b, y in cell if a != b and (x != y or x == 2)}
    assert {(keys[3], keys[5]), (keys[4], keys[5])} <= met
