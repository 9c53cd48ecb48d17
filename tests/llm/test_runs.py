"""Runs against brute force, in portions of any size, and the query against a slow version of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import queries, runs
from tests.llm.fixtures import prose

SMALL = "/root/testdata/sf0.001"


def brute(w, periods=runs.PERIODS, least=runs.LEAST_WORDS):
    """(start, length, period) of all maximal stretches, each with its smallest period."""
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


@pytest.mark.parametrize("portion", [1, 2, 7, 1000])
def test_catchers_are_brute_force(portion):
    r = random.Random(portion)
    for _ in range(300):
        n, k = r.randrange(90), r.choice((1, 2, 3, 6))
        w = [r.randrange(k) for _ in range(n)]
        if n > 10 and r.random() < 0.6:
            a, p = r.randrange(n), 1 + r.randrange(14)
            for i in range(a + p, n):
                w[i] = w[i - p]
        got = runs.find_runs(np.array(w, np.int64), n, portion)
        assert [tuple(x) for x in got.T.tolist()] == sorted(brute(w), key=lambda x: (x[0], x[2]))


def test_a_square_is_reported_while_words_still_come():
    catchers = runs.Catchers(64, 64)
    for word in [5, 1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 9]:
        catchers.append(np.array([word]))
        if word != 9 and catchers.n >= 9:
            assert (catchers.open[1] == 3).any()
    assert catchers.closed and catchers.runs().T.tolist() == [[1, 13, 3]]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = sorted(brute(w), key=lambda x: (x[0], x[2]))
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    start, length, period = best or (None, None, None)
    return (len(found), start, length, period, 1000 * length // period if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


FIGURES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_is_its_contract(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.queries()["op12_periodic_runs"](spark, SMALL).collect()
    assert {r["doc_id"]: tuple(r[c] for c in FIGURES) for r in got} == {i: expected(i, t) for i, t in texts.items()}
    assert sum(r["n_runs"] > 0 for r in got) > 10


def test_odd_texts(spark):
    texts = [None, "", "\t \n", "a", "a " * 5, "a " * 6, "b a b a b a b a", "a a a b a a a b a a a b a a a b a a a", "é É é É é É é É", " ".join(["x y z"] * 5000), prose(300, 4), "A a A a A a", "\x85a  a " * 4]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q " * 9), (None, None), (5, texts[5]), (5, texts[6])]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), loops=True).collect()
    assert sorted(map(str, (tuple(r[c] for c in ("doc_id", *FIGURES)) for r in got))) == sorted(map(str, ((i, *expected(i, t)) for i, t in rows)))
    plain = runs.periodic_runs(spark.createDataFrame([(0, "a b " * 9 + "c")], "doc_id long, text string")).first()
    assert (plain["n_runs"], plain["length"], plain["collapsed"]) == (1, 18, "a b c")
