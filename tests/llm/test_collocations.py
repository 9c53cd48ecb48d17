"""Quotient filters by themselves, and phrases against a slow count; the query itself is compared with SQL."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import collocations, quotient
from tests.llm.fixtures import prose


@pytest.mark.parametrize("order,width,bits", [(2, 1, 6), (2, 13, 6), (3, 9, 4), (3, 20, 9), (4, 16, 7), (4, 20, 6), (4, 32, 10)])
def test_filters_lose_nothing_and_merge(order, width, bits):
    r = np.random.default_rng(order * width)
    shape = quotient.Shape(order, width, bits)
    shards = [r.integers(0, min(1 << width, 40), (n, order)) + (0 if width < 6 else (1 << width) - 40) for n in (0, 1, 500, 4000)]
    for grams in shards:
        assert np.array_equal(shape.restore(*shape.permute(grams.astype(np.uint32))), grams)
    segments = collections.defaultdict(list)
    for grams in shards:
        for q, remainders, counts in shape.segments(*shape.counted(*shape.permute(grams))):
            segments[q].append((remainders, counts))
    found = {}
    for q, parts in segments.items():
        left, right, counts = shape.merged(q, [x[0] for x in parts], [x[1] for x in parts])
        assert (np.diff(left.astype(object) * (1 << 64) + right.astype(object)) > 0).all()
        found.update(zip(map(tuple, shape.restore(left, right).tolist()), counts.tolist()))
    assert found == collections.Counter(tuple(x) for grams in shards for x in grams.tolist())


def test_quotients_are_even_though_grams_are_not():
    shape = quotient.Shape(2, 16, 6)
    grams = np.stack(np.meshgrid(np.arange(200), np.arange(200)), axis=-1).reshape(-1, 2)
    sizes = [len(c) // 4 for _, _, c in shape.segments(*shape.counted(*shape.permute(grams)))]
    assert len(sizes) == 64 and max(sizes) < 1.3 * np.mean(sizes)


def slow(rows, least, top):
    f, n, lower = collections.Counter(), collections.Counter(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + m]) for (lang, w), a in candidates.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * a >= 80 * f[lang, w[i : i + m]]}
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


ROWS = [
    ("en", "the cat sat, the CAT sat. the cat\nran the cat sat " * 4),
    ("en", " ".join(prose(300, 1, 50).split()[k % 17] for k in range(600))),
    ("de", "ä ö ü ä ö! Ä ö ü\x0bä ö\tü ä\x0cö ü a a a a a a a a"),
    (None, "x y x y x y; x y x y"),
    ("und", "x y z x y z"),
    ("en", None), ("fr", ""), (None, None), ("fr", "."), ("en", "w" * 100000 + " v " + "w" * 100000),
]


@pytest.mark.parametrize("head,portion,bits", [(1 << 20, 1 << 22, 1 << 29), (1 << 20, 10, 1 << 16), (6, 50, 1 << 29), (1, 50, 1 << 29)])
def test_phrases_are_counted_exactly(spark, monkeypatch, head, portion, bits):
    """With few ids most n-grams are counted as strings; with small portions a task sends many filters."""
    monkeypatch.setattr(collocations, "FILTER_GRAMS", portion)
    monkeypatch.setattr(collocations, "PAIR_TABLE_BITS", bits)
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(ROWS * 2)], "doc_id long, lang string, text string").repartition(3)
    for least, top in ((2, 2000), (5, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, top=top, head_words=head).collect())
        assert got == slow(ROWS * 2, least, top)


def test_every_seed_tells_words_and_languages_apart(spark):
    docs = spark.createDataFrame([("en", "a b a b"), ("de", "a c")], "lang string, text string")
    counted, seed = collocations.word_counts(docs)
    assert seed == 0 and {(r["lang"], r["word"], r["n"]) for r in counted.collect()} == {("en", "a", 2), ("en", "b", 2), ("de", "a", 1), ("de", "c", 1)}
    assert counted.select("key").distinct().count() == 4


def test_a_task_holds_a_bounded_number_of_ngrams_of_all_orders(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_GRAMS", 900)
    words = prose(800, 1, 50).split()
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(words[k : k + 100])]}) for k in range(0, 800, 100)]

    class Local:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(iter(batches)))

    class Head:
        value = np.unique(np.concatenate([part.keys for part, _ in collocations._slices(batches, 0)]))

    shapes = {order: quotient.Shape(order, 6, 6) for order in (3, 4)}
    sent = [(b.column("order")[0].as_py(), sum(int(np.frombuffer(x, "<u4").sum()) for x in b.column("counts").to_pylist())) for b in collocations._filters(Local(), 0, Head, (3, 4), shapes)]
    for order in (3, 4):
        assert sum(n for k, n in sent if k == order) == 8 * (100 - order + 1)
    assert sum(n for _, n in sent[-2:]) < 900
