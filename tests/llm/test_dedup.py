import hashlib
import random

import numpy as np
import pytest
import xxhash

from tessella.llm import exact, simhash, substring
from tessella.llm.graph import components
from tests.llm.fixtures import frame, odd_texts, prose


def lower(t):
    return (t or "").encode().lower()


def groups_of(rows):
    by = {}
    for i, t in rows:
        by.setdefault(lower(t), []).append(i)
    return by


@pytest.mark.parametrize("primes,chunk", [(exact.PRIMES, exact.CHUNK), ((3,), 64)])
def test_exact_matches_brute_force_even_with_colliding_fingerprints(spark, primes, chunk):
    texts = odd_texts() + [prose(40, k % 5) for k in range(20)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in exact.exact_duplicates(frame(spark, texts), primes, chunk).collect()}
    assert len(got) == len(texts)
    for text, ids in groups_of(rows).items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text).hexdigest())


def test_exact_keeps_all_columns_and_takes_empty_tables(spark):
    docs = frame(spark, ["A b", "a B", "c"])
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert exact.exact_duplicates(docs.where("false")).count() == 0


def test_exact_null_ids_and_repeated_rows(spark):
    docs = frame(spark, [(None, "x y"), (3, "x y"), (3, "x y"), (4, None), (5, "")])
    got = exact.exact_duplicates(docs).collect()
    assert len(got) == 5
    assert {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] in (None, 3)} == {(3, 3)}
    assert {r["kept"] for r in got if r["doc_id"] == 4} == {False}


def test_exact_judges_different_texts_under_one_id_apart(spark):
    got = exact.exact_duplicates(frame(spark, [(3, "x"), (3, "y"), (5, "X"), (1, "y")])).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(3, 5, 2), (3, 3, 2), (5, 5, 2), (1, 3, 2)}


def test_fingerprints_combine():
    f = exact.Fingerprint(chunk=16)
    data = bytes(range(200))
    whole = f.of(data)
    for cut in (0, 1, 15, 16, 17, 150, 200):
        assert f.combine(f.of(data[:cut]), f.of(data[cut:])) == whole
    assert f.of(b"\0") != f.of(b"\0\0")


def test_components_match_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {row["node"]: row["root"] for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = lower(text).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, n in enumerate(ids):
        least[find(i)] = min(least.get(find(i), n), n)
    return {n: least[find(i)] for i, n in enumerate(ids)}


def test_simhash_matches_brute_force(spark):
    r = random.Random(9)
    texts = odd_texts()
    for k in range(12):
        words = prose(300, k).split()
        texts.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            for _ in range(r.randrange(1, 6)):
                copy[r.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    got = {row["doc_id"]: row for row in simhash.near_duplicates(frame(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert {i: row["fp"] % 2**64 for i, row in got.items()} == dict(enumerate(prints))
    assert {i: row["component_id"] for i, row in got.items()} == brute_components(list(range(len(texts))), prints)
    assert simhash.near_duplicates(frame(spark, texts).where("false")).count() == 0


@pytest.mark.parametrize("split", [3, 20000])
def test_simhash_links_of_large_buckets(spark, split):
    r = random.Random(2)
    prints = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in r.sample(range(64), r.randrange(5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), split)
    roots = {row["node"]: row["root"] for row in components(found).collect()}
    want = brute_components(signed, prints)
    assert {x: roots.get(x, x) for x in signed} == want


def test_near_duplicates_keep_the_smallest_of_each_component(spark):
    base = prose(500, 77)
    docs = frame(spark, [base, base + " end", prose(500, 78), None])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert 0 in ids and 2 in ids
    nulls = simhash.drop_near_duplicates(frame(spark, [(None, base), (1, base)]))
    assert nulls.count() == 2


def test_compact_windows_are_those_of_the_cartesian_tree():
    r = np.random.default_rng(3)
    for _ in range(20):
        lengths = r.integers(1, 120, 6)
        owner = np.repeat(np.arange(6), lengths)
        v = r.integers(0, 2**63, len(owner)).astype(np.uint64)
        low, centre, high, _ = substring.compact_windows(v, owner, 10)
        bits = int(len(v)).bit_length()
        o = (v >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(v), dtype=np.uint64)
        want = []
        for i in range(len(v)):
            a = b = i
            while a > 0 and owner[a - 1] == owner[i] and o[a - 1] > o[i]:
                a -= 1
            while b + 1 < len(v) and owner[b + 1] == owner[i] and o[b + 1] > o[i]:
                b += 1
            if b - a + 1 >= 10:
                want.append((a, i, b))
        assert sorted(zip(low.tolist(), centre.tolist(), high.tolist(), strict=True), key=lambda w: w[1]) == want


def planted():
    passage, line = prose(60, 500), prose(12, 501)
    near = passage.split()
    near[30] = "other"
    texts = [prose(200, 600 + k) + "\n" + line + "\n" + prose(100, 700 + k) for k in range(12)]
    for k in (2, 5, 8):
        texts[k] = prose(80, 800 + k) + " " + passage.upper() + " " + prose(90, 900 + k)
    texts[10] = prose(80, 810) + " " + " ".join(near) + " " + prose(70, 910)
    return texts + [texts[4], None, "", "short text"], passage


def test_passages_find_what_repeats_and_nothing_else(spark):
    texts, _ = planted()
    docs = frame(spark, texts)
    found = substring.passages(docs).collect()
    linked = {r["doc_id"] for r in found} | {r["other"] for r in found}
    assert linked == {2, 5, 8, 10, 4, 12}
    assert {r["doc_id"] for r in found} == {5, 8, 10, 12}
    exact_spans = {(r["start"], r["end"]) for r in found if r["doc_id"] == 5 and r["other"] == 2}
    assert exact_spans == {(80, 140)}
    assert all(r["other"] < r["doc_id"] and r["similarity"] >= 0.8 for r in found)
    assert substring.passages(docs.where("false")).count() == 0


def test_links_of_a_hot_signature_stay_linear():
    """Windows with equal surroundings collapse to one; of the rest all link to the smallest doc of their kind."""
    n = 5000
    key, none, doc = np.zeros(n, np.uint64), np.zeros(n, np.uint16), np.arange(n)[::-1].copy()
    near = (np.arange(n) % 7).astype(np.uint32)
    stand, (high, low, _, _) = substring._collapse(key, none, none, near, doc, np.arange(n, dtype=np.int32))
    assert len(stand) == 7 and len(high) == n - 7 and set(doc[stand]) == set(range(7)) and set(low) == set(range(7))
    head, heads = substring.star(key[stand], doc[stand])
    assert len(heads) == 1 and set(doc[stand][head]) == {0}


def test_cut_passages_leaves_one_copy_and_the_rest_untouched(spark):
    texts, passage = planted()
    docs = frame(spark, texts)
    cut = substring.cut_passages(docs, substring.passages(docs))
    assert cut.columns == docs.columns
    got = {r["doc_id"]: r for r in cut.collect()}
    assert passage.upper() in got[2]["text"] and passage.upper() not in got[5]["text"]
    assert got[0]["text"] == texts[0] and got[1]["text"] == texts[1]
    assert got[5]["text"] == prose(80, 805) + " " + prose(90, 905)
    assert got[5]["n_chars"] == len(got[5]["text"])
    assert 12 not in got  # nothing was left of the copy


def test_passages_inside_heavily_edited_copies(spark):
    words = prose(400, 42).split()
    copy = list(words)
    for k in (20, 31, 40, 100, 108, 119, 180, 300, 309, 318, 330, 345):
        copy[k] = "edited"
    found = substring.passages(frame(spark, [" ".join(words), " ".join(copy)])).collect()
    covered = {k for r in found for k in range(r["start"], r["end"])}
    assert set(range(41, 100)) <= covered and set(range(120, 180)) <= covered and set(range(181, 300)) <= covered
