"""Verification of passages against brute force over all windows, and what of planted passages is found."""

import numpy as np
import pytest

from tessella.llm import substring
from tests.llm.fixtures import prose

WIDTH = substring.MIN_WORDS - substring.WORDS + 1


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b)


def pair(a, b):
    mine, other = (substring.tokens(t) for t in (a, b))
    found = substring.shared_runs(mine, substring.Sorted(other), WIDTH)
    for s, e, c, d, x in found:
        assert e - s >= WIDTH and x >= substring.SIMILARITY
        assert abs(jaccard(mine[s:e], other[c:d]) - x) < 1e-12
    return mine, other, found


def coverable(mine, other):
    """Tokens of windows (start, end at equal tokens) that some window of other, no shorter than a
    passage, is similar to, the slow way."""
    seats = {}
    for j, v in enumerate(other.tolist()):
        seats.setdefault(v, []).append(j)
    starts = [i for i, v in enumerate(mine.tolist()) if v in seats]
    out = set()
    for s in starts:
        for e in starts:
            if e + 1 - s < WIDTH or set(range(s, e + 1)) <= out:
                continue
            places = sorted({j for v in mine[s : e + 1].tolist() for j in seats.get(v, [])})
            if any(jaccard(mine[s : e + 1], other[c : d + 1]) >= substring.SIMILARITY for c in places[:5] for d in places[-5:] if d + 1 - c >= WIDTH):
                out |= set(range(s, e + 1))
    return out


def around(text, seed):
    return prose(70, seed) + " " + text + " " + prose(70, seed + 1)


def test_two_changed_words_near_each_other():
    words = prose(100, 1).split()
    copy = list(words)
    copy[48], copy[53] = "first", "second"
    mine, other, found = pair(around(" ".join(copy), 10), around(" ".join(words), 20))
    assert [x[:4] for x in found] == [(70, 166, 70, 166)] and round(found[0][4], 2) == 0.81
    assert set(range(70, 166)) <= coverable(mine, other)


def test_words_inserted_in_either_text():
    words = prose(80, 2).split()
    plain, longer = around(" ".join(words), 10), around(" ".join(words[:40] + prose(7, 3).split() + words[40:]), 20)
    for a, b, want in ((plain, longer, (70, 146, 70, 153)), (longer, plain, (70, 153, 70, 146))):
        mine, other, found = pair(a, b)
        assert [x[:4] for x in found] == [want] and round(found[0][4], 2) == 0.83
        assert set(range(want[0], want[1])) <= coverable(mine, other)


def test_random_edits_are_found_as_by_brute_force():
    r = np.random.default_rng(8)
    for k in range(25):
        words = prose(90, 100 + k).split()
        copy = list(words)
        for at in sorted(r.integers(0, 90, r.integers(1, 5)).tolist(), reverse=True):
            copy[at : at + int(r.integers(0, 2))] = prose(int(r.integers(0, 5)), 1000 * k + at).split()
        mine, other, found = pair(around(" ".join(copy), 200 + k), around(" ".join(words), 300 + k))
        covered = {i for s, e, *_ in found for i in range(s, e)}
        assert coverable(mine, other) <= covered


def test_an_accepted_stretch_does_not_hide_rejected_ones():
    line = prose(9, 50).split()
    parts = [prose(60, k).split() for k in (11, 12, 13)]
    for part in parts[:2]:
        part[25:34] = line
    a, b, c = (" ".join(p) for p in parts)
    _, _, found = pair(" ".join((a, b, c)), " ".join((a, prose(30, 21), b, prose(30, 22), c)))
    assert [x[:4] for x in found] == [(0, 56, 0, 56), (60, 116, 90, 146), (120, 176, 180, 236)]


def test_copies_among_repeated_lines():
    line = prose(9, 60)
    for k in range(10):
        parts = [f"{line} {prose(52, 70 + 3 * k + i)} {line}" for i in range(3)]
        filler = [f"{prose(20, 400 + 5 * k + i)} {line} {prose(20, 600 + 5 * k + i)}" for i in range(4)]
        mine, other, found = pair(" ".join(parts), " ".join(x for p in zip(filler, parts[::-1]) for x in p))
        covered = {i for s, e, *_ in found for i in range(s, e)}
        for i in range(3):
            assert set(range(70 * i, 70 * i + 66)) <= covered


def candidate(a, b):
    """Whether a window of a and one of b are of one kind."""
    values = [substring.tokens(t) for t in (a, b)]
    owner = np.repeat([0, 1], [len(v) for v in values])
    key, right, left, _, at = substring.windows(np.concatenate(values), owner, WIDTH)
    kinds = [{(int(k), side, int(x)) for k, x, d in zip(key, near, owner[at], strict=True) if x and d == doc} for doc in (0, 1) for side, near in ((0, right), (1, left))]
    return bool((kinds[0] | kinds[1]) & (kinds[2] | kinds[3]))


def near_fifty(k):
    """Two texts around a 50-word passage, in one of which a word of its middle is changed: similarity 41/51."""
    words = prose(50, 5000 + k).split()
    copy = list(words)
    copy[5 + k % 40] = "changed"
    return around(" ".join(copy), 10 * k), around(" ".join(words), 10 * k + 5)


def test_recall_of_fifty_words_with_one_changed():
    pairs = [near_fifty(k) for k in range(1000)]
    assert sum(candidate(a, b) for a, b in pairs) >= 997
    assert all(pair(a, b)[2] for a, b in pairs[:200])


def test_recall_of_fifty_words_in_the_whole_plan(spark):
    texts = [t for k in range(100) for t in near_fifty(k)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["other"], r["doc_id"]) for r in substring.passages(docs).collect()}
    assert found == {(2 * k, 2 * k + 1) for k in range(100)}


def test_no_link_is_lost_to_a_representative(spark):
    """A line of 30 words stands in every text; pairs that share more of a passage meet behind it, whoever has the smallest doc_id."""
    line = prose(30, 77)
    texts = []
    for k in range(40):
        shared = f"{prose(15, 900 + k // 2)} {line} {prose(15, 950 + k // 2)}" if k >= 10 else f"{prose(15, 800 + k)} {line} {prose(15, 850 + k)}"
        texts.append(around(shared, 3000 + 2 * k))
    found = {(r["other"], r["doc_id"]) for r in substring.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {(k, k + 1) for k in range(10, 40, 2)}


def linked_by_brute_force(texts):
    """Pairs of texts with a similar stretch, by looking at all of them."""
    values = [substring.tokens(t) for t in texts]
    return {(i, j) for j in range(len(texts)) for i in range(j) if len(values[i]) >= WIDTH and len(values[j]) >= WIDTH and substring.shared_runs(values[j], substring.Sorted(values[i]), WIDTH)}


def roots(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_against_brute_force(spark):
    """Near copies, passages and lines that groups share in turn, most pairs hardly above the least similarity: what is found is
    right, and nearly every document is in the component that brute force over all pairs puts it in."""
    r = np.random.default_rng(4)
    lines, blocks = [prose(20, 40 + k) for k in range(3)], [prose(60, 50 + k).split() for k in range(6)]
    texts = [None, "", "short"]
    for k in range(60):
        parts = [prose(40, 7000 + k)]
        for _ in range(3):
            block = list(blocks[r.integers(6)])
            block[r.integers(60)] = f"x{k}"
            parts += [lines[r.integers(3)], " ".join(block) if r.random() < 0.5 else prose(60, int(r.integers(10**6)))]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5]), (None, texts[6])], "doc_id long, text string")
    found = {(row["other"], row["doc_id"]) for row in substring.passages(docs).collect()}
    wanted = linked_by_brute_force(texts)
    assert found <= wanted
    linked = {i for p in wanted for i in p}
    here, there = roots(len(texts), found), roots(len(texts), wanted)
    assert sum(here[i] != there[i] for i in linked) <= 0.05 * len(linked)


def test_odd_tables(spark):
    long = " ".join(prose(100, 60_000 + k) for k in range(300))
    passage = prose(70, 31)
    rows = [(None, passage), (None, passage), (1, None), (2, ""), (3, passage), (3, passage), (3, prose(70, 32)), (9, f"{long} {passage}"), (9, f"{long} {passage}")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3.0) for i, t in rows], "doc_id long, text string, links int, salt int, bucket double")
    found = {(r["doc_id"], r["other"], r["start"], r["end"]) for r in substring.passages(docs).collect()}
    assert found == {(9, 3, 30_000, 30_070)}
    assert substring.passages(docs.where("false")).count() == 0


def test_a_pair_met_again_is_not_compared_again(spark, monkeypatch):
    """Two documents share a passage and, elsewhere, a line: a round that links them by the line alone knows the passage already."""
    monkeypatch.setattr(substring, "BROADCAST_PAIRS", 0)
    passage, line = " ".join(f"p{k}" for k in range(60)), " ".join(f"l{k}" for k in range(12))
    texts = [f"{' '.join(f'{x}{k}' for k in range(80))} {line} {' '.join(f'{x}{k}' for k in range(80, 160))} {passage}" for x in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mine, theirs = (substring.tokens(x) for x in reversed(texts))
    at = [int(np.flatnonzero(x == substring.tokens(line)[4])[0]) for x in (mine, theirs)]
    pairs = spark.createDataFrame([(1, 0, bytearray(np.array([at], np.int32).tobytes()))], "doc_id long, other long, links binary")
    first = substring.verify(docs, pairs, 4)
    rows = first.where("similarity is not null").collect()
    assert [(r["doc_id"], r["other"], r["end"] - r["start"]) for r in rows] == [(1, 0, 60)]
    again = substring.verify(docs, pairs, 4, met=first.where("digest is not null").select("doc_id", "other", "digest", "covered"))
    assert again.where("similarity is not null or digest is not null").count() == 0
    keys = [sorted(bytes(r["key"]) for r in x.where("bucket is not null").collect()) for x in (first, again)]
    assert keys[0] and keys[0] == keys[1]  # the line's windows go round again either way


def test_every_pair_of_small_kinds():
    r = np.random.default_rng(3)
    kind, doc = r.integers(0, 40, 150).astype(np.uint64), r.integers(0, 60, 150)
    of, to, rest = substring._every_pair(kind, doc, 4)
    sizes = np.bincount(kind.astype(np.int64))
    small = {i for i in range(150) if sizes[int(kind[i])] <= 4}
    assert set(rest.tolist()) == set(range(150)) - small
    assert (doc[of] >= doc[to]).all()
    assert sorted(tuple(sorted(p)) for p in zip(of.tolist(), to.tolist())) == [(i, j) for i in sorted(small) for j in sorted(small) if i < j and kind[i] == kind[j]]
    assert not any(len(x) for x in substring._every_pair(kind[:0], doc[:0], 4))


def test_small_kinds_go_by_documents(spark):
    """Three documents with fifty windows each of one kind: every two of them are linked once and for all, in both orders of rows."""
    r = np.random.default_rng(5)
    n = 150
    doc, at, near = np.arange(n) % 3 + 7, np.arange(n, dtype=np.int32), r.permutation(n).astype(np.uint32)
    for order in (np.arange(n), np.arange(n)[::-1]):
        rows = substring._entry_rows(np.full(n, 5 << 32, np.uint64), np.full(n, 9, np.uint16), np.zeros(n, np.uint16), near[order], doc[order], at[order], 2)
        entries = spark.createDataFrame(substring._packed(rows).to_pylist(), substring._SEED)
        found = {(x["doc_id"], x["other"]): np.frombuffer(x["links"], np.int32).reshape(-1, 2) for x in substring.linked(entries, 2, whole=4).collect()}
        assert found.keys() == {(8, 7), (9, 7), (9, 8)}
        assert all(len(x) == 1 and x[0, 1] < 0 and doc[x[0, 0]] == a and doc[~x[0, 1]] == b for (a, b), x in found.items())
    kind, doc = r.integers(0, 40, 400).astype(np.uint64), r.integers(0, 9, 400)
    of, to, rest = substring._whole_kinds(kind, doc, 6)
    docs = {k: sorted(set(doc[kind == k].tolist())) for k in range(40)}
    assert set(rest.tolist()) == {i for i in range(400) if len(docs[int(kind[i])]) > 6}
    assert sorted((int(kind[i]), int(doc[j]), int(doc[i])) for i, j in zip(of, to)) == [(k, a, b) for k, x in docs.items() if len(x) <= 6 for a in x for b in x if a < b]
    assert (kind[of] == kind[to]).all() and not any(len(x) for x in substring._whole_kinds(kind[:0], doc[:0], 4))


@pytest.mark.parametrize("kinds", [2, 9, 400])
def test_diagonals_are_all_runs_of_equal_tokens(kinds):
    r = np.random.default_rng(kinds)
    a, b = (r.integers(1, kinds + 1, n).astype(np.uint64) for n in (60, 47))
    b[5:25] = a[30:50]
    i, j, n = substring._diagonals(a, substring.Sorted(b), np.ones(len(a), bool))
    want = []
    for p in range(len(a)):
        for q in range(len(b)):
            if a[p] == b[q] and (p == 0 or q == 0 or a[p - 1] != b[q - 1]):
                k = 0
                while p + k < len(a) and q + k < len(b) and a[p + k] == b[q + k]:
                    k += 1
                want.append((p, q, k))
    assert sorted(zip(i.tolist(), j.tolist(), n.tolist())) == want


def test_a_later_round_picks_its_texts_without_a_shuffle(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "string(id) as text")
    few = substring._likely(docs, docs.where("doc_id % 1000 = 7").unionByName(docs.where("doc_id % 1000 = 7")).select("doc_id"))
    found = {r["doc_id"] for r in few.collect()}
    assert few.columns == docs.columns and few.count() == len(found) <= 25
    assert set(range(7, 20_000, 1000)) <= found
    assert substring._likely(docs, docs.where("false").select("doc_id")).count() == 0
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_released_shuffle_files_go_with_the_write(spark):
    from tessella.storage import materialize

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    seen = []

    class Docs:
        sparkSession, schema = spark, spark.range(1).schema

        class write:
            @staticmethod
            def parquet(path):
                seen.append(spark.conf.get(setting))
                spark.range(9).repartition(3).write.parquet(path)

    assert materialize(Docs, "released", release=True).count() == 9 and materialize(Docs, "kept").count() == 9
    assert seen == ["true", before] and spark.conf.get(setting) == before
