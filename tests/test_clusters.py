"""Clusters by rounds of mutual best pairs: against merging the best pair of all, one at a time, and the same rounds in a loop."""

import math

import numpy as np
import pytest

from tessella.operators import clusters


def term(x):
    return x * math.log2(x) if x else 0.0


def entropy(h):
    return term(h.sum()) - sum(map(term, h.tolist()))


def gain(a, b, overhead):
    return overhead - (entropy(a + b) - entropy(a) - entropy(b))


def total(groups, tables, overhead):
    return sum(entropy(sum(tables[i] for i in g)) + overhead for g in groups)


def greedy(tables, overhead):
    groups = [[i] for i in range(len(tables))]
    while len(groups) > 1:
        sums = [sum(tables[i] for i in g) for g in groups]
        best = max((gain(sums[i], sums[j], overhead), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if best[0] <= 0:
            break
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    return groups


@pytest.mark.parametrize("seed,overhead", [(1, 24.0), (2, 60.0)])
def test_rounds_are_nearly_as_good_as_the_best_pair_at_a_time(spark, seed, overhead):
    r = np.random.default_rng(seed)
    shapes = r.dirichlet(np.ones(6) * 0.7, 4)
    tables = np.array([r.multinomial(r.integers(10, 200), shapes[r.integers(4)]) for _ in range(24)])
    rows = [(g, i, k, int(n)) for g in (0, 7) for i, t in enumerate(tables) for k, n in enumerate(t) if n]
    counts = spark.createDataFrame(rows, "grp int, context int, symbol int, n long")
    found = clusters.merge(counts, overhead)
    maps = {g: {r["context"]: r["cluster"] for r in found.collect() if r["grp"] == g} for g in (0, 7)}
    assert maps[0] == maps[7] and len(maps[0]) == len(tables)
    groups = [[i for i, c in maps[0].items() if c == k] for k in sorted(set(maps[0].values()))]
    assert all(min(g) == maps[0][g[0]] for g in groups)
    assert total(groups, tables, overhead) <= 1.01 * total(greedy(tables, overhead), tables, overhead)
    bits = clusters.bits(clusters.cluster_histograms(counts, found)).where("grp = 0").collect()
    assert math.isclose(sum(b["bits"] for b in bits) + overhead * len(groups), total(groups, tables, overhead), rel_tol=1e-9)
    sums = [sum(tables[i] for i in g) for g in groups]
    assert all(gain(a, b, overhead) <= 1e-6 for k, a in enumerate(sums) for b in sums[k + 1 :] if (a * b).any())


def test_nothing_to_merge(spark):
    counts = spark.createDataFrame([(0, 1, 0, 50), (0, 2, 1, 50)], "grp int, context int, symbol int, n long")
    assert {(r["context"], r["cluster"]) for r in clusters.merge(counts, 24.0).collect()} == {(1, 1), (2, 2)}
    assert clusters.merge(counts.where("false"), 24.0).count() == 0


def test_rounds_stop_where_told(spark):
    counts = spark.createDataFrame([(0, i, k, 40) for i in range(4) for k in range(2)], "grp int, context int, symbol int, n long")
    assert {r["cluster"] for r in clusters.merge(counts, 24.0, 0).collect()} == {0, 1, 2, 3}
    assert {(r["context"], r["cluster"]) for r in clusters.merge(counts, 24.0, 1).collect()} == {(0, 0), (1, 0), (2, 2), (3, 3)}
    assert {r["cluster"] for r in clusters.merge(counts, 24.0).collect()} == {0}


def test_more_rounds_than_the_sql_writes_down(spark, tmp_path):
    """All suppliers of one nation alike: a pair merges per round, so that SQL's rounds don't reach the end."""
    import duckdb

    from tessella.plans import tables

    spark.range(20).selectExpr("id as s_suppkey", "0 as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(20 * 40).selectExpr("id % 20 as l_suppkey", "cast(id div 20 % 40 + 1 as double) as l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    with duckdb.connect() as con:
        for name in ("supplier", "lineitem"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        expected = sorted(con.execute(tables.SQL["histogram_clusters"]).fetchall())
    found = sorted(tuple(r) for r in tables.QUERIES["histogram_clusters"](spark, str(tmp_path)).collect())
    assert found == expected and len({r[2] for r in found}) > 1


def shuffled_rows(spark):
    gateway = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    nothing = gateway.jvm.java.util.ArrayList()
    return {s.stageId(): s.shuffleWriteRecords() for s in (lambda x: [x.apply(k) for k in range(x.size())])(store.stageList(nothing, False, False, gateway.new_array(gateway.jvm.double, 0), nothing))}


def test_no_pair_is_a_row(spark):
    """600 clusters of one group are 179,700 pairs; what is shuffled goes by clusters."""
    counts = spark.range(600).selectExpr("0 as grp", "id as context", "explode(sequence(0, 2)) as symbol").selectExpr("*", "40 + (context * 7 + symbol * 5) % 11 as n")
    before = set(shuffled_rows(spark))
    found = clusters.merge(counts, 24.0, 1)
    rows = sum(n for stage, n in shuffled_rows(spark).items() if stage not in before)
    assert found.count() == 600 and found.select("cluster").distinct().count() < 600
    assert rows < 20000


@pytest.mark.parametrize("kind", ["string", "int"])
def test_blocks_change_nothing(spark, monkeypatch, kind):
    """Clusters dealt to many blocks, some of them empty, with rare, missing and unknown symbols, against all pairs one by one."""
    r = np.random.default_rng(8)
    tables = np.array([r.multinomial(r.integers(1, 60), p) for p in r.dirichlet(np.ones(7) * 0.4, 3)[r.integers(0, 3, 60)]])
    tables[30:45] = tables[:15]  # ties
    rows = [(0, f"{i:03d}", None if k == 6 else f"s{k}", int(n)) for i, t in enumerate(tables) for k, n in enumerate(t) if n]
    counts = spark.createDataFrame(rows, "grp int, context string, symbol string, n long")
    if kind == "int":
        counts = counts.selectExpr("grp", "int(context) as context", "int(substr(symbol, 2)) as symbol", "n")
    of = list(range(len(tables)))
    for _ in range(3):
        sums = {c: sum(tables[i] for i in range(len(of)) if of[i] == c) for c in set(of)}
        best = {}
        for x in sums:
            gains = [(-round(24.0 - term(sums[x].sum() + sums[y].sum()) + term(sums[x].sum()) + term(sums[y].sum()) + sum(term(a + b) - term(a) - term(b) for a, b in zip(sums[x][:6].tolist(), sums[y][:6].tolist())), 6), y) for y in sums if y != x and (sums[x] * sums[y])[:6].any()]
            if gains and min(gains)[0] < 0:
                best[x] = min(gains)[1]
        into = {y: x for x, y in best.items() if x < y and best.get(y) == x}
        of = [into.get(c, c) for c in of]
    assert len(set(of)) < len(of) - 10
    for size in (2048, 25, 3):
        monkeypatch.setattr(clusters, "BLOCK_CLUSTERS", size)
        found = {int(r["context"]): int(r["cluster"]) for r in clusters.merge(counts, 24.0, 3).collect()}
        assert [found[i] for i in range(len(of))] == of
