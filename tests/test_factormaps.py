from pyspark.sql import functions as F

from tessella.operators import factormaps, grid


def _image(spark, factors):
    """Two planes of 16 x 8: plane 0 is each tile's factor of plane 1, in 8 x 8 tiles."""
    g = grid.generate(spark, 16, 8, 2, (F.col("x") * 3 + F.col("y") * 5 + 7).cast("double"))
    of = F.when(F.col("x") < 8, factors[0]).otherwise(factors[1])
    return g.withColumn("v", F.when(F.col("c") == 0, F.col("v") * of).otherwise(F.col("v")))


def test_each_tile_gets_its_factor_and_planes_come_back(spark):
    image = _image(spark, (0.5, -0.25))
    found = factormaps.best_factors(image, 0.25, tile=8)
    assert sorted((r["tx"], r["factor"], r["zeros"]) for r in found.collect()) == [(0, 128 + 32, 64), (1, 128 - 16, 64)]
    read = factormaps.read_map(factormaps.map_bytes(found))
    flat = factormaps.apply_map(image, read, -1, tile=8)
    assert flat.where("c = 0").agg(F.max(F.abs("v"))).first()[0] == 0
    assert grid.differences(image, factormaps.apply_map(flat, read, 1, tile=8)).isEmpty()


def test_one_factor_for_all_unless_tiles_gain_clearly(spark):
    found = factormaps.best_factors(_image(spark, (0.5, 0.5)), 0.25, tile=8)
    assert {(r["factor"], r["zeros"]) for r in found.collect()} == {(160, 64)}
    assert factormaps.map_bytes(found).first()["code"] == "00400000"  # 32 up, then a run of no change


def test_votes_against_trying_all_factors(spark):
    g = grid.generate(spark, 16, 8, 3, ((F.col("x") * 37 + F.col("y") * 91 + F.col("c") * 53) % 64 - 30).cast("double"))
    cells = {(r["c"], r["y"], r["x"]): r["v"] for r in g.collect()}
    zero = lambda c, y, x, f: cells[1, y, x] != 0 and abs(cells[c, y, x] - (f - 128) / 64 * cells[1, y, x]) <= 3.0
    tally = lambda c, xs, f: sum(zero(c, y, x, f) for y in range(8) for x in xs)
    best = lambda c, xs: max(range(256), key=lambda f: (tally(c, xs, f), -f))
    for r in factormaps.best_factors(g, 6.0, tile=8).collect():
        c, spans = r["c"], [range(8), range(8, 16)]
        own, whole = [best(c, s) for s in spans], best(c, range(16))
        local = sum(tally(c, s, f) for s, f in zip(spans, own)) > 1.25 * tally(c, range(16), whole)
        assert r["factor"] == (own[r["tx"]] if local else whole) and r["zeros"] == tally(c, spans[r["tx"]], r["factor"])


def test_nobody_votes_for_null_or_zero_cells(spark):
    image = _image(spark, (0.5, 0.5)).withColumn("v", F.when(F.col("c") == 1, 0.0).when(F.col("x") > 3, F.col("v")))
    assert {(r["factor"], r["zeros"]) for r in factormaps.best_factors(image, 0.25, tile=8).collect()} == {(128, 0)}
    assert factormaps.best_factors(image.limit(0), 0.25).count() == 0
