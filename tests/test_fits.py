"""Lines with knots against least squares over all points at once."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import fits


def least_squares(places, values, step):
    at = np.array(places) / step
    n = int(np.ceil(at.max())) + 1
    m = np.maximum(0, 1 - np.abs(at[:, None] - np.arange(n)[None, :]))
    return np.linalg.lstsq(m, np.array(values), rcond=None)[0], m


def test_fit_is_least_squares(spark):
    r = np.random.default_rng(6)
    rows = []
    for k in range(4):
        for x in r.choice(r.uniform(0, 30, 40), 200):
            rows.append((k if k else None, float(x), float(np.sin(x / 4) * 10 + r.normal())))
    rows += [(1, 3.0, -1.0), (1, None, 4.0), (1, -2.0, 4.0), (1, 2.0, None), (9, 1.0, -1.0)]
    got = {x["k"]: x["heights"] for x in fits.knot_fit(spark.createDataFrame(rows, "k int, x double, v double"), ["k"], "x", "v", 4.0, exclude=-1.0).collect()}
    assert set(got) == {None, 1, 2, 3}
    for k, heights in got.items():
        mine = [(x, v) for a, x, v in rows if a == k and x is not None and x >= 0 and v not in (None, -1.0)]
        wanted, m = least_squares([x for x, _ in mine], [v for _, v in mine], 4.0)
        assert np.allclose(heights, wanted, atol=1e-6)
        df = spark.createDataFrame([(heights, x) for x, _ in mine], "h array<double>, x double")
        assert np.allclose([y[0] for y in df.select(fits.height_at(F.col("h"), F.col("x"), 4.0)).collect()], m @ wanted, atol=1e-6)


def test_few_points_and_gaps(spark):
    rows = [(1, 0.0, 5.0), (2, 3.0, 6.0), (3, 1.0, 2.0), (3, 25.0, 4.0), (4, 8.0, 3.0), (4, 8.0, 5.0)]
    got = {x["k"]: x["heights"] for x in fits.knot_fit(spark.createDataFrame(rows, "k int, x double, v double"), ["k"], "x", "v", 4.0).collect()}
    assert np.isclose(got[1][0], 5) and len(got[1]) == 1
    # one point between two knots: of all lines through it the one of least height
    wanted, _ = least_squares([3.0], [6.0], 4.0)
    assert np.allclose(got[2], wanted, atol=1e-6)
    assert [h is None for h in got[3]] == [False, False, True, True, True, True, False, False]
    assert got[4][:2] == [None, None] and np.isclose(got[4][2], 4)
    assert fits.knot_fit(spark.createDataFrame([], "k int, x double, v double"), ["k"], "x", "v", 4.0).count() == 0


def test_planes_keep_bilinear_ones(spark):
    cells = [(0, c, y, x, float(2 * x + 3 * y + x * y / 7 + c)) for c in range(2) for y in range(11) for x in range(9)]
    hurt = [(i, c, y, x, -1.0 if (x + y) % 5 == 0 else v) for i, c, y, x, v in cells]
    got = fits.plane_knots(spark.createDataFrame(hurt, "image_id int, c int, y int, x int, v double"), 4, exclude=-1.0).collect()
    assert len(got) == 2 * 3 * 4
    assert all(abs(r["v"] - (2 * 4 * r["x"] + 3 * 4 * r["y"] + 16 * r["x"] * r["y"] / 7 + r["c"])) < 1e-5 for r in got)
