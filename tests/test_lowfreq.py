"""Prediction from the blocks around: against pixels in numpy, and decoded again."""

import numpy as np

from tessella.operators import lowfreq as lf
from tessella.operators.blocks import dct_basis
from tessella.operators.stencil import gaussian

D = np.array(dct_basis(8))
SCHEMA = "image_id long, c long, by long, bx long, v array<double>"
W, H = 4, 3


def loop(blocks, mean_step, step):
    """Numbers and decoded frequencies of one plane {(by, bx): 8 x 8 frequencies}, by way of pixels."""
    rounded = lambda x: np.sign(x) * np.floor(np.abs(x) + 0.5)
    cells = np.zeros((2 * H, 2 * W))
    for (y, x), f in blocks.items():
        cells[2 * y : 2 * y + 2, 2 * x : 2 * x + 2] = rounded(f[0, 0] / mean_step) * mean_step / 8
    centre, side, corner = lf.BLUR3
    kernel = np.array([[corner, side, corner], [side, centre, side], [corner, side, corner]])
    wide = np.pad(cells, 1, mode="edge")
    blurred = sum(kernel[j, i] * wide[j : j + 2 * H, i : i + 2 * W] for j in range(3) for i in range(3))
    # frequencies 0 and 1 whose means over half-sides are the blurred cells: solved, not by formula
    to_means = np.array([[D[k, 4 * h : 4 * h + 4].mean() for k in range(2)] for h in range(2)])
    solve = np.linalg.inv(to_means)
    low, q, second = {}, {}, np.zeros_like(cells)
    for (y, x), f in blocks.items():
        e = solve @ blurred[2 * y : 2 * y + 2, 2 * x : 2 * x + 2] @ solve.T
        q[y, x] = np.zeros((8, 8))
        q[y, x][:2, :2] = rounded((f[:2, :2] - e) / step)
        low[y, x] = e + q[y, x][:2, :2] * step
        q[y, x][0, 0] = rounded(f[0, 0] / mean_step)
        low[y, x][0, 0] = q[y, x][0, 0] * mean_step
        second[2 * y : 2 * y + 2, 2 * x : 2 * x + 2] = to_means @ low[y, x] @ to_means.T
    pixels = np.kron(np.pad(second, 1, mode="edge"), np.ones((4, 4)))
    w = np.array(gaussian(4, lf.ENLARGED_SIGMA))
    smooth = lambda a: np.apply_along_axis(lambda r: np.convolve(r, w, "valid"), 1, a)
    pixels = smooth(smooth(pixels).T).T
    out = {}
    for (y, x), f in blocks.items():
        e = D @ pixels[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] @ D.T
        keep = q[y, x][:2, :2].copy()
        q[y, x] = rounded((f - e) / step)
        out[y, x] = e + q[y, x] * step
        q[y, x][:2, :2], out[y, x][:2, :2] = keep, low[y, x]
    return q, out


def test_prediction_is_that_of_pixels(spark):
    r = np.random.default_rng(11)
    planes = {}
    for image in range(2):
        for c in range(2):
            slope = np.add.outer(np.arange(8 * H), np.arange(8 * W)) * r.normal(0, 3)
            pixels = slope + r.normal(0, 4, slope.shape)
            planes[image, c] = {(y, x): D @ pixels[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] @ D.T for y in range(H) for x in range(W) if image == 0 or (y + x) % 3}
    rows = [(image, c, y, x, f.ravel().tolist()) for (image, c), blocks in planes.items() for (y, x), f in blocks.items()]
    coded = lf.encode(spark.createDataFrame(rows, SCHEMA), "v", W, H, 2.0, 1.5)
    got = {(x["image_id"], x["c"], x["by"], x["bx"]): x["q"] for x in coded.collect()}
    decoded = {(x["image_id"], x["c"], x["by"], x["bx"]): x["v"] for x in lf.decode(coded, "q", W, H, 2.0, 1.5).collect()}
    assert len(got) == len(decoded) == len(rows)
    for (image, c), blocks in planes.items():
        q, out = loop(blocks, 2.0, 1.5)
        for (y, x), f in blocks.items():
            assert got[image, c, y, x] == q[y, x].astype(int).ravel().tolist()
            assert np.allclose(decoded[image, c, y, x], out[y, x].ravel())
            limit = np.full((8, 8), 0.75)
            limit[0, 0] = 1.0
            assert (np.abs(out[y, x] - f) <= limit + 1e-9).all()


def test_smooth_planes_need_few_numbers(spark):
    pixels = 40 * np.sin(np.add.outer(np.arange(8 * H), 2 * np.arange(8 * W)) / 20)
    rows = [(0, 0, y, x, (D @ pixels[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] @ D.T).ravel().tolist()) for y in range(H) for x in range(W)]
    q = np.array([x["q"] for x in lf.encode(spark.createDataFrame(rows, SCHEMA), "v", W, H, 1.0, 6.0).collect()])
    plain = np.array([np.floor(np.abs(x[4]) / 6.0 + 0.5) for x in rows])
    assert np.abs(q[:, 1:]).sum() < 0.8 * plain[:, 1:].sum()


def test_no_blocks_and_clashing_names(spark):
    assert lf.encode(spark.createDataFrame([], SCHEMA), "v", W, H, 1.0, 1.0).count() == 0
    rows = spark.createDataFrame([(0, 0, 0, 0, [8.0] + [0.0] * 63, "mine")], SCHEMA + ", low string")
    got = lf.encode(rows, "v", 1, 1, 1.0, 1.0).collect()
    assert [x["q"][:2] for x in got] == [[8, 0]]
