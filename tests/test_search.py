"""Closed loops and re-based coefficients against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import search, transforms
from tessella.operators.blocks import dct_basis


def dct(block, n):
    m = np.array(dct_basis(n))
    return m @ block @ m.T


def rounded(coefficients, step):
    m = np.array(dct_basis(8))
    return m.T @ (step * np.floor(coefficients / step + 0.5)) @ m


def test_search_is_a_plain_loop(spark):
    r = np.random.default_rng(3)
    cells = [r.normal(0, scale, (8, 8)) for scale in (0, 0.001, 0.1, 1, 30)]
    target, levels, least = 0.07, 40, 0.004
    rows = spark.createDataFrame([(k, b.ravel().tolist()) for k, b in enumerate(cells)], "k int, block array<double>")
    got = {x["k"]: x for x in search.largest_step(rows, "block", target, levels, least).collect()}
    for k, b in enumerate(cells):
        low, high = 0, levels
        error = lambda level, b=b: np.abs(rounded(dct(b, 8), least * 2 ** (level / 4)) - b).max()
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if error(middle) <= target else (low, middle)
        assert got[k]["level"] == low and math.isclose(got[k]["error"], error(low), abs_tol=1e-12)
        assert got[k]["error"] <= target or low == 0
    assert {x["rounds"] for x in got.values()} == {math.ceil(math.log2(levels))}
    assert search.largest_step(rows.where("false"), "block", target).count() == 0


@pytest.mark.parametrize("n,small", [(16, 8), (32, 8), (8, 4)])
def test_rebasing_needs_no_pixels(spark, n, small):
    block = np.random.default_rng(n).normal(size=(n, n))
    parts = block.copy()
    for y in range(0, n, small):
        for x in range(0, n, small):
            parts[y : y + small, x : x + small] = dct(block[y : y + small, x : x + small], small)
    row = spark.createDataFrame([(parts.ravel().tolist(),)], "v array<double>").select(transforms.rebase(F.col("v"), n, small).alias("w"))
    both = row.select("w", transforms.unbase(F.col("w"), n, small).alias("v")).first()
    assert np.allclose(both["w"], dct(block, n).ravel()) and np.allclose(both["v"], parts.ravel())
