"""Robust modes: their definitions over all windows, and properties."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from tessella.operators import kernels


def mode_by_all_windows(values):
    v = sorted(values)
    while len(v) > 2:
        take = (len(v) + 1) // 2
        v = min((v[i : i + take] for i in range(len(v) - take + 1)), key=lambda w: w[-1] - w[0])
    return (v[0] + v[-1]) / 2


@pytest.mark.parametrize("n,kinds", [(1, 1), (2, 2), (3, 2), (4, 4), (5, 1), (17, 6), (100, 30), (999, 40), (1000, 1000), (2500, 700)])
def test_mode_of_counts_is_that_of_all_windows(n, kinds):
    for seed in range(5):
        r = np.random.default_rng(100 * n + seed)
        values = np.round(r.exponential(50, kinds), 2)[r.integers(0, kinds, n)]
        v, c = np.unique(values, return_counts=True)
        mixed = r.permutation(len(v))
        want = mode_by_all_windows(values.tolist())
        assert kernels.half_sample_mode(v[mixed], c[mixed]) == kernels.half_sample_mode(values) == want


def test_mode_moves_and_grows_with_the_sample():
    r = np.random.default_rng(3)
    values = np.concatenate((r.normal(40, 1, 700), r.uniform(0, 400, 300)))
    mode = kernels.half_sample_mode(values)
    assert abs(mode - 40) < 2
    assert np.isclose(kernels.half_sample_mode(values * 3 + 5), mode * 3 + 5)


def test_half_range_mode_is_in_the_densest_part():
    r = np.random.default_rng(4)
    for _ in range(50):
        counts = r.integers(0, 5, 64)
        counts[20:24] += 60
        assert 20 <= kernels.half_range_mode(counts) < 24
    assert kernels.half_range_mode([7]) == 0 and kernels.half_range_mode([0, 0, 9, 0, 0]) == 2


def test_query_goes_by_raw_values(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, round(r.gauss(30 + len(k), 4), 2)) for k in ("view", "error") for _ in range(1500)] + [("view", None)]
    spark.createDataFrame(rows, "event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {x["event_type"]: x["mode"] for x in entry.queries()["half_sample_mode"](spark, str(tmp_path)).collect()}
    assert got == {k: kernels.half_sample_mode([v for t, v in rows if t == k and v is not None]) for k in ("view", "error")}
