"""Descriptions of tables: bytes written and read, weights against a loop, choices against all candidates in numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import quanttables as qt

SCHEMA = "n int, kind int, parameters array<double>"


def band_weights(parameters):
    bands = [parameters[0]]
    for p in parameters[1:]:
        bands.append(bands[-1] * (1 + p if p > 0 else 1 / (1 - p)))
    out = []
    for i in range(64):
        pos = math.hypot(i % 8, i // 8) / 7 * (len(bands) - 1) / (math.sqrt(2) + 1e-6)
        k = int(pos)
        after = bands[min(k + 1, len(bands) - 1)]
        out.append(bands[k] * (after / bands[k]) ** (pos - k))
    return out


def described(seed):
    r = random.Random(seed)
    unit = lambda low, high: r.randint(int(low * 64), int(high * 64)) / 64
    rows = [(n, qt.BANDS, [unit(1, 500)] + [unit(-2, 2) for _ in range(n % 7)]) for n in range(12)]
    rows += [(12, qt.OCTAVES, [unit(1, 90) for _ in range(4)]), (13, qt.RAW, [unit(1, 500) for _ in range(64)]), (14, qt.BANDS, [511.0, -511.5, 511.0])]
    return rows


def test_bytes_are_read_back(spark):
    rows = described(3)
    df = spark.createDataFrame(rows, SCHEMA).select("n", qt.table_bytes(F.col("kind"), F.col("parameters")).alias("b"))
    got = {r["n"]: (r["b"], r["t"]) for r in df.select("n", "b", qt.read_table(F.col("b")).alias("t")).collect()}
    for n, kind, parameters in rows:
        data, t = got[n]
        assert len(data) == 2 + 2 * len(parameters) and (t["kind"], t["parameters"]) == (kind, parameters)
    cut = df.select(qt.read_table(F.expr("substring(b, 1, octet_length(b) - 1)")).alias("t"), qt.read_table(F.concat("b", F.lit(b"x"))).alias("u")).collect()
    assert all(r["t"] is None and r["u"] is None for r in cut)
    odd = spark.createDataFrame([(bytearray(b"\x07\x00"),), (bytearray(b""),), (bytearray(b"\x02\x00"),), (None,)], "b binary").select(qt.read_table(F.col("b")).alias("t")).collect()
    assert [r["t"] and tuple(r["t"]) for r in odd] == [None, None, (2, []), None]


def test_weights(spark):
    rows = described(5) + [(20, qt.OCTAVES, [1.0]), (21, qt.RAW, [2.0] * 63), (22, qt.BANDS, []), (23, qt.BANDS, [0.0, 1.0])]
    got = {r["n"]: r["w"] for r in spark.createDataFrame(rows, SCHEMA).select("n", qt.weights(F.col("kind"), F.col("parameters")).alias("w")).collect()}
    for n, kind, p in rows[:15]:
        wanted = band_weights(p) if kind == qt.BANDS else p if kind == qt.RAW else [p[max(i % 8, i // 8).bit_length()] for i in range(64)]
        assert np.allclose(got[n], np.maximum(wanted, 1 / 64))
    assert got[20] is None and got[21] is None and got[22] is None and got[23] is None


def test_choice_is_the_least_of_all(spark):
    r = np.random.default_rng(8)
    candidates = [(qt.BANDS, [4.0, -0.5, -0.5]), (qt.BANDS, [1.0]), (qt.OCTAVES, [8.0, 4.0, 1.0, 0.25]), (qt.BANDS, [1.0])]
    tables = [np.array(band_weights(p) if k == qt.BANDS else [p[max(i % 8, i // 8).bit_length()] for i in range(64)]) for k, p in candidates]
    blocks = [(t, (r.normal(0, scale, 64) / (1 + np.arange(64) * fall)).tolist()) for t, (scale, fall) in enumerate([(3, 0), (30, 0.5), (0.1, 0), (100, 0.01), (8, 0.1)]) for _ in range(4)]
    got = {x["tile"]: (x["choice"], x["cost"]) for x in qt.best_tables(spark.createDataFrame(blocks, "tile int, v array<double>"), ["tile"], "v", candidates, 1.5).collect()}
    for tile in range(5):
        costs = []
        for w in tables:
            v = np.array([b for t, b in blocks if t == tile])
            q = np.sign(v) * np.floor(np.abs(v) * w + 0.5)
            packed = np.where(q > 0, 2 * q, -2 * q - 1)
            bits = np.where(q != 0, 2 * np.floor(np.log2(np.maximum(packed, 0) + 1)) + 1, 0)
            costs.append((bits + 1.5 * (v - q / w) ** 2).sum())
        assert got[tile][0] == int(np.argmin(np.round(costs, 9))) and math.isclose(got[tile][1], min(costs))
    assert len({c for c, _ in got.values()}) > 1
    with pytest.raises(ValueError, match="few parameters"):
        qt.best_tables(spark.createDataFrame(blocks, "tile int, v array<double>"), ["tile"], "v", [(qt.RAW, [1.0])], 1.0)


def test_fields_round_trip(spark):
    r = random.Random(2)
    rows = [([],), ([3] * 700,), ([r.choice([0, 0, 0, 255]) for _ in range(300)],)]
    got = spark.createDataFrame(rows, "f array<long>").select("f", qt.field_bytes(F.col("f")).alias("code")).select("f", "code", qt.read_field(F.col("code")).alias("g")).collect()
    assert all(x["f"] == x["g"] for x in got) and got[1]["code"] == "ff03ff03bb03"
