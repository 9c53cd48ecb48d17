import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.operators import colorspace

# Published values: linear sRGB to XYZ at D50 (Bradford).
SRGB_D50 = [0.4360747, 0.3850649, 0.1430804, 0.2225045, 0.7168786, 0.0606169, 0.0139322, 0.0971045, 0.7141733]


def _names(spark, *texts):
    return colorspace.named(spark.createDataFrame([(t,) for t in texts], "name string"))


def _convert(spark, rows, **more):
    return colorspace.convert(spark.createDataFrame(rows, "r double, g double, b double, source string, target string"), **more)


def test_known_matrix_and_its_inverse(spark):
    row = colorspace.profiles(_names(spark, "RGB_D65_SRG_Rel_SRG")).first()
    assert np.allclose(row["adapted"], SRGB_D50, atol=2e-4)
    assert np.allclose(np.reshape(row["adapted"], (3, 3)) @ np.reshape(row["adapted_back"], (3, 3)), np.eye(3), atol=1e-12)
    assert np.allclose(np.sum(np.reshape(row["own"], (3, 3)), axis=1), [0.3127 / 0.329, 1, (1 - 0.3127 - 0.329) / 0.329])


@pytest.mark.parametrize("transfer", ["SRG", "Lin", "PeQ", "HLG", "g0.4547069"])
def test_colours_come_back_from_every_space(spark, transfer):
    there = [f"RGB_{w}_{p}_{i}_{transfer}" for w in names.WHITE_POINTS for p in names.PRIMARIES for i in ("Rel", "Abs")]
    rows = [(r, g, b, "RGB_D65_SRG_Rel_SRG", t) for t in there for r, g, b in ((0.2, 0.9, 0.01), (1.0, 0.0, 0.5))]
    once = _convert(spark, rows)
    kept = once.select("r", "g", "b", F.col("target").alias("source"), F.when(F.col("target").contains("_Abs_"), "RGB_D65_SRG_Abs_SRG").otherwise("RGB_D65_SRG_Rel_SRG").alias("target"))
    for row in colorspace.convert(kept).collect():
        assert any(np.allclose([row["r"], row["g"], row["b"]], v, atol=1e-6) for v in ((0.2, 0.9, 0.01), (1, 0, 0.5)))


def test_white_stays_white_unless_colours_stay_as_measured(spark):
    out = _convert(spark, [(1.0, 1.0, 1.0, "RGB_D65_SRG_Rel_SRG", f"RGB_D50_202_{i}_Lin") for i in ("Rel", "Per", "Sat", "Abs")])
    white = {r["target"][12:15]: (r["r"], r["g"], r["b"]) for r in out.collect()}
    assert all(np.allclose(white[i], 1, atol=1e-9) for i in ("Rel", "Per", "Sat"))
    assert white["Abs"][2] > 1.2


def test_gray_is_luminance_and_back_is_neutral(spark):
    out = _convert(spark, [(0.3, 0.6, 0.1, "RGB_D65_SRG_Rel_Lin", "Gra_D65_Rel_Lin"), (0.4, 0.4, 0.4, "Gra_D50_Rel_Lin", "RGB_D65_SRG_Rel_Lin")]).collect()
    at = {r["source"]: r for r in out}
    y = 0.3 * SRGB_D50[3] + 0.6 * SRGB_D50[4] + 0.1 * SRGB_D50[5]
    assert np.allclose([at["RGB_D65_SRG_Rel_Lin"][c] for c in "rgb"], y, atol=2e-4)
    assert np.allclose([at["Gra_D50_Rel_Lin"][c] for c in "rgb"], 0.4, atol=1e-9)


def test_ill_formed_and_null_names_give_null_colours_and_keep_rows(spark):
    good = "RGB_D65_SRG_Rel_SRG"
    rows = [(0.5, 0.5, 0.5, good, "RGB_D65_XYZ_Rel_SRG"), (0.5, 0.5, 0.5, None, good), (0.5, 0.5, 0.5, good, None), (0.5, 0.5, 0.5, "", good), (0.5, 0.5, 0.5, good, good), (0.5, 0.5, 0.5, good, good)]
    out = _convert(spark, rows).collect()
    assert sorted(r["r"] is None for r in out) == [False, False, True, True, True, True]
    assert _convert(spark, [(None, 0.5, 0.5, good, good)]).first()["r"] is None
    assert _convert(spark, []).count() == 0


def test_own_numbers_clashing_columns_and_primaries_on_a_line(spark):
    own = spark.createDataFrame([("a", [0.3127, 0.329], list(names.PRIMARIES["SRG"]), "Lin", None, False, False), ("b", [0.3127, 0.329], list(names.PRIMARIES["202"]), None, 0.5, False, False), ("line", [0.3, 0.3], [0.1, 0.1, 0.2, 0.2, 0.4, 0.4], "Lin", None, False, False)], "name string, white array<double>, primaries array<double>, transfer string, gamma double, absolute boolean, gray boolean")
    rows = spark.createDataFrame([(0.2, 0.4, 0.6, "a", "b", 1, 2), (0.2, 0.4, 0.6, "a", "line", 1, 2)], "r double, g double, b double, source string, target string, profile int, name int")
    out = {r["target"]: r for r in colorspace.convert(rows, encodings=own).collect()}
    named = _convert(spark, [(0.2, 0.4, 0.6, "RGB_D65_SRG_Rel_Lin", "RGB_D65_202_Rel_g0.5")]).first()
    assert np.allclose([out["b"][c] for c in "rgb"], [named[c] for c in "rgb"]) and (out["b"]["profile"], out["b"]["name"]) == (1, 2)
    assert out["line"]["g"] is None
