import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import grid, perceptual
from tessella.operators.kernels import BitReader, BitWriter
from tessella.sources import headers


@pytest.fixture(autouse=True)
def narrow_bands(monkeypatch):
    monkeypatch.setattr(perceptual, "BAND_SIGMAS", (0.8,))


@pytest.fixture(scope="module")
def image(spark):
    return grid.generate(spark, 16, 16, 3, ((F.col("x") * 31 + F.col("y") * 17 + F.col("c") * 7) % 256).cast("double"))


def test_distance_is_zero_for_equal_images_only(image):
    worst = image.withColumn("v", F.col("v") + F.when((F.col("x") == 8) & (F.col("y") == 8), 60).otherwise(0))
    same, far = (perceptual.distance(image, b, 16, 16).first()["score"] for b in (image, worst))
    assert same == 0 < far


def test_line_distance_sees_edges_more_than_scattered_errors(spark, image):
    flat = grid.generate(spark, 16, 16, 1, F.lit(128.0))
    cells = [(3, 2), (7, 11), (12, 5), (9, 14), (1, 9), (14, 1), (5, 7)]
    edge, dots = F.col("x").between(4, 10) & (F.col("y") == 8), F.lit(False)
    for x, y in cells:
        dots = dots | ((F.col("x") == x) & (F.col("y") == y))
    far = {name: perceptual.line_distance(flat, flat.withColumn("v", F.when(hit, 168.0).otherwise(F.col("v"))), 16, 16).first() for name, hit in (("edge", edge), ("dots", dots))}
    assert far["edge"]["score"] > far["dots"]["score"] > 0 and far["edge"]["norm"] < far["edge"]["score"]
    same = perceptual.line_distance(image, image, 16, 16).first()
    assert max(same["score"], same["norm"]) < 1e-12  # sums are rounded in the order in which parts arrive


def test_line_distance_is_masked_by_the_flatter_image_and_takes_nulls_as_0(spark):
    flat = grid.generate(spark, 16, 16, 1, F.lit(0.0))
    busy = flat.withColumn("v", F.when((F.col("x") + F.col("y")) % 2 == 0, 200.0).otherwise(0.0))
    hurt = lambda p: p.withColumn("v", F.col("v") + F.when((F.col("x") == 8) & (F.col("y") == 8), 30).otherwise(0))
    on_flat, on_busy = (perceptual.line_distance(p, hurt(p), 16, 16).first()["score"] for p in (flat, busy))
    assert on_flat > 2 * on_busy > 0
    gone = busy.withColumn("v", F.when(F.col("v") > 0, F.col("v")))
    assert perceptual.line_distance(busy, gone, 16, 16).first()["score"] < 1e-12
    assert perceptual.line_distance(busy.limit(0), busy.limit(0), 16, 16).count() == 0


def test_bands_sum_to_the_image(image):
    back = perceptual.bands(image, 16, 16).groupBy(*grid.KEY).agg(F.sum("v").alias("v"))
    assert grid.relative_error(image, back).first()["max_abs"] < 1e-9


def test_plane_factors_decorrelate_and_restore(image):
    linked = image.withColumn("v", F.when(F.col("c") == 1, F.col("x") + 1.0).otherwise(0.5 * (F.col("x") + 1)))
    factors = perceptual.plane_factors(linked)
    assert {round(r["factor"], 9) for r in factors.collect()} == {0.5}
    flat = perceptual.apply_factors(linked, factors, -1)
    assert flat.where("c != 1").agg(F.max(F.abs("v"))).first()[0] < 1e-9
    assert grid.relative_error(linked, perceptual.apply_factors(flat, factors, 1)).first()["max_abs"] < 1e-9


def test_dots_are_split_and_pasted_back(spark):
    dots = grid.generate(spark, 17, 12, 1, F.when((F.col("x") == 3) & (F.col("y") == 3), 200.0).otherwise(F.lit(0.0)))
    seen = perceptual.split_dots(dots, 17, 12)
    found = seen.where("dot").collect()
    assert [(r["x"], r["y"]) for r in found] == [(3, 3)] and seen.agg(F.max("rest")).first()[0] == 0
    rest = seen.select(*grid.KEY, F.col("rest").alias("v"))
    back = perceptual.paste(rest, spark.createDataFrame([(0, 1, 3, 3)], "image_id long, id long, y int, x int"), spark.createDataFrame([(1, 0, 0, 0, 200.0)], "id long, c int, dy int, dx int, v double"))
    assert grid.differences(dots, back).isEmpty()


def test_noise_levels_and_curve(spark):
    g = grid.random_fill(grid.generate(spark, 32, 32, 1, F.lit(0.0)), 20.0, 3)
    strength = perceptual.texture_strength(g)
    assert strength.count() == 16
    levels = perceptual.noise_levels(g, 32, 32, perceptual.flat_threshold(strength, 8))
    assert levels.count() == 8
    a, gamma, b = perceptual.fit_noise(levels)
    assert np.isfinite([a, gamma, b]).all()
    noisy = perceptual.add_noise(g, 32, 32, (0.0, 1.0, 5.0), 1)
    assert noisy.count() == 1024 and not grid.differences(g, noisy).isEmpty()


def test_quant_fields(spark, image):
    field = perceptual.quant_field(image, 50.0)
    assert field.count() == 12 and field.where("v <= 0").isEmpty()
    parents = spark.createDataFrame([(0, by, bx, 0) for by in range(2) for bx in range(2)], "image_id long, by int, bx int, parent int")
    spread = perceptual.spread_to_parent(field, parents)
    assert spread.groupBy("c").agg(F.countDistinct("v").alias("n")).where("n != 1").isEmpty()
    moved = perceptual.refine(field, field.withColumn("v", F.lit(4.0)), 1.0, 0.0, 100.0).join(field.withColumnRenamed("v", "old"), perceptual.BLOCK_KEY)
    assert moved.where(F.abs(F.col("v") - 2 * F.col("old")) > 1e-9).isEmpty()


def test_coders_round_trip():
    for coder, values in ((headers.U32(), (0, 1, 15, 16, 1023, 2**32 - 1)), (headers.U64(), (0, 1, 16, 17, 272, 273, 4096, 2**40 + 5, 2**64 - 1)), (headers.Blob(), (b"", b"ab", b"a" * 500))):
        for v in values:
            out = BitWriter()
            coder.write(out, v)
            assert coder.bits(v) == out.length
            data = BitReader(out.bytes())
            assert coder.read(data) == v and data.at == out.length
    with pytest.raises(ValueError):
        headers.U32((-1, 2, 3, 4)).write(BitWriter(), 16)


def test_headers_evolve():
    old = headers.Bundle("b", (("a", headers.U32(), 3), ("f", headers.Flag(), False)), extended=2)
    new = headers.Bundle("b", (*old.fields, ("g", headers.U32(), 7)), extended=2)
    both = headers.Bundle("c", (("b", new, None), ("last", headers.U32(), 0)))
    reader = headers.Bundle("c", (("b", old, None), ("last", headers.U32(), 0)))
    value = {"b": {"a": 9, "f": True, "g": 40}, "last": 5}
    data = headers.write_header(value, both)
    assert headers.read_header(data, both) == value
    assert headers.read_header(data, reader) == {"b": {"a": 9, "f": True}, "last": 5}
    assert headers.read_header(headers.write_header({"b": {"a": 9, "f": True}, "last": 5}, reader), both)["b"]["g"] == 7
    assert len(headers.write_header({})) == 5 and headers.read_header(headers.write_header({})) == headers.FILE.default()


def test_headers_as_columns(spark):
    value = headers.FILE.default() | {"xsize": 640, "ysize": 480, "orientation": 6}
    blobs = spark.createDataFrame([(1, bytearray(headers.write_header(value))), (2, bytearray(b"none")), (3, None)], "id int, content binary")
    rows = {r["id"]: r["header"] for r in headers.read_headers(blobs).collect()}
    assert rows[2] is None and rows[3] is None and rows[1]["xsize"] == 640 and rows[1]["metadata"]["transcoded"]["color"]["white_point"] == "D65"
    again = headers.write_headers(headers.read_headers(blobs).where("id = 1").select("id", "header"))
    assert headers.read_header(bytes(again.first()["content"])) == value
    ok = headers.read_headers(blobs).where("header is not null").select(headers.valid_size(F.col("header.xsize"), F.col("header.ysize")).alias("ok"))
    assert ok.first()["ok"]
