import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import borders, codes, lanes
from tessella.operators import blocks, grid, histogram, kernels, linalg, metrics, predict, stats, stencil
from tessella.sources import images
from tessella.storage import new_folder


def plane(df, width, height, c=0):
    out = np.zeros((height, width))
    for r in df.where(F.col("c") == c).collect():
        out[r["y"], r["x"]] = r["v"]
    return out


@pytest.fixture(scope="module")
def small(spark):
    return grid.generate(spark, 7, 5, 2, ((F.col("x") * 31 + F.col("y") * 17 + F.col("c") * 7) % 256).cast("double"))


def test_generate_and_crop(small):
    assert small.count() == 70
    assert plane(small, 7, 5)[2, 3] == (3 * 31 + 2 * 17) % 256
    assert grid.crop(small, grid.Rect(5, 3, 10, 10).inside(7, 5)).count() == 2 * 2 * 2
    assert grid.Rect(2, 2, 4, 4).sub(grid.Rect(1, 1, 9, 9)) == grid.Rect(3, 3, 3, 3)


@pytest.mark.parametrize("policy,numpy_mode", [("mirror", "symmetric"), ("mirror_inner", "reflect"), ("clamp", "edge")])
def test_stencil_against_padding(small, policy, numpy_mode):
    taps = stencil.symmetric(2, [[5, 3, 1], [3, 2, 0.5], [1, 0.5, 0.25]])
    padded = np.pad(plane(small, 7, 5), 2, mode=numpy_mode)
    want = sum(w * padded[2 + dy : 7 + dy, 2 + dx : 9 + dx] for dx, dy, w in taps)
    got = plane(stencil.convolve(small, 7, 5, taps, policy), 7, 5)
    assert np.allclose(got, want)


def test_kernels_keep_their_sums(spark):
    flat = grid.generate(spark, 9, 9, 1, F.lit(77.0))
    for kernel in (stencil.GAUSSIAN5_SIGMA1, stencil.LOWPASS5):
        got = plane(stencil.separable(flat, 9, 9, kernel, kernel), 9, 9)
        assert np.allclose(got, 77 * sum(kernel) ** 2)
    assert np.allclose(plane(stencil.convolve(flat, 9, 9, stencil.LAPLACIAN3), 9, 9), 0)
    assert np.allclose(plane(stencil.smooth(flat, 9, 9), 9, 9), 77)
    assert np.allclose(plane(stencil.blur(flat, 9, 9, 1.5), 9, 9), 77)


def test_stencil_does_not_depend_on_partitions(small):
    one = stencil.convolve(small.repartition(1), 7, 5, stencil.LOWPASS3)
    many = stencil.convolve(small.repartition(7), 7, 5, stencil.LOWPASS3)
    assert np.allclose(plane(one, 7, 5), plane(many, 7, 5))


def test_upsample_of_a_flat_grid_is_flat(spark):
    flat = grid.generate(spark, 6, 4, 1, F.lit(5.0))
    for kernel, reach in ((stencil.catmull_rom, 2), (stencil.lanczos3, 3)):
        got = plane(stencil.upsample(flat, 6, 4, 2, kernel, reach), 12, 8)
        assert np.allclose(got, 5)


def test_same_and_different_grids(small):
    assert grid.differences(small, small).isEmpty()
    other = small.withColumn("v", F.col("v") + F.when((F.col("x") == 1) & (F.col("y") == 1), 1).otherwise(0))
    assert grid.differences(small, other).count() == 2
    assert grid.same_size(small, other.where("x < 6")).first()["same"] is False


def test_border_policies(spark):
    at = spark.range(-9, 14).select(F.col("id").cast("int").alias("x"))
    for name, mode in (("mirror", "symmetric"), ("mirror_inner", "reflect"), ("clamp", "edge")):
        want = np.pad(np.arange(5), 9, mode=mode).tolist()
        got = [r[0] for r in at.orderBy("x").select(borders.POLICIES[name](F.col("x"), 5)).collect()]
        assert got == want


def test_codes_round_trip(spark):
    x = F.col("id")
    rows = spark.range(0, 5000, 7).select(
        x, codes.unpack_signed(codes.pack_signed(x - 2500)).alias("s"), codes.varlen_decode(codes.varlen_bits(x), codes.varlen_payload(x)).alias("v"),
        codes.hybrid_decode(codes.hybrid_token(x + 1), codes.hybrid_payload(x + 1)).alias("h"), codes.varint(x).alias("b"), codes.load_be(codes.store_be32(x), 0, 4).alias("e"),
    )
    for r in rows.collect():
        assert (r["s"], r["v"], r["h"], r["e"]) == (r["id"] - 2500, r["id"], r["id"] + 1, r["id"])
        assert bytes.fromhex(r["b"]) == kernels.write_varint(r["id"])


def test_varint_of_four_and_more_bytes(spark):
    """Each byte holds seven bits and says whether another follows, however long the number is; varint_bytes' SQL stops at three bytes."""
    want = [(1 << (7 * k)) + d for k in range(1, 9) for d in (-1, 0, 1)]
    x = F.col("x")
    for r in spark.createDataFrame([(v,) for v in want], "x long").select(x, codes.varint_bytes(x).alias("n"), codes.varint(x).alias("b")).collect():
        data = bytes.fromhex(r["b"])
        assert data == kernels.write_varint(r["x"]) and len(data) == r["n"] and kernels.read_varint(data) == (r["x"], len(data))


def test_lanes(spark):
    row = spark.range(1).select(
        lanes.add_wrap(F.lit(2**31 - 1), F.lit(1), 32).alias("w"), lanes.add_saturated(F.lit(30000), F.lit(10000), 16).alias("s"), lanes.shift_left(F.lit(1), F.lit(40), 32).alias("z"), lanes.median5(*map(F.lit, (5, 1, 4, 2, 3))).alias("m"),
        lanes.interleave(F.array(F.lit(1), F.lit(3)), F.array(F.lit(2), F.lit(4))).alias("i"),
    ).first()
    assert (row["w"], row["s"], row["z"], row["m"], row["i"]) == (-(2**31), 32767, 0, 3, [1, 2, 3, 4])


def test_dct_inverts_and_keeps_energy(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=64).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, b array<double>").withColumn("d", blocks.dct2d(F.col("b"))).withColumn("back", blocks.idct2d(F.col("d")))
    for row in df.collect():
        assert np.allclose(row["back"], row["b"]) and np.isclose(np.dot(row["d"], row["d"]), np.dot(row["b"], row["b"]))
    order = blocks.zigzag(8)
    assert order[:6] == [0, 1, 8, 16, 9, 2] and sorted(order) == list(range(64))


def test_blocks_and_pixels_round_trip(spark):
    g = grid.generate(spark, 16, 8, 1, (F.col("x") + F.col("y")).cast("double"))
    assert np.allclose(plane(blocks.pixels_of(blocks.blocks_of(g)), 16, 8), plane(g, 16, 8))


def test_moments_do_not_depend_on_how_partials_merge(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(int(k % 3), int(k % 7), float(x)) for k, x in enumerate(r.normal(5, 4, 2000))], "g int, p int, v double")
    whole = {x["g"]: x for x in stats.moments(df, "v", ["g"]).collect()}
    merged = {x["g"]: x for x in stats.merge_power_sums(stats.power_sums(df, "v", ["g", "p"]), ["g"]).collect()}
    for g, m in merged.items():
        mean = m["s1"] / m["n"]
        assert abs(mean - whole[g]["mean"]) < 1e-9 and abs(m["s2"] / m["n"] - mean**2 - whole[g]["var_pop"]) < 1e-8
    single = stats.moments(spark.createDataFrame([(1, 2.0)], "g int, v double"), "v", ["g"]).first()
    assert (single["variance"], single["skewness"], single["kurtosis"]) == (0, 0, 0)


def test_runs_and_reindex(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbbac")], "g int, i int, v string")
    got = [(r["value"], r["start"], r["n"]) for r in histogram.runs(df, ["g"], ["i"], "v").orderBy("run").collect()]
    assert got == [("a", 1, 2), ("b", 3, 3), ("a", 6, 1), ("c", 7, 1)]
    assert {r["v"]: r["code"] for r in histogram.reindex(df, "v", "i").collect()} == {"a": 0, "b": 1, "c": 2}


def test_matrices():
    r = np.random.default_rng(3)
    a = r.normal(size=(6, 6))
    s = a @ a.T + 6 * np.eye(6)
    assert np.allclose(linalg.conjugate_gradient(s, s @ np.arange(6.0)), np.arange(6))
    t, u = linalg.tridiagonal(s)
    assert np.allclose(u @ t @ u.T, s) and np.allclose(np.triu(t, 2), 0, atol=1e-9)
    q, x = linalg.qr(a)
    assert np.allclose(q @ x, a) and (np.diag(x) >= 0).all()
    c, v = linalg.givens(3.0, 4.0)
    assert np.allclose((c * 3 - v * 4, v * 3 + c * 4), (5, 0))
    low = linalg.minimise(lambda z: float(((z - 3) ** 2).sum()), lambda z: 2 * (z - 3), np.zeros(4))
    assert np.allclose(low, 3, atol=1e-5)


def test_robust_modes():
    r = np.random.default_rng(4)
    values = np.concatenate((r.normal(10, 0.5, 900), r.uniform(0, 60, 300)))
    assert abs(kernels.half_sample_mode(values) - 10) < 1
    assert abs(kernels.half_range_mode(np.bincount(r.poisson(40, 15000), minlength=101).tolist()) - 40) <= 4


def test_entropy_codes_round_trip():
    r = np.random.default_rng(5)
    for size, top in ((0, 2), (1, 3), (500, 256), (300, 1), (2000, 5)):
        values = r.integers(0, top, size).tolist()
        counts = np.bincount(values, minlength=256).tolist() if values else [0] * 256
        depths = kernels.huffman_depths(counts)
        assert kernels.huffman_decode(kernels.huffman_encode(values, depths), size, depths) == values
        if values:
            ans = kernels.RangeAns(counts)
            assert ans.decode(ans.encode(values), size) == values
        assert kernels.unpack_bytes(kernels.pack_bytes(bytes(values))) == bytes(values)
        assert kernels.expand_zero_runs(kernels.zero_runs(values)) == values
        assert kernels.inverse_move_to_front(kernels.move_to_front(values)) == values
    assert max(kernels.huffman_depths([2**k for k in range(30)], 12)) <= 12
    order = r.permutation(64).tolist()
    assert kernels.lehmer_decode(kernels.lehmer_encode(order)) == order
    out = kernels.BitWriter()
    for v in (0, 5, 300, 70000):
        kernels.write_u32(out, v, (-1, 4, 10, 20))
    data = kernels.BitReader(out.bytes())
    assert [kernels.read_u32(data, (-1, 4, 10, 20)) for _ in range(4)] == [0, 5, 300, 70000]


def test_lossless_planes_and_predictors(spark):
    r = np.random.default_rng(6)
    for top in (2, 256, 65536):
        p = r.integers(0, top, (13, 9))
        assert (kernels.restore_plane(kernels.clamped_gradient_plane(p)) == p).all()
        assert (kernels.lossless_decode(kernels.lossless_encode(p)) == p).all()
    g = grid.generate(spark, 6, 5, 1, ((F.col("x") * 7 + F.col("y") * 5) % 16).cast("double"))
    assert np.allclose(plane(predict.gradient_residual(g), 6, 5), kernels.clamped_gradient_plane(plane(g, 6, 5).astype(int)))


def test_clusters_and_components():
    a, b = [400, 10, 0, 5], [3, 5, 500, 90]
    assert kernels.combine_histograms([a, b, a, b]) == [0, 1, 0, 1]
    assert kernels.combine_histograms([[1, 0], [0, 1]]) == [0, 0]
    mask = np.zeros((8, 9), bool)
    mask[1:3, 1:4], mask[6, 7] = True, True
    assert kernels.components(mask, 8) == [(1, 1, 4, 3), (7, 6, 8, 7)]


@pytest.mark.parametrize("kind,bits,planes", [("png", 8, 3), ("png", 16, 1), ("pnm", 8, 1), ("pnm", 16, 3), ("pnm", 32, 3), ("planes", 16, 3)])
def test_image_codecs(kind, bits, planes):
    x = np.random.default_rng(7).integers(0, 1 << min(bits, 16), (planes, 5, 7)).astype(float)
    back, depth = images.decode_any(images.ENCODERS[kind](x, bits))
    assert (back == x).all() and depth == bits


def test_image_files(spark):
    x = np.arange(35.0).reshape(1, 5, 7)
    folder = new_folder(spark, "images")
    blobs = spark.createDataFrame([("a.pgm", bytearray(images.encode_pnm(x, 8))), ("b.png", bytearray(images.encode_png(x, 8))), ("c.png", bytearray(b"no image at all"))], "path string, content binary")
    images.write_files(blobs, folder)
    rows = images.decode(images.files(spark, folder))
    assert rows.where("row is null").count() == 1
    assert images.pixels(rows).where("v = y * 7 + x").count() == 70
    names = rows.select(images.base_name(F.col("path")).alias("n"), images.codec(F.col("path")).alias("c")).distinct().collect()
    assert {(r["n"], r["c"]) for r in names} == {("a.pgm", "pnm"), ("b.png", "png"), ("c.png", "png")}


def test_fuzzy_class_inverts():
    for value in (0.3, 0.827108297066, 1.5):
        at = metrics.fuzzy_inverse(value)
        near = (2 / (1 + np.exp((at - 1) * metrics.CLASS_DOWN)) - 1) * (2 - metrics.CLASS_LEVEL) + metrics.CLASS_LEVEL
        far = 2 / (1 + np.exp((at - 1) * metrics.CLASS_UP)) * metrics.CLASS_LEVEL
        assert abs((near if at < 1 else far) - value) < 1e-6


def test_opsin_yuv_of_gray_equals_sql(spark, tmp_path):
    """Every gray lies on the edge between two values of u: 24 x 16 x 3 cells of one gray are an image."""
    import duckdb

    from tessella.plans import codec

    levels = spark.range(256 * 18).selectExpr("id as vec_id", "array_repeat(cast((id div 18 + 0.5) / 1000 as float), 64) as embedding")
    levels.write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        expected = sorted(set(con.execute(f"SELECT DISTINCT image_id, luma, u, v FROM ({codec.SQL['rgb_to_opsin_yuv']})").fetchall()))
    found = codec.QUERIES["rgb_to_opsin_yuv"](spark, str(tmp_path)).select("image_id", "luma", "u", "v").distinct().collect()
    assert sorted(tuple(r) for r in found) == expected and len(expected) == 256


@pytest.mark.parametrize("policy", ["mirror", "mirror_inner", "clamp", "drop"])
def test_stencils_across_tiles(spark, policy):
    """A grid of several tiles along both axes, by a plain loop; one tile has a null and a gap."""
    from tessella.operators import tiles

    w, h, seed = 2 * tiles.TILE + 3, tiles.TILE + 1, np.random.default_rng(5)
    taps = [(-3, 0, 0.5), (0, 2, -1.0), (1, -1, 2.0), (0, 0, 1.0), (3, 1, 0.25)]
    image = seed.integers(0, 256, (h, w)).astype(float)
    rows = [(0, 0, y, x, None if (y, x) == (3, 4) else float(image[y, x])) for y in range(h) for x in range(w) if (y, x) != (20, tiles.TILE)]
    pixels = spark.createDataFrame(rows, "image_id long, c int, y int, x int, v double")
    fold = {"mirror": lambda p, n: p if 0 <= p < n else -1 - p if p < 0 else 2 * n - 1 - p, "mirror_inner": lambda p, n: p if 0 <= p < n else -p if p < 0 else 2 * n - 2 - p, "clamp": lambda p, n: min(max(p, 0), n - 1), "drop": lambda p, n: p if 0 <= p < n else None}[policy]
    held, expected = {(y, x): v for _, _, y, x, v in rows}, {}
    for y in range(h):
        for x in range(w):
            reads = [((fold(y + dy, h), fold(x + dx, w)), k) for dx, dy, k in taps]
            reads = [(held[at], k) for at, k in reads if at in held]
            expected[y, x] = sum(k * v for v, k in reads if v is not None) / sum(k for _, k in reads)
    out = stencil.convolve(pixels, w, h, taps, policy, normalise=True).collect()
    assert len(out) == len(expected) and all(abs(r["v"] - expected[r["y"], r["x"]]) < 1e-9 for r in out)


def test_a_stencil_sends_each_pixel_once(spark):
    plan = stencil.sharpen(spark.range(24 * 16).selectExpr("0L as image_id", "0 as c", "int(id div 24) as y", "int(id % 24) as x", "double(id) as v"), 24, 16)._jdf.queryExecution().toString()
    assert "Generate" not in plan and plan.count("RepartitionByExpression") >= 1
