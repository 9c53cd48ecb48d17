"""Chunks of PNG files and differences along lines, against plain loops over bytes and cells."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import lines
from tessella.sources import chunks, images


def raw(kind, data, crc=None):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) if crc is None else crc)


def png(color_type, *parts, end=True):
    head = raw(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, color_type, 0, 0, 0))
    return images.PNG_MAGIC + head + b"".join(parts) + (raw(b"IDAT", b"\x78\x9c") + raw(b"IEND", b"") if end else b"")


GRAYS, COLOURS = bytes([0, 0, 0, 9, 9, 9, 255, 255, 255]), bytes([1, 1, 1, 10, 11, 10])
FILES = {
    "gray_palette": (png(3, raw(b"PLTE", GRAYS)), True, False, "Gra_D65_Per_SRG"),
    "colour_palette": (png(3, raw(b"PLTE", COLOURS)), False, False, "RGB_D65_SRG_Per_SRG"),
    "opaque_palette": (png(3, raw(b"PLTE", COLOURS), raw(b"tRNS", b"\xff\xff")), False, False, "RGB_D65_SRG_Per_SRG"),
    "clear_palette": (png(3, raw(b"PLTE", GRAYS), raw(b"tRNS", b"\xff\xfe")), True, True, "Gra_D65_Per_SRG"),
    "key": (png(0, raw(b"tRNS", b"\0\1")), True, True, "Gra_D65_Per_SRG"),
    "linear": (png(2, raw(b"gAMA", struct.pack(">I", 100000))), False, False, "RGB_D65_SRG_Per_Lin"),
    "odd_gamma": (png(6, raw(b"gAMA", struct.pack(">I", 700000))), False, True, "RGB_D65_SRG_Per_SRG"),
    "intent": (png(2, raw(b"gAMA", struct.pack(">I", 100000)), raw(b"sRGB", b"\2")), False, False, "RGB_D65_SRG_Sat_SRG"),
    "pq": (png(2, raw(b"sRGB", b"\2"), raw(b"iCCP", b"ITUR_2100_PQ_FULL\0\0abc")), False, False, "RGB_D65_202_Rel_PeQ"),
    "unnamed": (png(2, raw(b"cHRM", struct.pack(">8I", *range(1000, 9000, 1000)))), False, False, "RGB_?_?_Per_SRG"),
}


def blobs(spark, files):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")


def test_properties_of_files(spark):
    got = chunks.properties(chunks.chunks(blobs(spark, {k: v[0] for k, v in FILES.items()}))).collect()
    assert {r["path"]: (r["gray"], r["alpha"], r["encoding"]) for r in got} == {k: v[1:] for k, v in FILES.items()}
    assert {(r["width"], r["height"], r["depth"]) for r in got} == {(3, 2, 8)}


def test_damaged_files_are_refused(spark):
    good = png(2, raw(b"tEXt", b"Author\0me"))
    files = {"good": good, "crc": png(2, raw(b"gAMA", b"\0\0\0\1", 7)), "short": good[:-5], "no_end": png(2, end=False), "text": b"no image", "empty": b"", "long": images.PNG_MAGIC + struct.pack(">I", 1 << 31) + b"IHDR"}
    found = chunks.chunks(blobs(spark, files))
    bad = {r["path"]: (r["kind"], r["problem"]) for r in chunks.refused(found).collect()}
    assert bad == {"crc": ("gAMA", "checksum differs"), "short": (None, "cut off"), "no_end": (None, "no end"), "text": (None, "not a PNG file"), "empty": (None, "not a PNG file"), "long": (None, "cut off")}
    assert chunks.chunks(blobs(spark, {"good": good}).where("false")).count() == 0


def test_chunks_that_are_written_are_read(spark):
    xy = [0.3127, 0.329, 0.708, 0.292, 0.17, 0.797, 0.131, 0.046]
    added = [chunks.gamma_chunk(F.lit(1.0)), chunks.chunk("zzZz", F.lit(None).cast("binary")), chunks.chromaticity_chunk([F.lit(v) for v in xy]), chunks.text_chunk("Title", F.lit("café")), chunks.text_chunk("Empty", F.lit(""))]
    whole = chunks.add_chunks(blobs(spark, {"x": images.encode_png(np.arange(6.0).reshape(1, 2, 3), 8)}), added)
    found = chunks.chunks(whole)
    assert [(r["kind"], r["intact"]) for r in found.orderBy("seq").collect()] == [(k, True) for k in ("IHDR", "gAMA", "cHRM", "tEXt", "tEXt", "IDAT", "IEND")]
    assert chunks.properties(found).first()["encoding"] == "Gra_D65_Per_Lin"
    assert {(r["keyword"], r["text"]) for r in chunks.texts(found).collect()} == {("Title", "café"), ("Empty", "")}
    content = bytes(whole.first()["content"])
    for r in found.collect():
        assert zlib.crc32(content[r["start"] - 4 : r["start"] + r["length"]]) == r["crc"]
    assert np.array_equal(images.decode_png(content)[0], np.arange(6.0).reshape(1, 2, 3))


def test_sixteen_directions():
    found = lines.directions()
    assert len(found) == 16 and sorted(map(len, found)) == [7] * 6 + [8] * 4 + [9] * 6
    assert all((0, 0) in line and max(abs(v) for cell in line for v in cell) <= 4 for line in found)


@pytest.mark.parametrize("w,h", [(11, 9), (3, 2)])
def test_line_difference_is_a_plain_loop(spark, w, h):
    r = np.random.default_rng(w)
    a, b = r.normal(0, 50, (2, h, w))

    def frame(v):
        return spark.createDataFrame([(0, 0, y, x, float(v[y, x])) for y in range(h) for x in range(w)], "image_id long, c int, y int, x int, v double")

    above, below, norm = 1.3, 0.7, 40.0
    scale = [lines.FACTOR * (share * k) ** 0.5 / 8.5 * norm for share, k in ((0.5, above), (0.33, below))]
    d = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            p, q = a[y, x], b[y, x]
            s = [k / (norm + 0.5 * (abs(p) + abs(q))) for k in scale]
            d[y, x] = s[0] * (p - q)
            if p < 0:
                p, q = -p, -q
            over = 0.55 * p - q if q < 0.55 * p else q - 1.05 * p if q > 1.05 * p else 0
            d[y, x] += s[1] * over * (-1 if a[y, x] - b[y, x] < 0 else 1)
    want = np.zeros((h, w))
    for line in lines.directions():
        for y in range(h):
            for x in range(w):
                want[y, x] += sum(d[y + dy, x + dx] for dx, dy in line if 0 <= y + dy < h and 0 <= x + dx < w) ** 2
    got = lines.line_difference(frame(a), frame(b), w, h, above, below, norm).collect()
    assert len(got) == w * h and all(abs(g["v"] - want[g["y"], g["x"]]) < 1e-9 for g in got)


def test_many_small_files_take_few_tasks_and_are_walked_once(spark, tmp_path):
    from tessella.plans import images as plans

    (spark.range(300).selectExpr("id as vec_id", "transform(sequence(1, 64), k -> cast(sin(id * 64 + k) as float)) as embedding").write.parquet(str(tmp_path / "embeddings.parquet")))
    read = plans._files(spark, str(tmp_path))
    assert read.count() == 300 and read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    texts = plans.QUERIES["png_texts"](spark, str(tmp_path))
    assert "MapInArrow" not in texts._jdf.queryExecution().toString() and texts.count() > 250


def test_encoding_is_that_of_each_image(spark):
    r = np.random.default_rng(3)
    made = {f"{k}.png": r.integers(0, 256, (1 + k % 4, 5, 1 + k % 7)).astype(float) for k in range(40)}
    rows = [(path, 8, c, y, planes[c, y].tolist()) for path, planes in made.items() for c in range(len(planes)) for y in range(5)]
    r.shuffle(rows)
    rows = spark.createDataFrame([(p, int(b), int(c), int(y), [float(v) for v in row]) for p, b, c, y, row in rows], "path string, bits int, c int, y int, row array<double>")
    for size in ("7", "10000"):  # images that go on in the next batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {x["path"]: bytes(x["content"]) for x in images.encode(rows, "png").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {path: images.encode_png(planes, 8) for path, planes in made.items()}
