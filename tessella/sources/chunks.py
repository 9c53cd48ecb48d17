"""PNG files as rows of chunks: where each lies, whether it is intact, and what it says of colour, transparency and text.

A file is walked once per task, without decoding pixels: pixel data is checked and measured, not kept. Everything
that is read out of chunks afterwards is column arithmetic over their bytes, so it is planned, pruned and
aggregated like any other column. Chunks are written the same way: length, kind, bytes and checksum of a column are
put together as bytes.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.sources.images import PNG_MAGIC

COLUMNS = "path string, seq int, kind string, start long, length long, crc long, intact boolean, data binary, problem string"
#: Rows, or bytes of files, that are put out together.
ROWS, BYTES = 1 << 12, 1 << 24
#: Chunks whose bytes are not kept in rows.
BULK = (b"IDAT",)
#: Bytes of the magic and the first chunk, after which other chunks may stand.
HEAD_BYTES = 33
# The name by which an embedded profile stands for the PQ curve, and colour types of gray and of transparent images.
PQ_PROFILE, GRAY_TYPES, ALPHA_TYPES, PALETTE_TYPE = "ITUR_2100_PQ_FULL", (0, 4), (4, 6), 3


def walk(content: bytes) -> list[tuple]:
    """(seq, kind, start, length, crc, intact, data, problem) of each chunk; where the file breaks off, a last row says why."""
    if not content.startswith(PNG_MAGIC):
        return [(0, None, 0, len(content), None, False, None, "not a PNG file")]
    rows, at, kind = [], len(PNG_MAGIC), b""
    while at < len(content) and kind != b"IEND":
        if at + 12 > len(content):
            return [*rows, (len(rows), None, at, len(content) - at, None, False, None, "cut off")]
        length, kind = struct.unpack(">I4s", content[at : at + 8])
        if at + 12 + length > len(content):
            return [*rows, (len(rows), kind.decode("latin-1"), at + 8, length, None, False, None, "cut off")]
        data = content[at + 8 : at + 8 + length]
        (crc,) = struct.unpack(">I", content[at + 8 + length : at + 12 + length])
        intact = zlib.crc32(kind + data) == crc
        rows.append((len(rows), kind.decode("latin-1"), at + 8, length, crc, intact, None if kind in BULK else data, None if intact else "checksum differs"))
        at += 12 + length
    return rows if kind == b"IEND" else [*rows, (len(rows), None, at, 0, None, False, None, "no end")]


def chunks(blobs: DataFrame) -> DataFrame:
    """One row per chunk of every file (path, content)."""

    def run(batches):
        parts = COLUMNS.split(", ")
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, kinds[p.split()[1]]) for v, p in zip(zip(*rows, strict=True), parts, strict=True)], names=[p.split()[0] for p in parts])
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                content = content.as_py() or b""
                rows += [(path, *row) for row in walk(content)]
                held += len(content)
                if len(rows) >= ROWS or held >= BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return blobs.select("path", "content").mapInArrow(run, COLUMNS)


def refused(found: DataFrame) -> DataFrame:
    """(path, problem) of files with a chunk that is not intact: the first problem of each."""
    bad = F.min(F.when(~F.col("intact"), F.struct("seq", "kind", "problem")))
    return found.groupBy("path").agg(bad.alias("first")).where("first is not null").select("path", F.col("first.kind").alias("kind"), F.col("first.problem").alias("problem"))


def number(data: Column, at: int, size: int) -> Column:
    """A big-endian unsigned number of up to seven bytes, as a long."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def _first(kind: str, value: Column) -> Column:
    return F.min(F.when(F.col("kind") == kind, value))


def _palette_is_gray(data: Column) -> Column:
    """Whether the three bytes of every entry are equal."""
    return F.regexp_like(F.hex(data), F.lit(r"^(?:([0-9A-F]{2})\1\1)*$"))


def properties(found: DataFrame) -> DataFrame:
    """One row per file: size, depth, whether it is gray or has transparency, and its colour encoding.

    A palette is gray if all its entries are. A file has transparency by its colour type, by a transparent colour, or by
    a palette entry that is not opaque. The encoding comes from, in this order: a profile named for the PQ curve,
    sRGB, gamma and chromaticities; without a gamma between 0 and 1 or chromaticities, those of sRGB count. `encoding` is its
    description (see names.parse_description); unnamed white points and primaries show as `?`. One shuffle, of small chunks only.
    """
    data = F.col("data")
    eight = F.array(*[number(data, 4 * k, 4) / 100000 for k in range(8)])
    name = F.decode(F.unhex(F.regexp_extract(F.hex(data), "^((?:[0-9A-F]{2})*?)00", 1)), "ISO-8859-1")
    opaque = F.col("alphas").isNull() | F.regexp_like(F.hex("alphas"), F.lit("^(FF)*$"))
    facts = found.where(F.col("kind").isin("IHDR", "PLTE", "tRNS", "gAMA", "cHRM", "sRGB", "iCCP")).groupBy("path").agg(
        _first("IHDR", number(data, 0, 4)).alias("width"), _first("IHDR", number(data, 4, 4)).alias("height"), _first("IHDR", number(data, 8, 1)).alias("depth"), _first("IHDR", number(data, 9, 1)).alias("color_type"),
        _first("PLTE", _palette_is_gray(data)).alias("gray_palette"), _first("tRNS", data).alias("alphas"), _first("gAMA", number(data, 0, 4) / 100000).alias("gamma"), _first("cHRM", eight).alias("xy"),
        _first("sRGB", number(data, 0, 1)).alias("intent"), _first("iCCP", name).alias("profile"),
    )
    palette = F.col("color_type") == PALETTE_TYPE
    gray = F.when(palette, F.coalesce("gray_palette", F.lit(True))).otherwise(F.col("color_type").isin(*GRAY_TYPES))
    alpha = F.when(palette, ~opaque).otherwise(F.col("color_type").isin(*ALPHA_TYPES) | F.col("alphas").isNotNull())
    given = lambda i: F.get("xy", F.lit(i))
    white = F.when(F.col("xy").isNull(), "D65").otherwise(names.white_point(given(0), given(1)))
    primaries = F.when(F.col("xy").isNull(), "SRG").otherwise(names.primaries([given(i) for i in range(2, 8)]))
    gamma = F.when((F.col("gamma") > 0) & (F.col("gamma") <= 1), names.text_from_gamma(F.col("gamma"))).otherwise("SRG")
    intent = F.element_at(F.array(*map(F.lit, names.INTENTS)), (F.col("intent") + 1).cast("int"))
    describe = lambda *parts: F.concat_ws("_", F.when(F.col("gray"), "Gra").otherwise("RGB"), parts[0], F.when(~F.col("gray"), parts[1]), *parts[2:])
    encoding = F.when(F.col("profile") == PQ_PROFILE, describe(F.lit("D65"), F.lit("202"), F.lit("Rel"), F.lit("PeQ"))).when(F.col("intent").isNotNull(), describe(F.lit("D65"), F.lit("SRG"), intent, F.lit("SRG")))
    encoding = encoding.otherwise(describe(white, primaries, F.lit("Per"), gamma))
    return facts.withColumn("gray", gray).select("path", "width", "height", "depth", "gray", alpha.alias("alpha"), "gamma", encoding.alias("encoding"))


def texts(found: DataFrame) -> DataFrame:
    """(path, seq, keyword, text) of all plain text chunks."""
    zero = F.instr(F.decode("data", "ISO-8859-1"), "\0")
    whole = F.decode("data", "ISO-8859-1")
    return found.where("kind = 'tEXt' and intact").select("path", "seq", F.substring(whole, F.lit(1), zero - 1).alias("keyword"), F.substring(whole, zero + 1, F.length(whole)).alias("text"))


def _big_endian(value: Column, size: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def chunk(kind: str, data: Column) -> Column:
    """The bytes of a chunk: length, kind, data and checksum; null if data is."""
    named = F.concat(F.lit(kind.encode()), data)
    return F.concat(_big_endian(F.octet_length(data)), named, _big_endian(F.crc32(named)))


def gamma_chunk(gamma: Column) -> Column:
    return chunk("gAMA", _big_endian(F.round(gamma * 100000)))


def chromaticity_chunk(xy: list[Column]) -> Column:
    """White point, red, green and blue, each x and y."""
    return chunk("cHRM", F.concat(*[_big_endian(F.round(v * 100000)) for v in xy]))


def intent_chunk(intent: Column) -> Column:
    """Says that the file is sRGB, with a rendering intent."""
    return chunk("sRGB", _big_endian(intent, 1))


def text_chunk(keyword: str, text: Column) -> Column:
    return chunk("tEXt", F.concat(F.lit(keyword.encode("latin-1") + b"\0"), F.encode(text, "ISO-8859-1")))


def add_chunks(blobs: DataFrame, added: list[Column]) -> DataFrame:
    """blobs (path, content) with chunks after the first one of each file; null ones are left out."""
    none = F.lit(b"")
    extra = [F.coalesce(c, none) for c in added]
    rest = F.substring("content", F.lit(HEAD_BYTES + 1), F.octet_length("content"))
    return blobs.withColumn("content", F.concat(F.substring("content", 1, HEAD_BYTES), *extra, rest))
