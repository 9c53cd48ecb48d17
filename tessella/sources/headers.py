"""Self-describing headers: one field list gives a schema, defaults, sizes, a reader and a writer.

A bundle is written as one bit if all of its fields have their defaults. Fields that a later version
appends go into a counted extension: older readers skip it, newer readers of older data see defaults.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.kernels import BitReader, BitWriter


@dataclass(frozen=True)
class U32:
    """One of four widths, chosen by two bits; a negative width -k-1 stands for the constant k."""

    widths: tuple[int, int, int, int] = (-1, 4, 10, 32)
    kind = T.LongType()

    def choice(self, value: int) -> int:
        for i, w in enumerate(self.widths):
            if value == -w - 1 if w < 0 else 0 <= value < 1 << w:
                return i
        raise ValueError(f"{value} is out of range")

    def bits(self, value: int) -> int:
        return 2 + max(0, self.widths[self.choice(value)])

    def write(self, out: BitWriter, value: int) -> None:
        i = self.choice(value)
        out.write(i, 2)
        if self.widths[i] > 0:
            out.write(value, self.widths[i])

    def read(self, data: BitReader) -> int:
        w = self.widths[data.read(2)]
        return -w - 1 if w < 0 else data.read(w)


@dataclass(frozen=True)
class U64:
    """0; 1 to 16; 17 to 272; or groups of eight bits with a bit that tells whether more follow."""

    kind = T.DecimalType(20, 0)

    def bits(self, value: int) -> int:
        out = BitWriter()
        self.write(out, value)
        return out.length

    def write(self, out: BitWriter, value: int) -> None:
        if not 0 <= value < 1 << 64:
            raise ValueError(f"{value} is out of range")
        if value == 0:
            out.write(0, 2)
        elif value <= 16:
            out.write(1, 2), out.write(value - 1, 4)
        elif value <= 272:
            out.write(2, 2), out.write(value - 17, 8)
        else:
            out.write(3, 2), out.write(value, 12)
            rest, shift = value >> 12, 12
            while rest:
                out.write(1, 1)
                width = min(8, 64 - shift)
                out.write(rest, width)
                rest, shift = rest >> width, shift + width
            if shift < 64:
                out.write(0, 1)

    def read(self, data: BitReader) -> int:
        choice = data.read(2)
        if choice < 3:
            return (0, 1 + data.read(4) if choice == 1 else 0, 17 + data.read(8) if choice == 2 else 0)[choice]
        value, shift = data.read(12), 12
        while shift < 64 and data.read(1):
            width = min(8, 64 - shift)
            value |= data.read(width) << shift
            shift += width
        return value


@dataclass(frozen=True)
class Flag:
    kind = T.BooleanType()

    def bits(self, value: bool) -> int:
        return 1

    def write(self, out: BitWriter, value: bool) -> None:
        out.write(int(value), 1)

    def read(self, data: BitReader) -> bool:
        return bool(data.read(1))


@dataclass(frozen=True)
class Names:
    """An enumeration, stored by its code."""

    values: tuple[str, ...]
    kind = T.StringType()

    def bits(self, value: str) -> int:
        return U32().bits(self.values.index(value))

    def write(self, out: BitWriter, value: str) -> None:
        U32().write(out, self.values.index(value))

    def read(self, data: BitReader) -> str:
        return self.values[U32().read(data)]


@dataclass(frozen=True)
class Blob:
    """Nothing, plain bytes or deflated bytes, whichever is shortest, with their length."""

    kind = T.BinaryType()

    def _form(self, value: bytes) -> tuple[int, bytes]:
        packed = zlib.compress(value, 9)
        return (0, b"") if not value else (2, packed) if len(packed) < len(value) else (1, value)

    def bits(self, value: bytes) -> int:
        out = BitWriter()
        self.write(out, value)
        return out.length

    def write(self, out: BitWriter, value: bytes) -> None:
        form, body = self._form(value)
        out.write(form, 2)
        if form:
            U64().write(out, len(body))
            out.write(int.from_bytes(body, "little"), 8 * len(body))

    def read(self, data: BitReader) -> bytes:
        form = data.read(2)
        if not form:
            return b""
        n = U64().read(data)
        body = data.read(8 * n).to_bytes(n, "little")
        return zlib.decompress(body) if form == 2 else body


@dataclass(frozen=True)
class Bundle:
    """Fields (name, coder, default) in order; those from `extended` on belong to the extension."""

    name: str
    fields: tuple[tuple[str, Any, Any], ...]
    extended: int | None = None
    optional: bool = False
    own: tuple = field(default=())

    @property
    def kind(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.ArrayType(c.inner.kind) if isinstance(c, Repeated) else c.kind, True) for n, c, _ in self.fields])

    def default(self) -> dict:
        return {n: c.default() if isinstance(c, Bundle) else d for n, c, d in self.fields}

    def is_default(self, value: dict) -> bool:
        return value == self.default()

    def bits(self, value: dict) -> int:
        out = BitWriter()
        self.write(out, value)
        return out.length

    def write(self, out: BitWriter, value: dict) -> None:
        value = self.default() | value
        out.write(int(self.is_default(value)), 1)
        if self.is_default(value):
            return
        cut = len(self.fields) if self.extended is None else self.extended
        for n, c, _ in self.fields[:cut]:
            c.write(out, value[n])
        more = BitWriter()
        if any(value[n] != self.default()[n] for n, _, _ in self.fields[cut:]):
            for n, c, _ in self.fields[cut:]:
                c.write(more, value[n])
        U64().write(out, more.length)
        out.write(more.value, more.length)

    def read(self, data: BitReader) -> dict:
        value = self.default()
        if data.read(1):
            return value
        cut = len(self.fields) if self.extended is None else self.extended
        for n, c, _ in self.fields[:cut]:
            value[n] = c.read(data)
        length = U64().read(data)
        end = data.at + length
        for n, c, _ in self.fields[cut:]:
            if data.at < end:
                value[n] = c.read(data)
        data.at = end  # what a newer writer appended is skipped
        return value


@dataclass(frozen=True)
class Repeated:
    inner: Any
    kind = None

    def bits(self, value: Sequence) -> int:
        return U32().bits(len(value)) + sum(self.inner.bits(v) for v in value)

    def write(self, out: BitWriter, value: Sequence) -> None:
        U32().write(out, len(value))
        for v in value:
            self.inner.write(out, v)

    def read(self, data: BitReader) -> list:
        return [self.inner.read(data) for _ in range(U32().read(data))]


ENCODING = Bundle("color", (
    ("color_space", Names(("RGB", "Gra", "XYB", "XYZ")), "RGB"),
    ("white_point", Names(("D65", "EER", "DCI")), "D65"),
    ("primaries", Names(("SRG", "202", "DCI")), "SRG"),
    ("transfer_function", Names(("SRG", "Lin", "709", "PeQ", "HLG", "DCI")), "SRG"),
    ("rendering_intent", Names(("Per", "Rel", "Sat", "Abs")), "Rel"),
))
TRANSCODED = Bundle("transcoded", (("bits_per_sample", U32((-9, -17, 5, 32)), 8), ("color", ENCODING, None), ("alpha_bits", U32((-1, -9, -17, 6)), 0)))
METADATA = Bundle("metadata", (("transcoded", TRANSCODED, None), ("target_nits", U32((-101, 8, 16, 32)), 100), ("exif", Blob(), b""), ("iptc", Blob(), b""), ("xmp", Blob(), b"")))
ANIMATION = Bundle("animation", (("loops", U32((-1, 3, 16, 32)), 0), ("ticks_numerator", U32((-101, -1002, 10, 32)), 100), ("ticks_denominator", U32((-2, -1002, 8, 10)), 1)))
FRAME_INFO = Bundle("frame_info", (("duration", U32((-1, -2, 8, 32)), 0), ("timecode", U32((-1, 8, 16, 32)), 0), ("keyframe", Flag(), True)))
FRAME = Bundle("frame", (("info", FRAME_INFO, None), ("encoding", Names(("passes", "progressive", "lossless")), "passes"), ("flags", U32((-1, 4, 8, 32)), 0), ("downsampling", Repeated(U32()), []), ("group_sizes", Repeated(U32((8, 14, 22, 30))), [])))
TILE = Bundle("tile", (("has_ar", Flag(), False),))
GROUP = Bundle("group", (("nonserialized", Flag(), False), ("tiles", Repeated(TILE), [])))
FILE = Bundle("file", (
    ("xsize", U32((9, 13, 18, 30)), 0), ("ysize", U32((9, 13, 18, 30)), 0), ("orientation", U32((-2, 3, 3, 3)), 1), ("metadata", METADATA, None),
    ("has_animation", Flag(), False), ("animation", ANIMATION, None),
))
MAGIC = b"TSLH"


def write_header(value: dict, bundle: Bundle = FILE) -> bytes:
    out = BitWriter()
    bundle.write(out, value)
    return MAGIC + out.bytes()


def read_header(data: bytes, bundle: Bundle = FILE) -> dict:
    if not data.startswith(MAGIC):
        raise ValueError("not a header")
    return bundle.read(BitReader(data[len(MAGIC) :]))


def read_headers(blobs: DataFrame, content: str = "content", bundle: Bundle = FILE) -> DataFrame:
    """blobs with the struct column `header`, null for what is no header."""

    schema = T.StructType([*blobs.schema.fields, T.StructField("header", bundle.kind, True)])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(header=pd.Series([read_header(bytes(b), bundle) if b is not None and bytes(b).startswith(MAGIC) else None for b in pdf[content]], dtype=object, index=pdf.index))

    return blobs.mapInPandas(run, schema)


def write_headers(rows: DataFrame, header: str = "header", bundle: Bundle = FILE) -> DataFrame:
    """rows with the binary column `content` of their header structs."""
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != header], T.StructField("content", T.BinaryType(), True)])

    def run(batches):
        for pdf in batches:
            values = [_plain(v) for v in pdf[header]]
            yield pdf.drop(columns=[header]).assign(content=[write_header(v, bundle) for v in values])

    return rows.mapInPandas(run, schema)


def _plain(v):
    """Row objects and arrays as dicts and lists, decimals as ints."""
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items() if x is not None}
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else v


def valid_size(width: Column, height: Column, most: int = (1 << 30) - 1) -> Column:
    """Not empty, not wider than 2^25 - 1, not more pixels than allowed."""
    return (width > 0) & (height > 0) & (width <= (1 << 25) - 1) & (width.cast("long") * height <= most)


def override(choice: Column, decided: Column) -> Column:
    """A three-way switch: what was chosen, else what was decided."""
    return F.coalesce(choice, decided)
