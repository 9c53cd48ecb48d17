"""Image files: whole-file reads, format sniffing, PNM/PFM and PNG, and a lossless blob of planes.

Files are scanned with Spark's binaryFile source, which lists, prunes and splits work by file; decoding is
an Arrow map that yields one row per plane row, so a file's pixels never form one huge row.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.kernels import lossless_decode, lossless_encode

ROWS = "path string, width int, height int, bits int, c int, y int, row array<double>"
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def codec(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ((".png", "png"), (".pgm", "pnm"), (".ppm", "pnm"), (".pfm", "pnm"), (".tsl", "planes")) for x in pair])
    return F.coalesce(F.element_at(names, F.lower(extension(path))), F.lit("unknown"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def files(spark: SparkSession, paths: str | list[str], glob: str | None = None, tasks: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content).

    The source makes a task of some 32 small files; with `tasks`, so many tasks at most read them, one file after another.
    """
    reader = spark.read.format("binaryFile")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)
    return found.coalesce(tasks) if tasks else found


def decode_pnm(data: bytes) -> tuple[np.ndarray, int]:
    """(planes, height, width) and bits: P5/P6 up to 16 bits, big-endian; Pf/PF floats, rows from the bottom."""
    m = re.match(rb"(P5|P6|Pf|PF)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(-?[\d.]+)\s", data)
    if not m:
        raise ValueError("not a PNM image")
    kind, width, height, last = m[1], int(m[2]), int(m[3]), m[4]
    planes = 3 if kind in (b"P6", b"PF") else 1
    if kind in (b"Pf", b"PF"):
        x = np.frombuffer(data, "<f4" if float(last) < 0 else ">f4", width * height * planes, m.end()).reshape(height, width, planes)[::-1]
        return np.moveaxis(x, 2, 0).astype(np.float64), 32
    top = int(last)
    x = np.frombuffer(data, ">u2" if top > 255 else np.uint8, width * height * planes, m.end()).reshape(height, width, planes)
    return np.moveaxis(x, 2, 0).astype(np.float64), top.bit_length()


def encode_pnm(planes: np.ndarray, bits: int) -> bytes:
    n, height, width = planes.shape
    x = np.moveaxis(planes, 0, 2)
    if bits == 32:
        return f"{'PF' if n == 3 else 'Pf'}\n{width} {height}\n-1.0\n".encode() + x[::-1].astype("<f4").tobytes()
    data = np.clip(np.rint(x), 0, (1 << bits) - 1).astype(">u2" if bits > 8 else np.uint8)
    return f"{'P6' if n == 3 else 'P5'}\n{width} {height}\n{(1 << bits) - 1}\n".encode() + data.tobytes()


def _png_chunks(data: bytes):
    at = len(PNG_MAGIC)
    while at + 8 <= len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((height, stride), np.uint8)
    before = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = raw[y * (stride + 1)], bytearray(raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)])
        if kind == 2:
            line = bytearray((np.frombuffer(bytes(line), np.uint8) + before).tobytes())
        elif kind:
            for i in range(stride):
                a, b, c = (line[i - step] if i >= step else 0), int(before[i]), (int(before[i - step]) if i >= step else 0)
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                line[i] = (line[i] + guess) & 255
        out[y] = before = np.frombuffer(bytes(line), np.uint8)
    return out


def decode_png(data: bytes) -> tuple[np.ndarray, int]:
    """Planes and bits of a non-interlaced PNG: 1 to 16 bits, gray or RGB, with alpha; palettes become RGB."""
    if not data.startswith(PNG_MAGIC):
        raise ValueError("not a PNG image")
    body, palette, head = b"", None, None
    for kind, part in _png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
    if head is None or head[6]:
        raise ValueError("no header, or interlaced")
    width, height, depth, color = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    stride, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    lines = _unfilter(zlib.decompress(body), height, stride, step)
    if depth == 16:
        x = lines.view(">u2")
    elif depth == 8:
        x = lines
    else:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        x = (bits @ (1 << np.arange(depth)[::-1]))[:, : width * channels]
    x = x.reshape(height, width, channels).astype(np.float64)
    if color == 3:
        return np.moveaxis(palette[x[:, :, 0].astype(int)], 2, 0).astype(np.float64), 8
    return np.moveaxis(x, 2, 0), depth


def encode_png(planes: np.ndarray, bits: int) -> bytes:
    """8 or 16 bits; any depth but 8 is written as 16."""
    n, height, width = planes.shape
    deep = bits != 8
    x = np.clip(np.rint(np.moveaxis(planes, 0, 2)), 0, 65535 if deep else 255).astype(">u2" if deep else np.uint8).reshape(height, -1)
    raw = b"".join(b"\0" + row.tobytes() for row in x)
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    head = struct.pack(">IIBBBBB", width, height, 16 if deep else 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_any(data: bytes) -> tuple[np.ndarray, int]:
    """PNG first, then PNM, then planes; what is none of them, or below 9 bytes, is an error."""
    if len(data) < 9:
        raise ValueError("too short for an image")
    if data.startswith(PNG_MAGIC):
        return decode_png(data)
    if data[:3] == b"TSL":
        out, at = [], 5
        for _ in range(data[4]):
            (n,) = struct.unpack("<I", data[at : at + 4])
            out.append(lossless_decode(data[at + 4 : at + 4 + n]))
            at += 4 + n
        return np.stack(out).astype(np.float64), data[3]
    return decode_pnm(data)


def encode_planes(planes: np.ndarray, bits: int) -> bytes:
    parts = [lossless_encode(p.astype(np.int64)) for p in planes]
    return b"TSL" + bytes([bits, len(parts)]) + b"".join(struct.pack("<I", len(p)) + p for p in parts)


ENCODERS = {"png": encode_png, "pnm": encode_pnm, "planes": encode_planes}


def decode(blobs: DataFrame) -> DataFrame:
    """One row per plane row of every file (path, content); a file that can't be decoded has a single row with nulls."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    planes, bits = decode_any(bytes(content))
                    n, height, width = planes.shape
                    rows = [(path, width, height, bits, c, y, planes[c, y].tolist()) for c in range(n) for y in range(height)]
                except (ValueError, KeyError, IndexError, struct.error, zlib.error):
                    rows = [(path, None, None, None, None, None, None)]
                types = (pa.string(), *[pa.int32()] * 5, pa.list_(pa.float64()))
                names = [x.split()[0] for x in ROWS.split(", ")]
                for a in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[a : a + 512], strict=True), types, strict=True)], names=names)

    return blobs.select("path", "content").mapInArrow(run, ROWS)


def pixels(rows: DataFrame) -> DataFrame:
    """(path, c, y, x, v) of decoded rows."""
    return rows.where("row is not null").select("path", "c", "y", F.posexplode("row").alias("x", "v"))


def encode(rows: DataFrame, kind: str) -> DataFrame:
    """(path, content) of images given as plane rows. A task goes through its sorted rows and holds one image at a time."""

    def blob(held: list) -> bytes:
        planes = np.stack([np.stack([row for _, _, row in g]) for _, g in itertools.groupby(held, lambda r: r[1])])
        return ENCODERS[kind](planes, held[0][0])

    def run(batches):
        path, held = None, []
        for batch in batches:
            paths, bits, cs = (batch.column(n).to_pylist() for n in ("path", "bits", "c"))
            lines, out = batch.column("row"), []
            values, ends = lines.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) for x in lines)])
            for i in range(batch.num_rows):
                if held and paths[i] != path:
                    out.append((path, blob(held)))
                    held = []
                path = paths[i]
                held.append((bits[i], cs[i], values[ends[i] : ends[i + 1]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), (pa.string(), pa.binary()), strict=True)], names=["path", "content"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([blob(held)], pa.binary())], names=["path", "content"])

    ordered = rows.where("row is not null").select("path", "bits", "c", "y", "row").repartition("path").sortWithinPartitions("path", "c", "y")
    return ordered.mapInArrow(run, "path string, content binary")


def write_files(blobs: DataFrame, folder: str) -> None:
    """One file per row, named by the last part of its path, into a folder that all machines share.

    A file is written under another name and renamed, so a repeated task never leaves half a file.
    """
    import os
    import uuid

    from tessella.storage import local_path

    where = local_path(folder)
    os.makedirs(where, exist_ok=True)

    def save(rows):
        for r in rows:
            to = os.path.join(where, r["path"].rsplit("/", 1)[-1])
            part = f"{to}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(bytes(r["content"]))
            os.replace(part, to)

    blobs.select("path", "content").foreachPartition(save)
