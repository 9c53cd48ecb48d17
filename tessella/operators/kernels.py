"""Inherently sequential kernels: entropy coding, inverse predictors, greedy clustering, robust modes.

Each works on one bounded group (a block, a tile or a 512 x 512 group) and is applied with `by_group`,
one pandas call per group; nothing here sees a whole table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: Sequence[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(f, schema)


# Robust modes -------------------------------------------------------------------------------------


def half_sample_mode(values: Sequence[float], counts: Sequence[int] | None = None) -> float:
    """Mode of a sample, given as values, or as distinct values and how often each occurs.

    Of all windows of half the sample's ranks the one whose values lie closest is taken, and its half in turn, until
    two are left; the mode is their mean. Of equally narrow windows the lowest is taken. A narrowest window begins
    with the first of a value or ends with the last of one, so a step looks at two windows a distinct value. Definitions
    that look around the centre found so far, and take the median of windows that are nearly as narrow, may end elsewhere.
    """
    v = np.asarray(values, float)
    n = np.ones(len(v), np.int64) if counts is None else np.asarray(counts, np.int64)
    order = np.argsort(v, kind="stable")
    v, upto = v[order], np.cumsum(n[order])
    at = lambda rank: v[np.searchsorted(upto, rank, "right")]
    low, high = 0, int(upto[-1])
    while high - low > 2:
        take = (high - low + 1) // 2
        starts = np.unique(np.clip(np.concatenate((upto - n[order], upto - take)), low, high - take))
        low = int(starts[np.argmin(at(starts + take - 1) - at(starts))])
        high = low + take
    return float((at(low) + at(high - 1)) / 2)


def half_range_mode(counts: Sequence[int]) -> int:
    """Mode of a histogram, as a bin: the half of its range that holds most, and the half of that, down to one bin. Of equal
    halves the lowest is taken."""
    low, upto = 0, np.concatenate(([0], np.cumsum(counts)))
    high = len(counts)
    while high - low > 1:
        take = (high - low + 1) // 2
        inside = upto[low + take : high + 1] - upto[low : high - take + 1]
        low += int(np.argmax(inside))
        high = low + take
    return low


# Permutations and lists ---------------------------------------------------------------------------


def lehmer_encode(order: Sequence[int]) -> list[int]:
    left = sorted(order)
    out = []
    for v in order:
        out.append(left.index(v))
        left.pop(out[-1])
    return out


def lehmer_decode(code: Sequence[int]) -> list[int]:
    left = list(range(len(code)))
    return [left.pop(k) for k in code]


def move_to_front(values: Sequence[int]) -> list[int]:
    table = list(range(max(values, default=-1) + 1))
    out = []
    for v in values:
        at = table.index(v)
        out.append(at)
        table.insert(0, table.pop(at))
    return out


def inverse_move_to_front(codes: Sequence[int]) -> list[int]:
    table = list(range(max(256, max(codes, default=0) + 1)))
    out = []
    for at in codes:
        table.insert(0, table.pop(at))
        out.append(table[0])
    return out


def zero_runs(values: Sequence[int]) -> list[tuple[int, int]]:
    """(value, 1) for what is not zero and (0, length) for runs of zeros."""
    out: list[tuple[int, int]] = []
    for v in values:
        if v == 0 and out and out[-1][0] == 0:
            out[-1] = (0, out[-1][1] + 1)
        else:
            out.append((v, 1))
    return out


def expand_zero_runs(pairs: Sequence[tuple[int, int]]) -> list[int]:
    return [v for v, n in pairs for _ in range(n)]


# Bits ---------------------------------------------------------------------------------------------


class BitWriter:
    """Low bit first."""

    def __init__(self):
        self.value, self.length = 0, 0

    def write(self, bits: int, n: int) -> None:
        self.value |= (bits & ((1 << n) - 1)) << self.length
        self.length += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.length + 7) // 8, "little")


class BitReader:
    """Low bit first; beyond the end all bits are zero."""

    def __init__(self, data: bytes):
        self.value, self.at = int.from_bytes(data, "little"), 0

    def read(self, n: int) -> int:
        out = (self.value >> self.at) & ((1 << n) - 1)
        self.at += n
        return out


def write_u32(out: BitWriter, value: int, widths: Sequence[int]) -> None:
    """A two-bit choice of four widths (a negative width -k-1 stands for the constant k), then the bits."""
    for choice, width in enumerate(widths):
        if value == -width - 1 if width < 0 else value < 1 << width:
            out.write(choice, 2)
            if width > 0:
                out.write(value, width)
            return
    raise ValueError(f"{value} has no width")


def read_u32(data: BitReader, widths: Sequence[int]) -> int:
    width = widths[data.read(2)]
    return -width - 1 if width < 0 else data.read(width)


def write_varint(value: int) -> bytes:
    out = bytearray()
    while True:
        value, low = value >> 7, value & 127
        out.append(low | (128 if value else 0))
        if not value:
            return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, position after it)."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


# Prefix and range codes ---------------------------------------------------------------------------


def huffman_depths(counts: Sequence[int], limit: int = 15) -> list[int]:
    """Code lengths, none above limit: small counts are raised until the tree is flat enough."""
    used = [i for i, n in enumerate(counts) if n]
    depths = [0] * len(counts)
    if len(used) < 2:
        for i in used:
            depths[i] = 1
        return depths
    least = 1
    while True:
        heap = [(max(counts[i], least), k, [i]) for k, i in enumerate(used)]
        heapq.heapify(heap)
        depths, serial = [0] * len(counts), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in (*a[2], *b[2]):
                depths[i] += 1
            heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
            serial += 1
        if max(depths) <= limit:
            return depths
        least *= 2


def canonical_codes(depths: Sequence[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), shorter codes first and equal lengths in order of symbols."""
    out, code, last = {}, 0, 0
    for depth, symbol in sorted((d, s) for s, d in enumerate(depths) if d):
        code <<= depth - last
        out[symbol] = (code, depth)
        code, last = code + 1, depth
    return out


def huffman_encode(values: Sequence[int], depths: Sequence[int]) -> bytes:
    codes, out = canonical_codes(depths), BitWriter()
    for v in values:
        code, n = codes[v]
        for k in reversed(range(n)):
            out.write(code >> k, 1)
    return out.bytes()


def huffman_decode(data: bytes, n: int, depths: Sequence[int]) -> list[int]:
    table = {(length, code): s for s, (code, length) in canonical_codes(depths).items()}
    bits, out = BitReader(data), []
    for _ in range(n):
        code = length = 0
        while (length, code) not in table:
            code, length = code << 1 | bits.read(1), length + 1
        out.append(table[length, code])
    return out


def normalise_counts(counts: Sequence[int], bits: int = 10) -> list[int]:
    """Counts scaled to sum 2^bits, none that was there lost; the largest take the rounding."""
    total, table = sum(counts), 1 << bits
    if not total:
        return [0] * len(counts)
    out = [max(1, round(n * table / total)) if n else 0 for n in counts]
    while (over := sum(out) - table) != 0:
        k = max(range(len(out)), key=lambda i: out[i])
        step = max(-over, 1) if over < 0 else min(over, max(1, out[k] - 1))
        out[k] += step if over < 0 else -step
    return out


class RangeAns:
    """Asymmetric numeral system over normalised counts; symbols go in last first."""

    def __init__(self, counts: Sequence[int], bits: int = 10):
        self.bits, self.counts = bits, normalise_counts(counts, bits)
        self.starts = [0, *np.cumsum(self.counts).tolist()]
        self.symbols = np.repeat(np.arange(len(self.counts)), self.counts)

    def encode(self, values: Sequence[int]) -> bytes:
        state, words = 1 << 16, []
        for v in reversed(values):
            n = self.counts[v]
            if state >= n << (32 - self.bits):
                words.append(state & 0xFFFF)
                state >>= 16
            state = (state // n << self.bits) + state % n + self.starts[v]
        head = state.to_bytes(4, "little")
        return head + b"".join(w.to_bytes(2, "little") for w in reversed(words))

    def decode(self, data: bytes, n: int) -> list[int]:
        state, at, mask, out = int.from_bytes(data[:4], "little"), 4, (1 << self.bits) - 1, []
        for _ in range(n):
            slot = state & mask
            v = int(self.symbols[slot])
            out.append(v)
            state = self.counts[v] * (state >> self.bits) + slot - self.starts[v]
            if state < 1 << 16 and at < len(data):
                state = state << 16 | int.from_bytes(data[at : at + 2], "little")
                at += 2
        return out


def population_cost(counts: Sequence[int]) -> float:
    """Bits of a histogram and of what it codes."""
    n = sum(counts)
    if not n:
        return 7.0
    used = [c for c in counts if c]
    return n * math.log2(n) - sum(c * math.log2(c) for c in used) + 7 + 5 * len(used)


def combine_histograms(histograms: Sequence[Sequence[int]], least_total: int = 160) -> list[int]:
    """Cluster of each histogram: the pair that saves most bits is merged until none saves any; ties go to the
    pair that stands closer together. Little data makes a single cluster. Clusters are numbered as they appear."""
    if sum(map(sum, histograms)) < least_total:
        return [0] * len(histograms)
    members = {i: [i] for i in range(len(histograms))}
    totals = {i: np.asarray(h) for i, h in enumerate(histograms)}
    cost = {i: population_cost(h) for i, h in totals.items()}
    context = lambda n: n * math.log2(n)

    def saving(a: int, b: int) -> float:
        x, y = len(members[a]), len(members[b])
        return population_cost(totals[a] + totals[b]) - cost[a] - cost[b] + 0.5 * (context(x) + context(y) - context(x + y))

    pairs = {(a, b): saving(a, b) for a in members for b in members if a < b}
    while pairs:
        (a, b), gain = min(pairs.items(), key=lambda p: (round(p[1], 9), p[0][1] - p[0][0], p[0]))
        if gain >= 0:
            break
        members[a] += members.pop(b)
        totals[a] = totals[a] + totals.pop(b)
        cost[a] = population_cost(totals[a])
        pairs = {p: g for p, g in pairs.items() if a not in p and b not in p}
        pairs |= {(min(a, k), max(a, k)): saving(min(a, k), max(a, k)) for k in members if k != a}
    owner = {i: c for c, ms in members.items() for i in ms}
    names: dict[int, int] = {}
    return [names.setdefault(owner[i], len(names)) for i in range(len(histograms))]


# Predictors and lossless planes ---------------------------------------------------------------------


def clamped_gradient_plane(plane: np.ndarray) -> np.ndarray:
    """Residuals of the clamped gradient; the border has one neighbour, the origin none."""
    p = plane.astype(np.int64)
    n, w, nw = np.zeros_like(p), np.zeros_like(p), np.zeros_like(p)
    n[1:], w[:, 1:], nw[1:, 1:] = p[:-1], p[:, :-1], p[:-1, :-1]
    low, high = np.minimum(np.minimum(n, w), nw), np.maximum(np.maximum(n, w), nw)
    guess = np.clip(n + w - nw, low, high)
    guess[0], guess[:, 0] = w[0], n[:, 0]
    return p - guess


def restore_plane(residuals: np.ndarray) -> np.ndarray:
    """Inverse of clamped_gradient_plane: each cell needs those before it."""
    out = np.zeros_like(residuals, np.int64)
    for y in range(residuals.shape[0]):
        for x in range(residuals.shape[1]):
            n, w = (out[y - 1, x] if y else 0), (out[y, x - 1] if x else 0)
            nw = out[y - 1, x - 1] if x and y else 0
            guess = w if not y else n if not x else min(max(n + w - nw, min(n, w, nw)), max(n, w, nw))
            out[y, x] = guess + residuals[y, x]
    return out


def pack_bytes(data: bytes) -> bytes:
    """One byte's run, entropy-coded or plain, whatever is shortest; the first byte tells."""
    head = write_varint(len(data))
    if len(data) >= 4 and len(set(data)) == 1:
        return b"\x01" + head + data[:1]
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).tolist() if data else [0] * 256
    if data:
        norm = normalise_counts(counts)
        body = b"".join(write_varint(n) for n in norm) + RangeAns(counts).encode(list(data))
        if len(body) < len(data):
            return b"\x02" + head + body
    return b"\x00" + head + data


def unpack_bytes(packed: bytes) -> bytes:
    n, at = read_varint(packed, 1)
    if packed[0] == 1:
        return packed[at : at + 1] * n
    if packed[0] == 0:
        return packed[at : at + n]
    counts = []
    for _ in range(256):
        c, at = read_varint(packed, at)
        counts.append(c)
    return bytes(RangeAns(counts).decode(packed[at:], n))


def lossless_encode(plane: np.ndarray) -> bytes:
    """A plane of up to 16 bits: size, then the folded residuals' low and high bytes."""
    r = clamped_gradient_plane(plane)
    folded = np.where(r >= 0, 2 * r, -2 * r - 1).astype(np.int64)
    head = write_varint(plane.shape[0]) + write_varint(plane.shape[1])
    parts = [pack_bytes(((folded >> 8 * k) & 255).astype(np.uint8).tobytes()) for k in range(3)]
    return head + b"".join(write_varint(len(p)) + p for p in parts)


def lossless_decode(data: bytes) -> np.ndarray:
    h, at = read_varint(data)
    w, at = read_varint(data, at)
    folded = np.zeros(h * w, np.int64)
    for k in range(3):
        n, at = read_varint(data, at)
        folded |= np.frombuffer(unpack_bytes(data[at : at + n]), np.uint8).astype(np.int64) << 8 * k
        at += n
    r = np.where(folded % 2 == 0, folded // 2, -(folded + 1) // 2).reshape(h, w)
    return restore_plane(r)


def components(active: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """(x0, y0, x1, y1) of the 4-connected parts of a mask whose sides are below `most`."""
    seen, out = np.zeros_like(active, bool), []
    for y, x in zip(*np.nonzero(active), strict=True):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            cy, cx = stack.pop()
            cells.append((cy, cx))
            for ny, nx in ((cy - 1, cx), (cy + 1, cx), (cy, cx - 1), (cy, cx + 1)):
                if 0 <= ny < active.shape[0] and 0 <= nx < active.shape[1] and active[ny, nx] and not seen[ny, nx]:
                    seen[ny, nx] = True
                    stack.append((ny, nx))
        ys, xs = zip(*cells, strict=True)
        if max(ys) - min(ys) + 1 < most and max(xs) - min(xs) + 1 < most:
            out.append((int(min(xs)), int(min(ys)), int(max(xs)) + 1, int(max(ys)) + 1))
    return out


def piecewise_line(values: np.ndarray, pieces: int) -> np.ndarray:
    """Least-squares heights at equally spaced knots of a line through values."""
    n = len(values)
    place = np.arange(n) / max(1, n - 1) * pieces
    at = np.minimum(place.astype(int), pieces - 1)
    m = np.zeros((n, pieces + 1))
    m[np.arange(n), at], m[np.arange(n), at + 1] = 1 - (place - at), place - at
    return np.linalg.lstsq(m, values, rcond=None)[0]


def invert_kernel(kernel: Sequence[float], size: int) -> np.ndarray:
    """Kernel of `size` taps whose convolution with the given one is nearest to a single 1."""
    k = np.asarray(kernel, float)
    m = np.zeros((size + len(k) - 1, size))
    for i in range(size):
        m[i : i + len(k), i] = k
    want = np.zeros(len(m))
    want[len(want) // 2] = 1
    return np.linalg.lstsq(m, want, rcond=None)[0]
