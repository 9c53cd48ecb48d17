"""Words of many texts at once, as places in one byte array and 64-bit hashes.

A word's hash is a polynomial in its bytes, taken out of running sums over all texts of a slice, so no
Python object is made for a word. Equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are hashed at once.
SLICE_BYTES = 2 << 20
#: Bytes that part words everywhere: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b" \t\n\x0b\x0c\r"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    data: np.ndarray  #: bytes of all texts, one after another
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: the byte after each word
    doc: np.ndarray  #: number of the text of each word
    hashes: np.ndarray  #: 64-bit hash of each word's bytes

    def texts(self, which: np.ndarray) -> pa.Array:
        """The words at places `which` as an array of strings."""
        sizes = self.ends[which] - self.starts[which]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.data[np.repeat(self.starts[which] - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat)))


def words(texts: pa.Array, seed: int = 0, parting: bytes = WHITE, lower: bool = True) -> Words:
    """Words of all texts: runs of bytes that are not in `parting`. Null texts have none; A-Z count as a-z if lower."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    data = _LOWER[data] if lower else data
    offsets = offsets - first
    table = np.ones(256, bool)
    table[list(parting)] = False
    inside = table[data]
    n = len(data)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = np.unique(offsets)  # no word goes over the end of a text
    first_bytes, last_bytes = edges[edges < n], edges[edges > 0] - 1
    start[first_bytes] |= inside[first_bytes]
    end[last_bytes] |= inside[last_bytes]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    values = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers(_ODD, n), dtype=np.uint64, out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, np.searchsorted(offsets, starts, "right") - 1, hashes)
