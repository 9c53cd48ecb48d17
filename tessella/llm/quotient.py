"""Counting quotient filters over n-grams of word ids: lossless counters that merge like sorted lists.

An n-gram of word ids, each of `width` bits, is packed into two halves and permuted by a Feistel network, a
bijection: nothing is lost. The top bits of the permuted value are the *quotient*, the rest is the
*remainder*, kept in full. A filter holds the sorted remainders of each quotient with their counts. As the
permutation spreads n-grams evenly, quotients hold about equally many, whatever n-gram is frequent. Two
filters of one shape merge quotient by quotient: remainders are merged in order and counts of equal ones added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessella.llm.wordhash import mix

ROUNDS = 4


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _join(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    return (high << np.uint64(bits)) | low


class Shape:
    """How n-grams of `order` ids of `width` bits are packed, permuted and cut; ids are less than 2^width."""

    def __init__(self, order: int, width: int, quotient_bits: int):
        self.order, self.width = order, width
        self.right = order // 2 * width
        self.left = order * width - self.right  # at most 64
        self.quotient_bits = min(quotient_bits, self.left)
        self.rest = self.left - self.quotient_bits

    def permute(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Halves of the permuted value of each row of `grams`."""
        cut = self.order - self.order // 2
        left, right = self._packed(grams[:, :cut]), self._packed(grams[:, cut:])
        for k in range(ROUNDS):
            if k % 2:
                right = right ^ (self._round(left, k) & _mask(self.right))
            else:
                left = left ^ (self._round(right, k) & _mask(self.left))
        return left, right

    def restore(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The n-grams of permuted values."""
        for k in reversed(range(ROUNDS)):
            if k % 2:
                right = right ^ (self._round(left, k) & _mask(self.right))
            else:
                left = left ^ (self._round(right, k) & _mask(self.left))
        cut = self.order - self.order // 2
        return np.concatenate((self._unpacked(left, cut), self._unpacked(right, self.order - cut)), axis=1)

    def _packed(self, ids: np.ndarray) -> np.ndarray:
        out = ids[:, 0].astype(np.uint64)
        for k in range(1, ids.shape[1]):
            out = _join(out, ids[:, k].astype(np.uint64), self.width)
        return out

    def _unpacked(self, packed: np.ndarray, n: int) -> np.ndarray:
        return np.stack([(packed >> np.uint64(self.width * (n - 1 - k))) & _mask(self.width) for k in range(n)], axis=1).astype(np.int64)

    def _round(self, half: np.ndarray, k: int) -> np.ndarray:
        return mix(half + np.uint64(0x632BE59BD9B4E019 * (k + 1) % 2**64))

    def counted(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Permuted values in order, each once, with its count: a filter."""
        if not len(left):
            return left, right, np.zeros(0, np.int64)
        if self.left + self.right <= 64 and counts is None:
            values = np.sort(_join(left, right, self.right))
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            values = values[first]
            return values >> np.uint64(self.right), values & _mask(self.right), np.diff(first, append=len(left))
        order = np.argsort(_join(left, right, self.right)) if self.left + self.right <= 64 else np.lexsort((right, left))
        left, right = left[order], right[order]
        first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        totals = np.diff(first, append=len(left)) if counts is None else np.add.reduceat(counts[order], first)
        return left[first], right[first], totals

    def segments(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """(quotient, remainders, counts) of a filter, for each quotient that it has."""
        quotient = (left >> np.uint64(self.rest)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(quotient, prepend=-1, append=-1)).tolist()
        remainders = np.concatenate((self._bytes(left & _mask(self.rest), self.rest), self._bytes(right, self.right)), axis=1)
        for a, b in zip(cuts, cuts[1:]):
            yield int(quotient[a]), remainders[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()

    def merged(self, quotient: int, remainders: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filter of one quotient over all segments of it."""
        a, b = self._size(self.rest), self._size(self.right)
        rows = np.frombuffer(b"".join(remainders), np.uint8).reshape(-1, a + b)
        left = self._number(rows[:, :a]) | np.uint64(quotient << self.rest)
        return self.counted(left, self._number(rows[:, a:]), np.frombuffer(b"".join(counts), "<u4").astype(np.int64))

    @staticmethod
    def _size(bits: int) -> int:
        return (bits + 7) // 8

    def _bytes(self, values: np.ndarray, bits: int) -> np.ndarray:
        return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : self._size(bits)]

    @staticmethod
    def _number(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 8), np.uint8)
        out[:, : rows.shape[1]] = rows
        return out.view("<u8").ravel()
