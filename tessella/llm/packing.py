"""Hierarchical multi-length packing of documents into training sequences.

Every document is routed to the smallest context tier that holds what is left of it after its full
longest windows. Each tier is packed in turn, longest first; the gap of a window is filled with the
largest documents of shorter tiers that fit, and the last hole with a cut piece. Sequences are dealt
to step groups so that groups hold nearly equal numbers of tokens.

Packing needs no shuffle: a task packs the documents it reads, in pools of a bounded number of
tokens, and leaves at most one short sequence. A retried task reads the same rows and makes the same
sequences. Sequence ids carry the task's number, so they are unique over the whole table.

Null texts count as empty; an empty document is its end token alone. Repeated rows are packed as
often as they occur, a null doc_id is carried through, an empty table gives no pieces, and other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.wordids import by_bytes, word_encoder

TIERS = (512, 1024, 2048, 4096)
#: Tokens that are pooled before sequences are made.
POOL_TOKENS = 6_000_000
#: Full windows to a step group.
STEP_WINDOWS = 16
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"


class TierPacker:
    """Documents in, finished sequences out; a sequence is (tier, [(document, start, length), ...])."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.longest = sorted(tiers), max(tiers)
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}

    def _route(self, piece: tuple[int, int, int]) -> None:
        self.pools[next(t for t in self.tiers if t >= piece[2])].append(piece)

    def add(self, document: int, tokens: int) -> Iterator[tuple[int, list]]:
        whole = tokens - tokens % self.longest
        for start in range(0, whole, self.longest):
            yield self.longest, [(document, start, self.longest)]
        if tokens > whole:
            self._route((document, whole, tokens - whole))

    def _filler(self, gap: int, tier: int) -> tuple[int, int, int] | None:
        """The largest waiting piece that fits, of this tier or a shorter one; else the front of a longer piece."""
        for t in reversed([t for t in self.tiers if t <= tier]):
            pool = self.pools[t]
            if pool and pool[-1][2] <= gap:  # pools are sorted with the smallest piece last
                at = len(pool) - 1
                lo, hi = 0, at
                while lo < hi:  # the first, so the largest, that fits
                    mid = (lo + hi) // 2
                    lo, hi = (lo, mid) if pool[mid][2] <= gap else (mid + 1, hi)
                return pool.pop(lo)
        for t in self.tiers:
            if self.pools[t]:
                document, start, length = self.pools[t].pop()
                self.pools[t].append((document, start + gap, length - gap))
                rest = self.pools[t].pop()
                home = self.pools[next(x for x in self.tiers if x >= rest[2])]
                at = next((i for i in range(len(home) - 1, -1, -1) if home[i][2] >= rest[2]), -1)
                home.insert(at + 1, rest)
                return document, start, gap
        return None

    def drain(self, final: bool) -> Iterator[tuple[int, list]]:
        for pool in self.pools.values():
            pool.sort(key=lambda p: (-p[2], p[0], p[1]))
        for tier in reversed(self.tiers):
            pool = self.pools[tier]
            while pool:
                first = pool.pop(0)
                pieces, gap = [first], tier - first[2]
                while gap and (piece := self._filler(gap, tier)):
                    pieces.append(piece)
                    gap -= piece[2]
                if not gap:
                    yield tier, pieces
                elif final:
                    used = tier - gap
                    yield next(t for t in self.tiers if t >= used), pieces
                else:  # waits for the next documents
                    for piece in pieces:
                        self._route(piece)
                    return


def step_groups(tiers: list[int], first: int, tokens_each: int) -> list[int]:
    """The group of each sequence: longest first, always to the group with the fewest tokens."""
    n = max(1, -(-sum(tiers) // tokens_each))
    heap = [(0, g) for g in range(n)]
    heapify(heap)
    groups = [0] * len(tiers)
    for i in sorted(range(len(tiers)), key=lambda i: (-tiers[i], i)):
        load, g = heap[0]
        groups[i] = first + g
        heapreplace(heap, (load + tiers[i], g))
    return groups


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_windows: int = STEP_WINDOWS, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece of a document: where it stands in which sequence, and its ids (32-bit, little-endian).

    A sequence of `tier` tokens needs no padding; the short last sequence of a task has the smallest
    tier that holds it.
    """

    def run(batches):
        encoder, packer = word_encoder(tokenizer_path), TierPacker(tiers)
        base = TaskContext.get().partitionId() << 40
        made, groups_made, waiting = 0, 0, 0
        kept: dict[int, tuple] = {}  # document -> (doc_id, ids, tokens not yet in a sequence)
        number = 0

        def rows(sequences):
            nonlocal made, groups_made, waiting
            sequences = list(sequences)
            if not sequences:
                return
            groups = step_groups([t for t, _ in sequences], base + groups_made, step_windows * max(tiers))
            groups_made = max(groups) - base + 1
            out = {name: [] for name in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids")}
            for (tier, pieces), group in zip(sequences, groups, strict=True):
                offset = 0
                for document, start, length in pieces:
                    doc_id, ids, left = kept[document]
                    row = (doc_id, start, length, len(ids), base + made, offset, tier, group, ids[start : start + length].astype("<u4").tobytes())
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                    offset += length
                    if left == length:
                        del kept[document]
                    else:
                        kept[document] = (doc_id, ids, left - length)
                    waiting -= length
                made += 1
            types = (pa.int64(),) * 6 + (pa.int32(), pa.int64(), pa.binary())
            for a in range(0, len(out["doc_id"]), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(v[a : a + 2048], t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

        for batch in batches:
            for part in by_bytes(batch, "text"):
                flat, counts = encoder.encode(part.column("text"))
                full, at = [], 0
                for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    ids = np.append(flat[at : at + n], np.array(end_id, flat.dtype))
                    at += n
                    kept[number] = (doc_id, ids, len(ids))
                    waiting += len(ids)
                    full += packer.add(number, len(ids))
                    number += 1
                yield from rows(full)
                if waiting >= pool_tokens:
                    yield from rows(packer.drain(final=False))
        yield from rows(packer.drain(final=True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
