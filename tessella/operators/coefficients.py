"""Coefficients of blocks as symbols under contexts, and groups of them coded on their own under shared tables.

A block gives one symbol for how many values other than 0 it has, whose context is what the blocks above and to the left let
expect, and one symbol per value, whose context is how many values are left and how far the scan is; every 16 zeros in a row
are an escape. Symbols are made inside the row. Histograms are one aggregate per (context, symbol), contexts
that are alike share a table, and the tables, at most `CONTEXTS` x 256 numbers whatever the input, go to every task.
A group is an image's planes within a bounded rectangle: it is coded and decoded by one call, with no other group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.codes import pack_signed, varlen_bits, varlen_payload
from tessella.functions.lanes import let
from tessella.operators.kernels import BitReader, BitWriter, normalise_counts, read_varint, write_varint
from tessella.operators.tokens import NO_NEIGHBOUR, from_top_and_left, neighbours

# Part of a value's context that its place in the scan of 64 gives, and part that the number of values left gives.
PLACE_CONTEXT = (
    0, 1, 2, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 8, 8, 9, 9, 9, 9, 10, 10, 10, 10, 11, 11, 11, 11, 12, 12, 12, 12,
    13, 13, 13, 13, 13, 13, 13, 13, 14, 14, 14, 14, 14, 14, 14, 14, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15,
)
LEFT_CONTEXT = (
    None, 0, 0, 16, 16, 16, 32, 32, 32, 32, 48, 48, 48, 48, 48, 48, 64, 64, 64, 64, 64, 64, 64, 64, 79, 79, 79, 79, 79, 79, 79, 79,
    79, 79, 79, 79, 79, 79, 79, 79, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93, 93,
)
#: Planes with contexts of their own, contexts of a plane's counts (in pairs) and of its values.
PLANES, COUNT_CONTEXTS, VALUE_CONTEXTS = 3, 32, 105
CONTEXTS = PLANES * (COUNT_CONTEXTS + VALUE_CONTEXTS)
#: Zeros of an escape.
LONGEST_RUN = 16
#: Bits of the tables' shares, and what a table of its own costs.
SHARE_BITS, TABLE_BITS = 12, 120.0


def count_context(expected: Column, plane: Column) -> Column:
    return (PLANES * F.floor(expected / 2) + plane).cast("long")


def value_context(left: Column, place: Column, plane: Column) -> Column:
    """Context of the next value when `left` of them are yet to come, and the last symbol ended at `place`."""
    by_left, by_place = F.array(*[F.lit(x) for x in LEFT_CONTEXT]), F.array(*[F.lit(x) for x in PLACE_CONTEXT])
    return (PLANES * COUNT_CONTEXTS + VALUE_CONTEXTS * plane + F.get(by_left, left) + F.get(by_place, place)).cast("long")


def _value_symbols(values: Column, plane: Column) -> Column:
    """Array of (context, symbol, nbits, bits) of a block's values in scan order, the first one left out."""
    some = F.filter(F.transform(values, lambda v, i: F.struct(i.cast("int").alias("place"), pack_signed(v).alias("packed"))), lambda x: (x["packed"] > 0) & (x["place"] > 0))

    def one(xs: Column, x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(xs, i - 1)["place"], F.lit(0))
        zeros, left, nbits = x["place"] - before - 1, (F.size(xs) - i).cast("int"), varlen_bits(x["packed"]).cast("int")
        escapes = F.floor(zeros / LONGEST_RUN).cast("int")

        def symbol(k: Column) -> Column:
            last = k == escapes
            whole = F.when(last, (zeros % LONGEST_RUN) * 16 + nbits).otherwise((LONGEST_RUN - 1) * 16)
            return F.struct(
                value_context(left, before + LONGEST_RUN * k, plane).alias("context"), whole.cast("long").alias("symbol"),
                F.when(last, nbits).otherwise(0).cast("long").alias("nbits"), F.when(last, varlen_payload(x["packed"])).otherwise(0).cast("long").alias("bits"),
            )

        return F.transform(F.sequence(F.lit(0), escapes), symbol)

    return let(some, lambda xs: F.flatten(F.transform(xs, lambda x, i: one(xs, x, i))))


def block_symbols(blocks: DataFrame, values: str) -> DataFrame:
    """blocks (image_id, c, by, bx, values: 64 whole numbers in scan order) with `symbols`, an array of (context, symbol, nbits, bits).

    The first value of a block is not among them. What is expected of a block looks at the two blocks before it, in two windows
    over a row and a column of one plane's blocks; a missing neighbour is passed over. Planes are numbered from 0 to 2.
    """
    count = F.size(F.filter(F.slice(values, 2, 64), lambda v: v != 0)).cast("long")
    plane = blocks.withColumn("_plane", F.struct("image_id", "c")).withColumn("_count", count)
    near = neighbours(plane, "_count", "_plane").withColumn("_expected", from_top_and_left(F.col("top"), F.col("left"), NO_NEIGHBOUR))
    first = F.struct(count_context(F.col("_expected"), F.col("c")).alias("context"), F.col("_count").alias("symbol"), F.lit(0).cast("long").alias("nbits"), F.lit(0).cast("long").alias("bits"))
    return near.withColumn("symbols", F.concat(F.array(first), _value_symbols(F.col(values), F.col("c").cast("int")))).select(*blocks.columns, "symbols")


def histograms(symbols: DataFrame) -> DataFrame:
    """(context, symbol, n, extra): how often each symbol occurs under each context, and the bits that follow it in all."""
    rows = symbols.select(F.explode("symbols").alias("t"))
    return rows.groupBy("t.context", "t.symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("t.nbits").alias("extra"))


def _merged(counts: np.ndarray, overhead: float) -> list[int]:
    """Cluster of each row: the two that gain most are merged until none gains; the first pair of equals."""
    term = lambda x: np.where(x > 0, x * np.log2(np.maximum(x, 1)), 0.0)
    entropy = lambda h: term(h.sum(-1)) - term(h).sum(-1)
    sums, alone, of = counts.astype(float), entropy(counts.astype(float)), list(range(len(counts)))
    gain = np.full((len(counts), len(counts)), -np.inf)
    for i in range(len(counts) - 1):
        gain[i, i + 1 :] = overhead - (entropy(sums[i] + sums[i + 1 :]) - alone[i] - alone[i + 1 :])
    while len(counts) > 1 and gain.max() > 0:
        i, j = divmod(int(gain.argmax()), len(counts))
        sums[i] += sums[j]
        alone[i] = entropy(sums[i])
        of = [i if k == j else k for k in of]
        gain[j, :] = gain[:, j] = -np.inf
        kept = np.array(sorted(set(of) - {i}), dtype=int)
        fresh = overhead - (entropy(sums[i] + sums[kept]) - alone[i] - alone[kept])
        gain[np.minimum(kept, i), np.maximum(kept, i)] = fresh
    return of


def tables(counts: DataFrame, overhead: float = TABLE_BITS) -> tuple[dict[int, int], dict[int, list[int]]]:
    """The map of contexts and the shares of each shared table.

    The counts are at most CONTEXTS x 256 numbers, whatever they count, so the driver takes them and merges the
    best pair of all at a time; `clusters.merge` is the same for groups without such a bound. overhead is what a table costs.
    """
    rows = counts.select("context", "symbol", "n").collect()  # bounded by CONTEXTS x 256
    contexts = sorted({r["context"] for r in rows})
    whole = np.zeros((len(contexts), 256), dtype=np.int64)
    for r in rows:
        whole[contexts.index(r["context"]), r["symbol"]] = r["n"]
    of = _merged(whole, overhead)
    members = {k: [i for i, x in enumerate(of) if x == k] for k in set(of)}
    return dict(zip(contexts, of)), {k: normalise_counts(whole[m].sum(axis=0).tolist(), SHARE_BITS) for k, m in members.items()}


def _starts(shares: Sequence[int]) -> list[int]:
    out, at = [], 0
    for n in shares:
        out.append(at)
        at += n
    return out


def pack_symbols(symbols: Sequence[tuple[int, int]], shares: dict[int, list[int]]) -> bytes:
    """(table, symbol) in order as one state of an asymmetric numeral system; the last one goes in first."""
    starts = {k: _starts(v) for k, v in shares.items()}
    state, words = 1 << 16, []
    for table, symbol in reversed(symbols):
        n = shares[table][symbol]
        if state >= n << (32 - SHARE_BITS):
            words.append(state & 0xFFFF)
            state >>= 16
        state = (state // n << SHARE_BITS) + state % n + starts[table][symbol]
    return state.to_bytes(4, "little") + b"".join(w.to_bytes(2, "little") for w in reversed(words))


class SymbolReader:
    """Symbols of pack_symbols, each from the table that is asked for."""

    def __init__(self, data: bytes, shares: dict[int, list[int]]):
        self.data, self.at, self.state, self.shares = data, 4, int.from_bytes(data[:4], "little"), shares
        self.starts = {k: _starts(v) for k, v in shares.items()}
        self.symbols = {k: [s for s, n in enumerate(v) for _ in range(n)] for k, v in shares.items()}

    def read(self, table: int) -> int:
        slot = self.state & ((1 << SHARE_BITS) - 1)
        symbol = self.symbols[table][slot]
        self.state = self.shares[table][symbol] * (self.state >> SHARE_BITS) + slot - self.starts[table][symbol]
        if self.state < 1 << 16 and self.at < len(self.data):
            self.state = self.state << 16 | int.from_bytes(self.data[self.at : self.at + 2], "little")
            self.at += 2
        return symbol


def decode_values(reader: SymbolReader, bits: BitReader, expected: int, plane: int, context_map: dict[int, int]) -> list[int]:
    """A block's 64 values in scan order, the first one 0."""
    out = [0] * 64
    left, place = reader.read(context_map[PLANES * (expected // 2) + plane]), 0
    base = PLANES * COUNT_CONTEXTS + VALUE_CONTEXTS * plane
    while left:
        run, nbits = divmod(reader.read(context_map[base + LEFT_CONTEXT[left] + PLACE_CONTEXT[place]]), 16)
        if not nbits:
            place += LONGEST_RUN
            continue
        place += run + 1
        packed = (1 << nbits) + bits.read(nbits) - 1
        out[place] = -(packed + 1) // 2 if packed % 2 else packed // 2
        left -= 1
    return out


def encode_groups(symbols: DataFrame, context_map: dict[int, int], shares: dict[int, list[int]]) -> DataFrame:
    """(image_id, content): each image's blocks of block_symbols, coded on their own. An image is a group of bounded size."""
    import pandas as pd

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["c", "by", "bx"])
        places = b"".join(write_varint(int(x)) for row in pdf[["c", "by", "bx"]].itertuples(index=False) for x in row)
        flat, raw = [], BitWriter()
        for block in pdf["symbols"]:
            for t in block:
                flat.append((context_map[t["context"]], t["symbol"]))
                raw.write(int(t["bits"]), int(t["nbits"]))
        packed = pack_symbols(flat, shares)
        content = write_varint(len(pdf)) + places + write_varint(len(packed)) + packed + raw.bytes()
        return pd.DataFrame({"image_id": [key[0]], "content": [content]})

    return symbols.select("image_id", "c", "by", "bx", "symbols").groupBy("image_id").applyInPandas(one, "image_id long, content binary")


def decode_group(content: bytes, context_map: dict[int, int], shares: dict[int, list[int]]) -> list[tuple[int, int, int, list[int]]]:
    """(c, by, bx, values) of every block of a group."""
    n, at = read_varint(content)
    places = []
    for _ in range(n):
        row = []
        for _ in range(3):
            x, at = read_varint(content, at)
            row.append(x)
        places.append(tuple(row))
    size, at = read_varint(content, at)
    reader, bits = SymbolReader(content[at : at + size], shares), BitReader(content[at + size :])
    out, counts, above, left = [], {}, {}, {}
    for c, by, bx in places:
        # the nearest block before this one in its column and in its row, as the windows of the encoder see them
        top, side = above.get((c, bx)), left.get((c, by))
        known = [counts[p] for p in (top, side) if p is not None]
        expected = (sum(known) + 1) // 2 if len(known) == 2 else known[0] if known else NO_NEIGHBOUR
        values = decode_values(reader, bits, expected, c, context_map)
        counts[c, by, bx] = sum(v != 0 for v in values)
        above[c, bx] = left[c, by] = (c, by, bx)
        out.append((c, by, bx, values))
    return out


def decode_groups(coded: DataFrame, context_map: dict[int, int], shares: dict[int, list[int]]) -> DataFrame:
    """(image_id, c, by, bx, values) of (image_id, content): no shuffle, a group where its bytes are."""
    import pandas as pd

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image, content in zip(pdf["image_id"], pdf["content"]):
                rows = decode_group(bytes(content), context_map, shares)
                yield pd.DataFrame({"image_id": image, "c": [r[0] for r in rows], "by": [r[1] for r in rows], "bx": [r[2] for r in rows], "values": [r[3] for r in rows]})

    return coded.select("image_id", "content").mapInPandas(each, "image_id long, c long, by long, bx long, values array<long>")
