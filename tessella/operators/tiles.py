"""Stencils on tiles: the cells of a plane meet in tiles of bounded size, and numpy works on many tiles at once.

A cell is sent once to its own tile, and again to each tile that reads it across an edge; grids of up to a tile's size need
no copies. Spark deals the tiles out and sorts them, so a task sees the cells of one tile behind one another, and
holds no more than a block of tiles. Several passes over the same cells (both axes, all bands) take one shuffle:
what is wrong near a cut edge stays within the reach that the copies cover.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessella.operators.grid import KEY

#: Least edge of a tile, cells of a block of tiles, and rows that are gathered before blocks are formed.
TILE, BLOCK, ROWS = 64, 1 << 19, 1 << 17

FOLDS = {
    "mirror": lambda p, n: np.where(p % (2 * n) < n, p % (2 * n), 2 * n - 1 - p % (2 * n)),
    "mirror_inner": lambda p, n: 0 * p if n == 1 else np.where(p % (2 * n - 2) < n, p % (2 * n - 2), 2 * n - 2 - p % (2 * n - 2)),
    "clamp": lambda p, n: np.clip(p, 0, n - 1),
}


class Axis(NamedTuple):
    """One axis of a tile: where its cells begin and end, with what it reads and without, and the length of the grid."""

    first: int
    last: int
    own_first: int
    own_last: int
    n: int


class Planes(NamedTuple):
    """Values of a block (tile, y, x), where they aren't null, and where there is a cell; the last two may be shared by all tiles."""

    v: np.ndarray
    known: np.ndarray
    seen: np.ndarray


def axis(n: int, reach: int, tile: int) -> Axis:
    edge = max(TILE, 4 * reach)
    first, last = tile * edge, min(n, (tile + 1) * edge)
    return Axis(max(0, first - reach), min(n, last + reach), first, last, n)


def shifted(a: np.ndarray, taps: Sequence[tuple[int, int, float]], place: tuple[Axis, Axis], policy: str) -> np.ndarray:
    """Sum of weight times the cell at (x + dx, y + dy)."""
    out = np.zeros(a.shape)
    _, h, w = a.shape
    if policy == "drop":
        for dx, dy, weight in taps:
            (y0, y1), (x0, x1) = ((max(0, -d), min(n, n - d)) for d, n in ((dy, h), (dx, w)))
            if y0 < y1 and x0 < x1:
                out[:, y0:y1, x0:x1] += weight * a[:, y0 + dy : y1 + dy, x0 + dx : x1 + dx]
        return out
    at = lambda on, d: np.clip(FOLDS[policy](np.arange(on.first, on.last) + d, on.n) - on.first, 0, on.last - on.first - 1)
    for dy in sorted({t[1] for t in taps}):
        row = a if dy == 0 else a[:, at(place[0], dy)]
        for dx, _, weight in (t for t in taps if t[1] == dy):
            out += weight * (row if dx == 0 else row[:, :, at(place[1], dx)])
    return out


def convolved(p: Planes, taps: Sequence[tuple[int, int, float]], place: tuple[Axis, Axis], policy: str, normalise: bool) -> Planes:
    """The stencil on a block: null where no value arrives, a cell where any cell arrives."""
    ones = [(dx, dy, 1.0) for dx, dy, _ in taps]
    seen = shifted(p.seen, ones, place, policy) > 0
    known = seen if p.known is p.seen else shifted(p.known, ones, place, policy) > 0
    total = shifted(p.v, taps, place, policy)
    if normalise:
        weight = shifted(p.seen, taps, place, policy)
        total = np.divide(total, weight, out=np.zeros(total.shape), where=np.broadcast_to(known, total.shape))
    held = seen.astype(float)
    return Planes(total, held if known is seen else known.astype(float), held)


def over_tiles(cells: DataFrame, width: int, height: int, reach: tuple[int, int], values: Sequence[str], work: Callable[[list[Planes], tuple[Axis, Axis]], list[Planes]], names: Sequence[str]) -> DataFrame:
    """(image_id, c, y, x, *names): what `work` makes of each block of tiles.

    cells has image_id, c, y, x and the columns `values`; those outside of width x height are left out. Values of cells that come
    more than once add up. reach is how far `work` looks along x and along y. A row is given for each cell that the first result has.
    """
    reaches = {"y": (height, reach[1]), "x": (width, reach[0])}
    inside = cells.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    sent = inside.select(*KEY, *[F.col(v).cast("double").alias(v) for v in values])
    for name, (n, r) in reaches.items():
        edge = max(TILE, 4 * r)
        at = lambda d, edge=edge, name=name: F.floor((F.col(name) + d) / edge).cast("int")
        last = (n - 1) // edge
        tile = F.explode(F.sequence(F.greatest(at(-r), F.lit(0)), F.least(at(r), F.lit(last)))) if last > 0 else F.lit(0)
        sent = sent.select("*", tile.alias(f"tile_{name}"))
    key = ["tile_y", "tile_x", "image_id", "c"]
    schema = StructType([StructField(n, cells.schema[n].dataType) for n in KEY] + [StructField(n, DoubleType()) for n in names])

    def blocks(table: pa.Table, starts: np.ndarray):
        """Results of whole tiles, which begin at starts."""
        tile_of = np.searchsorted(starts, np.arange(table.num_rows), "right") - 1
        where = [table.column(k).to_numpy()[starts] for k in key[:2]]
        new = np.flatnonzero(np.r_[True, (np.diff(where[0]) != 0) | (np.diff(where[1]) != 0)])
        for a, b in zip(new, [*new[1:], len(starts)], strict=True):
            place = tuple(axis(*reaches[n], int(w[a])) for n, w in zip("yx", where, strict=True))
            h, w = (p.last - p.first for p in place)
            step = max(1, BLOCK // (h * w))
            for low in range(a, b, step):
                high = min(b, low + step)
                rows = slice(starts[low], starts[high] if high < len(starts) else table.num_rows)
                part = table.slice(rows.start, rows.stop - rows.start)
                y, x = (part.column(n).to_numpy() - p.first for n, p in zip("yx", place, strict=True))
                flat, size = ((tile_of[rows] - low) * h + y) * w + x, (high - low) * h * w
                dense = lambda *a, flat=flat, size=size, shape=(high - low, h, w): np.bincount(*a, minlength=size).astype(float).reshape(shape)
                seen = dense(flat)
                if (seen == 1).all():
                    seen = np.ones((1, h, w))
                given = []
                for name in values:
                    column = part.column(name)
                    if column.null_count:
                        full = pc.is_valid(column).to_numpy()
                        v = np.where(full, pc.fill_null(column, 0.0).to_numpy(), 0.0)
                        given.append(Planes(dense(flat, v), dense(flat[full]), seen))
                    else:
                        given.append(Planes(dense(flat, column.to_numpy()), seen, seen))
                made = work(given, place)
                own = tuple(slice(p.own_first - p.first, p.own_last - p.first) for p in place)
                at = np.nonzero(np.broadcast_to(made[0].seen, (high - low, h, w))[:, own[0], own[1]])
                columns = [table.column(k).take(pa.array(starts[low:high][at[0]])).combine_chunks() for k in KEY[:2]]
                columns += [pa.array(i + p.own_first, table.schema.field(k).type) for i, p, k in zip(at[1:], place, KEY[2:], strict=True)]
                for m in made:
                    v, known = (np.broadcast_to(z, (high - low, h, w))[:, own[0], own[1]][at] for z in (m.v, m.known))
                    columns.append(pa.array(v, pa.float64(), mask=known == 0))
                yield from pa.Table.from_arrays(columns, names=[*KEY, *names]).to_batches(1 << 16)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            table, starts = _starts(held, key)
            if len(starts) > 1:  # the last tile may go on
                yield from blocks(table.slice(0, starts[-1]), starts[:-1])
                table = table.slice(starts[-1])
            held, rows = table.to_batches(), table.num_rows if len(starts) > 1 else 0
        if held:
            table, starts = _starts(held, key)
            if table.num_rows:
                yield from blocks(table, starts)

    return sent.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _starts(held: list[pa.RecordBatch], key: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The batches as one table, and the rows where a tile begins."""
    table = pa.Table.from_batches(held).combine_chunks()
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in key:
        codes = table.column(k).combine_chunks()
        codes = pc.fill_null((codes.dictionary_encode() if isinstance(codes, pa.Array) else codes.chunk(0).dictionary_encode()).indices, -1).to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return table, np.flatnonzero(new)
