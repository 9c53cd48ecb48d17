"""Differences along lines: how much two images differ where the difference goes on in one direction.

An error along an edge is seen more easily than the same amount of noise. The difference of two images, with a
surcharge where the second leaves what the first allows, is summed along short lines in sixteen directions through each
cell; the squares of those sums add up. Every cell's difference is sent once to its tile (tessella/operators/tiles.py), where all
sixteen sums are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import tiles
from tessella.operators.grid import KEY

Line = tuple[tuple[int, int], ...]  # (dx, dy) of the cells on it

# One line of each kind; the others are its mirror images and transposes.
AXIS: Line = ((-4, 0), (-3, 0), (-2, 0), (-1, 0), (0, 0), (1, 0), (2, 0), (3, 0), (4, 0))
DIAGONAL: Line = ((-3, -3), (-2, -2), (-1, -1), (0, 0), (1, 1), (2, 2), (3, 3))
SHALLOW: Line = ((-4, -1), (-3, -1), (-2, -1), (-1, 0), (0, 0), (1, 0), (2, 1), (3, 1), (4, 1))
STEEP: Line = ((-3, -2), (-2, -1), (-1, -1), (0, 0), (1, 1), (2, 1), (3, 2))
STEPS: Line = ((-4, 2), (-3, 2), (-2, 1), (-1, 1), (0, 0), (1, 0), (2, -1), (3, -1))
# What the second image may have of the first's value without surcharge, weights of difference and surcharge,
# a factor, and half of the length that sums are divided by.
LEAST_SHARE, LARGEST_SHARE, WEIGHT, SURCHARGE, FACTOR, HALF_LENGTH = 0.55, 1.05, 0.5, 0.33, 0.371226387683, 3.75


def directions(kinds: Sequence[Line] = (AXIS, DIAGONAL, SHALLOW, STEEP, STEPS)) -> list[Line]:
    """Each kind of line in all directions that mirroring and transposing give, each once."""
    found = []
    for line in kinds:
        for turned in (line, tuple((y, x) for x, y in line)):
            for flipped in (turned, tuple((x, -y) for x, y in turned)):
                if not any(set(flipped) == set(other) for other in found):
                    found.append(flipped)
    return found


def weighed_difference(a: Column, b: Column, above: float, below: float, norm: float) -> Column:
    """a - b relative to their size, with a surcharge where b is outside of 0.55 to 1.05 times a."""
    weight = lambda share, w: FACTOR * (share * w) ** 0.5 / (2 * HALF_LENGTH + 1) * norm / (F.lit(norm) + 0.5 * (F.abs(a) + F.abs(b)))
    size, seen = F.abs(a), F.when(a < 0, -b).otherwise(b)
    outside = F.greatest(LEAST_SHARE * size - seen, seen - LARGEST_SHARE * size, F.lit(0.0))
    return weight(WEIGHT, above) * (a - b) + F.when(a < b, -1).otherwise(1) * weight(SURCHARGE, below) * outside


def weighed_differences(a: np.ndarray, b: np.ndarray, above: float, below: float, norm: float) -> np.ndarray:
    """The same of the values of a block."""
    weight = lambda share, w: FACTOR * (share * w) ** 0.5 / (2 * HALF_LENGTH + 1) * norm / (norm + 0.5 * (np.abs(a) + np.abs(b)))
    size, seen = np.abs(a), np.where(a < 0, -b, b)
    outside = np.maximum(np.maximum(LEAST_SHARE * size - seen, seen - LARGEST_SHARE * size), 0.0)
    return weight(WEIGHT, above) * (a - b) + np.where(a < b, -1, 1) * weight(SURCHARGE, below) * outside


def line_energy(pixels: DataFrame, width: int, height: int, lines: Sequence[Line] | None = None) -> DataFrame:
    """Sum over all lines of the squared sum along the line through each cell; beyond the border there is nothing."""
    lines = directions() if lines is None else lines
    work = lambda given, place: [block_energy(given[0], lines, place)]
    return tiles.over_tiles(pixels, width, height, reach(lines), ["v"], work, ["v"])


def reach(lines: Sequence[Line]) -> tuple[int, int]:
    return tuple(max((abs(cell[k]) for line in lines for cell in line), default=0) for k in range(2))


def block_energy(p: tiles.Planes, lines: Sequence[Line], place: tuple[tiles.Axis, tiles.Axis]) -> tiles.Planes:
    """line_energy of a block of tiles: a cell where any line has one."""
    energy = np.zeros(p.v.shape)
    for line in lines:
        energy += tiles.shifted(p.v, [(dx, dy, 1.0) for dx, dy in line], place, "drop") ** 2
    seen = (tiles.shifted(p.seen, [(dx, dy, 1.0) for dx, dy in sorted({cell for line in lines for cell in line})], place, "drop") > 0).astype(float)
    return tiles.Planes(energy, seen, seen)


def line_difference(a: DataFrame, b: DataFrame, width: int, height: int, above: float, below: float, norm: float) -> DataFrame:
    """(image_id, c, y, x, v): how much b differs from a along lines through each cell. One join of the images, one shuffle to tiles."""
    both = a.join(b.withColumnRenamed("v", "w"), KEY)
    return line_energy(both.select(*KEY, weighed_difference(F.col("v"), F.col("w"), above, below, norm).alias("v")), width, height)
