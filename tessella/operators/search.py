"""Closed-loop choice of a quantisation step for every block: quantise, decode, measure, adjust, until nothing changes.

The state is one row per block: its coefficients and the levels between which the answer lies. A round works inside the
row and is written to the shared folder, so a lost executor costs one round's task and the plan does not grow with the
number of rounds. Steps are powers of two to a quarter of the level, so every round halves what is left: levels
2^k need k rounds, whatever the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.blocks import dct2d, idct2d
from tessella.storage import materialize

LEVELS, LEAST_STEP = 64, 0.001


def step(level: Column, least: float = LEAST_STEP) -> Column:
    return F.lit(least) * F.pow(F.lit(2.0), level / 4)


def quantised(coefficients: Column, size: Column) -> Column:
    """Coefficients as decoding gives them back: whole multiples of the step."""
    return F.transform(coefficients, lambda c: size * F.floor(c / size + 0.5))


def decoded_error(block: Column, coefficients: Column, size: Column, n: int = 8) -> Column:
    """Largest absolute error of a block whose coefficients were quantised."""
    return F.array_max(F.zip_with(block, idct2d(quantised(coefficients, size), n), lambda a, b: F.abs(a - b)))


def largest_step(rows: DataFrame, block: str, target: float, levels: int = LEVELS, least: float = LEAST_STEP) -> DataFrame:
    """rows with the level, step and error that the search ends with, and `rounds`, how many it took.

    The search halves the span of levels by whether the decoded error of the middle is within target. It ends with an
    error within target, or with level 0 where no visited step was fine enough. No rows give no rows.
    """
    names = rows.columns
    state = rows.withColumn("_coefficients", dct2d(F.col(block))).withColumn("_low", F.lit(0)).withColumn("_high", F.lit(levels))
    state, rounds = materialize(state, "search"), 0
    while state.where("_high - _low > 1").limit(1).count():
        rounds += 1
        tried = state.withColumn("_middle", F.floor((F.col("_low") + F.col("_high")) / 2).cast("int"))
        tried = tried.withColumn("_fine", decoded_error(F.col(block), F.col("_coefficients"), step(F.col("_middle"), least)) <= target)
        open_ = F.col("_high") - F.col("_low") > 1
        low = F.when(open_ & F.col("_fine"), F.col("_middle")).otherwise(F.col("_low"))
        high = F.when(open_ & ~F.col("_fine"), F.col("_middle")).otherwise(F.col("_high"))
        state = materialize(tried.select(*names, "_coefficients", low.alias("_low"), high.alias("_high")), "search")
    size = step(F.col("_low"), least)
    return state.select(*names, F.col("_low").alias("level"), size.alias("step"), decoded_error(F.col(block), F.col("_coefficients"), size).alias("error"), F.lit(rounds).alias("rounds"))
