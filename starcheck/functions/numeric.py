"""Rounding that agrees with Python's round() on doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even_exact(x: Column, digits: int) -> Column:
    """Round a double to `digits` places by its exact binary value, ties to even.

    bround() decides ties on the shortest decimal form, so 0.2475 (a little below the tie in
    binary) goes up. Here the rounding error of x * 10^digits is recovered by splitting x in two
    halves, which settles every apparent tie.
    """
    scale = F.lit(float(10**digits))
    scaled = x * scale
    spread = x * F.lit(134217729.0)  # 2^27 + 1
    high = spread - (spread - x)
    low = x - high
    error = (high * scale - scaled) + low * scale
    below = F.floor(scaled).cast("double")
    looks_tied = (scaled - below) == 0.5
    return (
        F.when(looks_tied & (error > 0), below + 1.0)
        .when(looks_tied & (error < 0), below)
        .otherwise(F.rint(scaled))
        / scale
    )
