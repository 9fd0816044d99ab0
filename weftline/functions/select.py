"""The rows of smallest draws, found by the digits of the draws: no ordered window, at any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

#: Draws have BITS bits, of which each pass over the rows looks at DIGIT.
BITS, DIGIT = 60, 16
#: Rows that are ordered in one task.
FEW = 10_000


def wide_draw(seed: int, *keys: Column) -> Column:
    """A repeatable number in [0, 2**60) from keys, the same in any engine: the first 15 hexadecimal digits of the MD5 of seed and keys as text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def share(p: Column | float) -> Column:
    """What draws of a share of p of all rows are below."""
    return p * F.lit(float(1 << BITS)) if isinstance(p, Column) else F.lit(p * float(1 << BITS))


def crossing(draws: DataFrame, goal: float) -> tuple[int, int, int] | None:
    """low, high and the sum of all weights below low, for the draws [low, high) among which running sums reach goal.

    draws: d and a weight x of at least 0.  None: the sum of all is below goal.  Each pass
    is one histogram of at most 2**DIGIT numbers; it ends when the range holds FEW rows or
    one draw.
    """
    low, span, before = 0, 1 << BITS, 0
    while True:
        width = max(1, span >> DIGIT)
        inside = draws.where((F.col("d") >= low) & (F.col("d") < low + span))
        bins = inside.groupBy(F.expr(f"(d - {low}L) div {width}L").alias("k")).agg(F.sum("x").alias("x"), F.count("*").alias("n")).collect()
        for b in sorted(bins, key=lambda b: b["k"]):
            if before + b["x"] >= goal:
                low, span = low + b["k"] * width, width
                break
            before += b["x"]
        else:
            return None
        if b["n"] <= FEW or span == 1:
            return low, low + span, before


def smallest(rows: DataFrame, draw: Column, n: int) -> DataFrame:
    """The n rows of smallest draws (all, if there are fewer), ties in the order of the columns."""
    if n <= 0:
        return rows.limit(0)
    if n <= FEW:
        return rows.orderBy(draw, *rows.columns).limit(n)
    found = crossing(rows.select(draw.alias("d"), F.lit(1).cast("long").alias("x")), n)
    if found is None:
        return rows
    low, high, before = found
    at = rows.where((draw >= low) & (draw < high))
    if high - low == 1 and n - before > FEW:
        # Very many rows of one draw, which rows with the same keys have.
        placed = ranked(at, [*rows.columns, F.monotonically_increasing_id()], "_place_of_draw", name="one-draw")
        rest = placed.where(F.col("_place_of_draw") < n - before).select(*rows.columns)
    else:
        rest = at.orderBy(draw, *rows.columns).limit(n - before)
    return rows.where(draw < low).unionByName(rest)
