"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime that keeps id * multiplier inside 64 bits for ids below 1e14.
PRIME = 1_000_003


def c(name: str) -> Column:
    return F.col(name)


def div(a: Column, b: Column | int) -> Column:
    """Integer division of non-negative numbers."""
    return F.floor(a / b).cast("long") if isinstance(b, Column) else F.expr("0").cast("long") + F.floor(a / F.lit(b)).cast("long")


def draw(seed: int, *keys: Column) -> Column:
    """A repeatable number in [0, PRIME) from integer keys; the same in any engine and partitioning."""
    out = F.lit(seed).cast("long")
    for k in keys:
        out = F.pmod(out * F.lit(48271) + F.pmod(k.cast("long"), F.lit(PRIME)) * F.lit(69621) + F.lit(12345), F.lit(PRIME))
    return out


def hash_draw(seed: int, *keys: Column) -> Column:
    """A repeatable number in [0, 1) from keys of any type."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def midpoint(a: Column, b: Column) -> Column:
    return F.shiftright(a + b, 1)
