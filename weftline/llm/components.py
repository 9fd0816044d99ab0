"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a join and an aggregation of links; nothing is gathered in one task or
at the driver but two sums.  A node with very many links is a key of a join whose
large partitions can be split, and its minimum is aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool, unspool


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b).  large: each node's larger neighbours go to its smallest; else its smaller ones and itself."""
    if large:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = sides.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    got = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
    return tuple(got)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b) that isn't the smallest of its component."""
    now = spool(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _mark(now)
    # Done when every node has one link, to a node that has none of its own.
    while before[0]:
        after = spool(_star(_star(now, True), False), "links")
        unspool(now)
        now, mark = after, _mark(after)
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
