"""Interval joins as equi-joins on (chrom, bin).

A join on the chromosome alone compares each row with all its intervals, and a join on
ranges alone is a nested loop.  Here intervals are first cut into segments that don't
overlap (each place belongs to the interval that starts first), each segment is listed
under the bins it touches, and a point looks in the one bin it is in.  As segments are
disjoint, a point or a piece has at most one match and no row is ever multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 4096
#: Width of the cells of starts in which intervals are ordered.
CELL = 1 << 20


def disjoint(bed: DataFrame) -> DataFrame:
    """bed (chrom, start, end[, name]) with seg_start, seg_end, and before: the end of the segments so far.

    The latest end so far is found inside cells of starts; the latest end of the cells
    before comes from one row a cell, so no window holds the intervals of a chromosome.
    """
    order = ["start", "end"] + (["name"] if "name" in bed.columns else [])
    rows = bed.where("start < end").withColumn("_cell", F.floor(F.col("start") / CELL))
    earlier = (Window.unboundedPreceding, -1)
    tops = rows.groupBy(F.col("chrom").alias("_c"), F.col("_cell").alias("_k")).agg(F.max("end").alias("_top"))
    carried = tops.select("_c", "_k", F.max("_top").over(Window.partitionBy("_c").orderBy("_k").rowsBetween(*earlier)).alias("_carried"))
    within = F.max("end").over(Window.partitionBy("chrom", "_cell").orderBy(*order).rowsBetween(*earlier))
    out = rows.withColumn("_within", within).join(carried, (F.col("chrom") == F.col("_c")) & (F.col("_cell") == F.col("_k")))
    out = out.withColumn("before", F.greatest("_within", "_carried")).drop("_cell", "_within", "_c", "_k", "_carried")
    return out.withColumn("seg_start", F.greatest("start", F.coalesce("before", "start"))).withColumnRenamed("end", "seg_end").where("seg_start < seg_end").withColumn("end", F.col("seg_end"))


def _binned(segments: DataFrame, width: int) -> DataFrame:
    first, last = F.floor(F.col("seg_start") / width), F.floor((F.col("seg_end") - 1) / width)
    return segments.withColumn("bin", F.explode(F.sequence(first, last)))


def locate(points: DataFrame, segments: DataFrame, chrom: str, pos: Column, prefix: str, *, width: int = BIN, how: str = "left") -> DataFrame:
    """points with the segment that each place is in: columns {prefix}start, {prefix}end, {prefix}name (null: none)."""
    keep = [k for k in ("start", "end", "name") if k in segments.columns]
    side = _binned(segments, width).select(
        F.col("chrom").alias("_chrom"), F.col("bin").alias("_bin"), F.col("seg_start").alias("_s"), F.col("seg_end").alias("_e"), *[F.col(k).alias(prefix + k) for k in keep]
    )
    left = points.withColumn("_pos", pos)
    on = (F.col(chrom) == F.col("_chrom")) & (F.floor(F.col("_pos") / width) == F.col("_bin")) & (F.col("_pos") >= F.col("_s")) & (F.col("_pos") < F.col("_e"))
    return left.join(side, on, how).drop("_chrom", "_bin", "_s", "_e", "_pos")


def inside(points: DataFrame, segments: DataFrame, chrom: str, pos: Column, name: str, *, width: int = BIN) -> DataFrame:
    """points with a boolean column name: is the place in any interval?"""
    out = locate(points, segments.select("chrom", "start", "end", "seg_start", "seg_end"), chrom, pos, "_in_", width=width)
    return out.withColumn(name, F.col("_in_start").isNotNull()).drop("_in_start", "_in_end")


def overlaps(pieces: DataFrame, segments: DataFrame, chrom: str, start: str, end: str, *, width: int = BIN) -> DataFrame:
    """pieces of which [start, end) overlaps any interval.

    A piece is looked up under each bin it touches; only the first segment that it
    overlaps counts, in the first bin they share, so it matches once or not at all.
    """
    side = _binned(segments, width).select(
        F.col("chrom").alias("_chrom"), F.col("bin").alias("_bin"), F.col("seg_start").alias("_s"), F.col("seg_end").alias("_e"), F.coalesce("before", F.lit(-1)).alias("_p")
    )
    lo, hi = F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / width)
    left = pieces.withColumn("_b", F.explode(F.sequence(lo, hi))).withColumn("_lo", lo)
    on = (
        (F.col(chrom) == F.col("_chrom")) & (F.col("_b") == F.col("_bin")) & (F.col("_s") < F.col(end)) & (F.col("_e") > F.col(start)) & (F.col("_p") <= F.col(start))
        & (F.col("_b") == F.greatest(F.col("_lo"), F.floor(F.col("_s") / width)))
    )
    return left.join(side, on).drop("_b", "_lo", "_chrom", "_bin", "_s", "_e", "_p")


def overlap_filter(pieces: DataFrame, segments: DataFrame, chrom: str, start: str, end: str, *, invert: bool = False, width: int = BIN) -> DataFrame:
    """pieces that overlap any interval (or none, if inverted), each once."""
    if not invert:
        return overlaps(pieces, segments, chrom, start, end, width=width)
    # No overlap: the piece starts outside, and no segment starts within it.
    ahead = segments.select("chrom", F.coalesce("before", F.lit(0)).alias("start"), F.col("seg_start").alias("end"), F.lit("gap").alias("kind"))
    tail = segments.groupBy("chrom").agg(F.max("seg_end").alias("start")).withColumn("end", F.lit(1 << 62)).withColumn("kind", F.lit("tail"))
    gaps = ahead.unionByName(tail).where("start < end")
    inner = gaps.where("kind = 'gap'").select("chrom", "start", "end", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))
    last = tail.select(F.col("chrom").alias("_tc"), F.col("start").alias("_tail"))
    found = locate(pieces, inner, chrom, F.col(start), "_g_", width=1 << 20)
    found = found.join(last, F.col(chrom) == F.col("_tc"), "left")
    free = F.col("_tc").isNull() | (F.col(start) >= F.col("_tail")) | (F.col("_g_end").isNotNull() & (F.greatest(F.col(end), F.col(start) + 1) <= F.col("_g_end")))
    return found.where(free).drop("_g_start", "_g_end", "_tc", "_tail")
