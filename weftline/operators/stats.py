"""Statistics of reads and alignment records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_stats(reads: DataFrame, *, length: str = "length", gc: str = "gc") -> DataFrame:
    """num, sum, min, avg, max, q1, q2, q3, n50, gc: one row.

    Reads are counted by length first; the ordered windows hold one row for each length.
    """
    per = reads.groupBy(F.col(length).cast("long").alias("v")).agg(F.count("*").alias("n"), F.sum(gc).alias("gc"))
    up, down, every = Window.orderBy("v"), Window.orderBy(F.desc("v")), Window.partitionBy()
    t = per.select("v", "n", "gc", F.sum("n").over(up).alias("rank"), F.sum(F.col("v") * F.col("n")).over(down).alias("cum"), F.sum("n").over(every).alias("num"), F.sum(F.col("v") * F.col("n")).over(every).alias("total"))
    quart = lambda p: F.min(F.when(F.col("rank") >= F.ceil(F.col("num") * p), F.col("v")))
    return t.agg(
        F.max("num").alias("num"), F.max("total").alias("sum"), F.min("v").alias("min"), F.round(F.max("total") / F.max("num"), 2).alias("avg"), F.max("v").alias("max"), quart(0.25).alias("q1"), quart(0.5).alias("q2"),
        quart(0.75).alias("q3"), F.max(F.when(F.col("cum") >= F.floor(F.col("total") / 2), F.col("v"))).alias("n50"), F.round(100 * F.sum("gc") / F.max("total"), 2).alias("gc_percent"),
    )


def mate_stats(mates: DataFrame) -> DataFrame:
    """mapped1, mapq1, mapped2, mapq2: counts of unmapped, unique, multiple and singleton mate pairs."""
    both = F.col("mapped1") & F.col("mapped2")
    one = F.col("mapped1") != F.col("mapped2")
    unique = both & (F.col("mapq1") > 0) & (F.col("mapq2") > 0)
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return mates.agg(count(~F.col("mapped1") & ~F.col("mapped2")).alias("unmapped"), count(unique).alias("uniq"), count(both & ~unique).alias("multiple"), count(one).alias("singleton"))


def piece_stats(records: DataFrame) -> DataFrame:
    """mapped, mapq: unmapped, unique (mapq >= 1), unique at 2, and multiple (0) records."""
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    m = F.col("mapped")
    return records.agg(count(~m).alias("unmapped"), count(m & (F.col("mapq") >= 1)).alias("uniq"), count(m & (F.col("mapq") >= 2)).alias("uniq_q2"), count(m & (F.col("mapq") == 0)).alias("multiple"))
