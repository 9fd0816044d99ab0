"""Contacts and depth over streams of pairs: counts that grow with each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_contacts(pairs: DataFrame, *, q: int = 1) -> DataFrame:
    """Running contacts; write with outputMode complete or update."""
    rows = pairs.where(F.col("mapq") >= q)
    return rows.groupBy(F.least("chrom1", "chrom2").alias("contig1"), F.greatest("chrom1", "chrom2").alias("contig2")).agg(F.count("*").alias("count"))


def stream_depth(pairs: DataFrame, *, binsize: int = 10_000) -> DataFrame:
    ends = pairs.select(F.explode(F.array(F.struct(F.col("chrom1").alias("contig"), F.col("pos1").alias("pos")), F.struct(F.col("chrom2").alias("contig"), F.col("pos2").alias("pos")))).alias("e"))
    return ends.groupBy(F.col("e.contig").alias("contig"), F.floor(F.col("e.pos") / binsize).alias("bin")).agg(F.count("*").alias("depth"))


def stream_windows(events: DataFrame, *, time: str = "ts", key: str = "user_id", value: str = "value", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Windowed counts and sums of an event stream, late rows up to the watermark included."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
