"""Alignment pieces: quality, digest and edge filters, and the classes of concatemer reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import disjoint, inside


def min_mapq(rows: DataFrame, q: int) -> DataFrame:
    return rows.where(F.col("mapq") >= q)


def mark_quality(paf: DataFrame, *, min_length: int = 150, min_identity: float = 0.8) -> DataFrame:
    """identity = matches / aln_length (0 for no length); filter_reason is low_mq for short or unlike pieces, else pass."""
    identity = F.when(F.col("aln_length") > 0, F.col("matches") / F.col("aln_length")).otherwise(0.0)
    out = paf.withColumn("identity", identity)
    bad = ((F.col("query_end") - F.col("query_start")) < min_length) | (F.col("identity") < F.lit(min_identity))
    return out.withColumn("filter_reason", F.when(bad, "low_mq").otherwise("pass"))


def mark_digest(pieces: DataFrame, bed: DataFrame) -> DataFrame:
    """Pieces that pass must end, on both sides, in an interval: [start - 1, start) and [end - 1, end)."""
    segments = disjoint(bed)
    out = inside(pieces, segments, "target", F.col("target_start") - 1, "_in1")
    out = inside(out, segments, "target", F.col("target_end") - 1, "_in2")
    ok = F.col("_in1") & F.col("_in2")
    return out.withColumn("filter_reason", F.when((F.col("filter_reason") == "pass") & ~ok, "low_mq").otherwise(F.col("filter_reason"))).drop("_in1", "_in2")


def mark_edges(pieces: DataFrame, edge: int) -> DataFrame:
    """Pieces nearer than edge to an end of their target become low_mq."""
    near = (F.col("target_start") < edge) | (F.col("target_length") - F.col("target_end") < edge)
    return pieces.withColumn("filter_reason", F.when((F.col("filter_reason") == "pass") & near, "low_mq").otherwise(F.col("filter_reason")))


def classify_reads(pieces: DataFrame, *, read: str = "read_idx", max_order: int = 50) -> DataFrame:
    """Adds status to each piece's read: pass, singleton, low_mq or complex, from its passing pieces."""
    w = Window.partitionBy(read)
    n_pass = F.sum(F.when(F.col("filter_reason") == "pass", 1).otherwise(0)).over(w)
    records = F.count("*").over(w)
    status = (
        F.when(n_pass == 0, F.when(records > 1, "low_mq").otherwise("singleton")).when(n_pass == 1, "singleton").when(n_pass > max_order, "complex").otherwise("pass")
    )
    return pieces.withColumn("status", status)


def passing_pieces(pieces: DataFrame, **options) -> DataFrame:
    """The table that is written: passing pieces of passing reads."""
    return classify_reads(pieces, **options).where("status = 'pass' and filter_reason = 'pass'").drop("status")


def read_summary(pieces: DataFrame, *, read: str = "read_idx", max_order: int = 50) -> DataFrame:
    """Reads of each status, aggregated by read first."""
    n_pass = F.sum(F.when(F.col("filter_reason") == "pass", 1).otherwise(0))
    per = pieces.groupBy(read).agg(n_pass.alias("p"), F.count("*").alias("n"))
    status = F.when(F.col("p") == 0, F.when(F.col("n") > 1, "low_mq").otherwise("singleton")).when(F.col("p") == 1, "singleton").when(F.col("p") > max_order, "complex").otherwise("pass")
    return per.groupBy(status.alias("status")).agg(F.count("*").alias("n_reads"))


def order_histogram(pieces: DataFrame, *, read: str = "read_idx") -> DataFrame:
    """Reads by number of pieces."""
    return pieces.groupBy(read).agg(F.count("*").alias("n_order")).groupBy("n_order").agg(F.count("*").alias("n_reads"))


def merge_tables(tables: list[DataFrame], *, read: str = "read_idx") -> DataFrame:
    """UNION ALL with read ids moved up by the ids of the tables before: offset = sum of (largest id + 1)."""
    tops = None
    for k, t in enumerate(tables):
        top = t.agg(F.lit(k).alias("k"), (F.max(read) + 1).alias("top"))
        tops = top if tops is None else tops.union(top)
    offset = F.coalesce(F.sum("top").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = tops.select("k", offset.alias("offset"))
    out = None
    for k, t in enumerate(tables):
        moved = t.crossJoin(F.broadcast(offsets.where(F.col("k") == k).select("offset"))).withColumn(read, F.col(read) + F.col("offset")).drop("offset")
        out = moved if out is None else out.unionByName(moved)
    return out


def sam_filter(sam: DataFrame, *, q: int = 0) -> DataFrame:
    """Mapped records that are neither secondary, duplicate nor quality-failed; supplementary ones stay."""
    return sam.where(F.col("flag").bitwiseAND(0x4 | 0x100 | 0x200 | 0x400) == 0).where(F.col("mapq") >= q)


def slide_to_raw(sam: DataFrame) -> DataFrame:
    """Windowed read names lose their last _i; windows other than 0 become supplementary."""
    i = F.regexp_extract("name", "_([0-9]+)$", 1)
    return sam.withColumn("flag", F.when((i != "") & (i != "0"), F.col("flag").bitwiseOR(2048)).otherwise(F.col("flag"))).withColumn("name", F.regexp_replace("name", "_[0-9]+$", ""))
