"""Places in a total order without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import spool


def ranked(df: DataFrame, order: Sequence[str | Column], column: str, *, name: str = "ranked") -> DataFrame:
    """df with its rows' places 0, 1, 2 ... in the given order.

    Rows are dealt by ranges of the order, sorted inside their range and written, a file
    for each range.  A place is the number of rows in the files before plus the row's own
    place in its file, which the reader gives.  Only a row for each file is ordered in one
    task, so one value may hold any share of the rows, as long as the order goes on behind
    it.  Rows that tie in the whole order may come in any order among themselves.
    """
    table = spool(df.repartitionByRange(*order).sortWithinPartitions(*order), name)
    path = table._spool_path
    table = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    number = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("long")
    files = table.groupBy("_file").agg(F.count("*").alias("_n")).withColumn("_number", number)
    before = F.sum("_n").over(Window.orderBy("_number", "_file").rowsBetween(Window.unboundedPreceding, -1))
    files = spool(files.select("_file", F.coalesce(before, F.lit(0)).alias("_before")), f"{name}-files")
    out = table.join(F.broadcast(files), "_file").withColumn(column, F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")
    out._spool_path = path
    return out
