"""Shared helpers: written intermediate tables, size-checked broadcasts, native word arrays."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import new_path, shared_dir, spool, unspool

__all__ = ["SPACES", "ascii_lower", "free_name", "held_filter", "keyed", "new_path", "numbered", "shared_dir", "shingles", "small", "spool", "unspool", "words"]

#: The ASCII white space that separates words.
SPACES = "\t\n\x0b\x0c\r"
#: Files of a table whose names are broadcast; a table of more is copied to get row numbers.
NUMBERED_FILES = 100_000


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of its own for each row, _row, written so that it stays the same."""
    return spool(docs.withColumn("_row", F.monotonically_increasing_id()), name)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with _row, as keyed(), without a copy of the rows.

    docs must be a plain read of Parquet files.  A row's number is made of the number of
    its file and its place in the file, so every scan gives the same.  Where rows have no
    such places, keyed() is used.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return keyed(docs, name)
    files = spool(placed.select("_file").distinct().coalesce(1).withColumn("_number", F.monotonically_increasing_id()), name)
    if files.limit(NUMBERED_FILES + 1).count() > NUMBERED_FILES:
        return keyed(docs, name)
    return placed.join(F.broadcast(files), "_file").withColumn("_row", F.shiftleft("_number", 38) + F.col("_place")).drop("_file", "_place", "_number")


def free_name(wanted: str, columns: list[str]) -> str:
    """wanted, with underscores put before it until no column has that name, in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def held_filter(df: DataFrame, keep: Column) -> DataFrame:
    """The rows of df where keep holds, by a generator instead of a filter.

    A filter would be pushed below the computed columns that it reads, and compute them again.
    """
    mark = free_name("_kept", df.columns)
    return df.select("*", F.explode_outer(F.array(keep)).alias(mark)).where(F.col(mark)).drop(mark)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows; else df as it is, for a shuffled join.

    The check reads max_rows + 1 rows at most.  Give it written or cheap tables.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none.  One character splits: no regular expression."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(plain, " "), lambda w: w != F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(word_array: Column, width: int = 5) -> Column:
    """Distinct word shingles of an array of words, as joined strings; fewer words: the whole as one; none: empty."""
    n = F.size(word_array)
    many = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.array_join(F.slice(word_array, i, width), " "))
    return (
        F.when(n >= width, F.array_distinct(many))
        .when(n > 0, F.array(F.array_join(word_array, " ")))
        .otherwise(F.array().cast("array<string>"))
    )
