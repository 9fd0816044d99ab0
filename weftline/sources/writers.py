"""Writers.  All rows are written by Spark's writers; a header is one more part, put before the rows by its name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import spool, unspool
from .taskfiles import write_pieces

PAIRS = ("read_idx", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "mapq")


def _tsv(df: DataFrame, path: str, *, sep: str = "\t", compression: str = "none", rows_per_file: int = 0) -> None:
    w = df.write.options(sep=sep, quote="", escape="", emptyValue="", compression=compression)
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).csv(path)


def write_pairs(pairs: DataFrame, sizes: DataFrame, path: str, *, compression: str = "none", rows_per_file: int = 0) -> None:
    """path/header (4DN header lines, sizes in order of name) and path/rows; rows_per_file splits by number of rows."""
    lines = sizes.orderBy("contig").select(F.concat_ws(" ", F.lit("#chromsize:"), "contig", F.col("size").cast("string")).alias("value"))
    spark = pairs.sparkSession
    first = spark.createDataFrame([("## pairs format v1.0",), ("#shape: upper triangle",)], "value string")
    last = spark.createDataFrame([("#columns: readID chrom1 pos1 chrom2 pos2 strand1 strand2 mapq",)], "value string")
    first.union(lines).union(last).coalesce(1).write.text(f"{path}/header")
    _tsv(pairs.select(*PAIRS), f"{path}/rows", compression=compression, rows_per_file=rows_per_file)


def write_pqs(pairs: DataFrame, sizes: DataFrame, path: str, *, rows_per_file: int = 1_000_000) -> None:
    """q0 (all), q1 (mapq >= 1), _contigsizes, _metadata_counts, _metadata and _readme."""
    pairs.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/q0")
    written = pairs.sparkSession.read.parquet(f"{path}/q0")
    written.where("mapq >= 1").write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/q1")
    _tsv(sizes.orderBy("contig").select("contig", "size").coalesce(1), f"{path}/_contigsizes")
    _tsv(written.agg(F.count("*").alias("q0"), F.sum((F.col("mapq") >= 1).cast("long")).alias("q1")), f"{path}/_metadata_counts")
    about = {"format": "pqs", "columns": ",".join(PAIRS), "rows_per_file": str(rows_per_file)}
    spark = pairs.sparkSession
    _tsv(spark.createDataFrame(list(about.items()), "key string, value string").coalesce(1), f"{path}/_metadata")
    lines = ["q0: all pairs.  q1: pairs with mapq >= 1.  Both are Parquet with the columns of _metadata.", "_contigsizes: contig and size.  _metadata_counts: rows of q0 and of q1."]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/_readme")


def write_table(df: DataFrame, path: str, **options) -> None:
    """Contacts, depth, prune tables, summaries: tab-separated, no header."""
    _tsv(df, path, **options)


def write_clm(lists: DataFrame, path: str) -> None:
    """Four lines a pair in the order ++, +-, -+, --, each put together from its chunks as they are written; a line is in one file."""
    key = F.concat("contig1", "strand1", F.lit(" "), "contig2", "strand2")
    order = ["contig1", "contig2", F.translate(F.concat("strand1", "strand2"), "+-", "01")]
    head = F.when(F.col("chunk") == 0, F.concat_ws("\t", key, F.col("count").cast("string"), F.lit(""))).otherwise(F.lit(" "))
    # The list's last chunk ends the line.
    last = lists.groupBy("contig1", "contig2", "strand1", "strand2").agg(F.max("chunk").alias("_last"))
    rows = lists.join(last, ["contig1", "contig2", "strand1", "strand2"])
    tail = F.when(F.col("chunk") == F.col("_last"), F.lit("\n")).otherwise(F.lit(""))
    text = F.concat(head, F.array_join(F.col("values").cast("array<string>"), " "), tail)
    write_pieces(rows.repartitionByRange(*order).sortWithinPartitions(*order, "chunk").select(text.alias("value")), path)


def write_mnd(rows: DataFrame, path: str) -> None:
    _tsv(rows, path, sep=" ")


def write_fasta(fasta: DataFrame, path: str) -> None:
    fasta.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)


def write_fastq(reads: DataFrame, path: str, *, rows_per_file: int = 0) -> None:
    w = reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).text(path)


def write_paired_fastq(reads: DataFrame, path: str, *, rows_per_file: int = 0) -> None:
    """path_R1 and path_R2: the mates (seq1, qual1 and seq2, qual2) of name, at the same places of both.

    Rows are ordered once and written; both sides are read from that table, in its splits.
    """
    rows = reads.select("name", "seq1", "qual1", "seq2", "qual2")
    stored = spool(rows.repartitionByRange("name").sortWithinPartitions("name"), "mates")
    for k in ("1", "2"):
        write_fastq(stored.select("name", F.col(f"seq{k}").alias("seq"), F.col(f"qual{k}").alias("qual")), f"{path}_R{k}", rows_per_file=rows_per_file)
    unspool(stored)


def write_by_cluster(df: DataFrame, path: str, column: str = "cluster") -> None:
    """One folder a cluster."""
    df.write.partitionBy(column).options(sep="\t").csv(path)


def write_tours(tours: DataFrame, path: str) -> None:
    """One line a cluster: contigs with their strands in order."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat("contig", "strand").alias("c")))), lambda x: x["c"])
    tours.groupBy("cluster").agg(F.array_join(items, " ").alias("value")).select(F.concat_ws("\t", "cluster", "value").alias("value")).write.text(path)
