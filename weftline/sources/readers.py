"""Readers: every format has a fixed schema, nothing is inferred.  Compressed text is read as Spark reads it.

A gzip file of one member isn't splittable; text_lines() deals its lines out again.  Files
of many members are (gztext).  Numbers that don't
parse: rows of PAF are dropped, Pore-C fields become 0, a missing mapq of pairs is 60.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import gztext

SIZES = "contig string, size long"
POREC = "read_idx long, query_length int, query_start int, query_end int, strand string, target string, target_start long, target_end long, mapq short, identity float, filter_reason string"
PAIRS = "read_idx string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, mapq short"
BEDMETHYL = "chrom string, start long, end long, name string, score int, strand string, t_start long, t_end long, rgb string, coverage int, percent double"
PRUNE = "contig1 string, contig2 string, mz1 long, mz2 long, mz_shared long, similarity double, type int"
ALLELES = "idx1 int, idx2 int, contig1 string, contig2 string, mz1 long, mz2 long, mz_shared long, similarity double, strand int"
ALLELE_STRAND = "idx1 int, idx2 int, contig1 string, contig2 string, length1 long, length2 long, matches int, identity float, strand int"
PAF_COLUMNS = (("query", "string"), ("query_length", "int"), ("query_start", "int"), ("query_end", "int"), ("strand", "string"), ("target", "string"), ("target_length", "long"), ("target_start", "long"), ("target_end", "long"), ("matches", "int"), ("aln_length", "int"), ("mapq", "short"))


def text_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """value: the lines of plain or compressed text; .mgz and .bgz files are cut at their members."""
    out = gztext.read_lines(spark, path) if path.endswith((".mgz", ".bgz")) else spark.read.text(path)
    return out.repartition(partitions) if partitions else out


def _table(spark: SparkSession, path: str, schema: str, *, sep: str = "\t", comment: str | None = "#") -> DataFrame:
    options = {"sep": sep, "mode": "PERMISSIVE"} | ({"comment": comment} if comment else {})
    return spark.read.options(**options).schema(schema).csv(path)


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, SIZES)


def read_paf(spark: SparkSession, path: str, *, secondary: bool = False) -> DataFrame:
    """The 12 columns and tags; secondary alignments (tp:A:S) only if asked for."""
    rows = text_lines(spark, path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    cols = [F.get("f", F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(PAF_COLUMNS)]
    out = rows.select(*cols, F.slice("f", 13, F.greatest(F.lit(0), F.size("f") - 12)).alias("tags")).dropna(subset=[n for n, _ in PAF_COLUMNS])
    return out if secondary else out.where(~F.exists("tags", lambda t: F.startswith(t, F.lit("tp:A:S"))))


def read_porec(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, POREC).na.fill(0, ["query_length", "query_start", "query_end", "target_start", "target_end", "mapq", "identity"])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of 4DN pairs text, of 7 or 8 columns."""
    f = text_lines(spark, path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    kinds = [k.strip().split() for k in PAIRS.split(",")]
    cols = [F.get("f", F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(kinds)]
    return f.select(*cols).withColumn("mapq", F.coalesce("mapq", F.lit(60).cast("short")))


def read_pairs_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Contig sizes of the #chromsize header lines."""
    rows = text_lines(spark, path).where(F.startswith("value", F.lit("#chromsize:"))).select(F.split("value", "\\s+").alias("f"))
    return rows.select(F.get("f", F.lit(1)).alias("contig"), F.get("f", F.lit(2)).try_cast("long").alias("size"))


def read_pqs(spark: SparkSession, path: str, *, min_mapq: int = 0) -> DataFrame:
    """A pairs directory: q1 holds the rows with mapq >= 1, q0 all."""
    rows = spark.read.parquet(f"{path}/{'q1' if min_mapq else 'q0'}")
    rows = rows.select(*[F.col(n).cast(k).alias(n) for n, k in (p.strip().split() for p in PAIRS.split(","))])
    return rows.where(F.col("mapq") >= min_mapq) if min_mapq > 1 else rows


def read_bed3(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "chrom string, start long, end long")


def read_bed4(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "chrom string, start long, end long, name string")


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "chrom string, start long, end long, value double")


def read_bed_cpg(spark: SparkSession, path: str) -> DataFrame:
    return read_bedgraph(spark, path)


def read_bedmethyl(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, BEDMETHYL)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (the whole header line) and seq; records are cut at '>' that starts a line."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    value = F.regexp_replace("value", "^>", "")
    body = F.translate(F.substring_index(F.concat(value, F.lit("\n")), "\n", -1_000_000_000), "\r", "")
    head = F.substring_index(body, "\n", 1)
    return rows.where(F.trim(value) != "").select(head.alias("name"), F.translate(F.substring(body, F.length(head) + F.lit(1), F.length(body)), "\n", "").alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, qual of four-line records, plain or compressed, of any size.

    Files are read by lines in Spark's splits.  Lines are counted by split, which gives each
    split the number of its first line, and four lines with one quarter are a record; a
    record over a split's border is put together like all others.  A header without a name
    has the name "".
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.text(path).select("value", place.alias("split"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    before = Window.partitionBy("split.file").orderBy("split.block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("split", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"))
    numbered = lines.join(offsets, "split").select(F.col("split.file").alias("file"), (F.col("id") - F.col("least") + F.col("lines")).alias("k"), F.regexp_replace("value", "\\r$", "").alias("value"))
    part = lambda k: F.max(F.when(F.col("k") % 4 == k, F.col("value")))
    records = numbered.groupBy("file", F.floor(F.col("k") / 4).alias("record")).agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual"))
    name = F.regexp_extract("head", r"^@(\S*)", 1)
    return records.where("qual is not null").select(name.alias("name"), "seq", "qual")


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "contig1 string, contig2 string, count double")


def read_clm(spark: SparkSession, path: str) -> DataFrame:
    """contig1, strand1, contig2, strand2, count, chunk (0: a line is a row), values; repeated keys stay rows (merge_lists numbers them on)."""
    rows = _table(spark, path, "key string, count long, v string")
    one, two = F.split("key", " ")[0], F.split("key", " ")[1]
    cut = lambda k: (F.substring(k, F.lit(1), F.length(k) - 1), F.substring(k, -1, 1))
    (a, s), (b, t) = cut(one), cut(two)
    return rows.select(a.alias("contig1"), s.alias("strand1"), b.alias("contig2"), t.alias("strand2"), "count", F.lit(0).cast("long").alias("chunk"), F.split(F.trim("v"), " ").cast("array<long>").alias("values"))


def read_split_contacts(spark: SparkSession, path: str, whitelist: DataFrame | None = None) -> DataFrame:
    rows = _table(spark, path, "contig1 string, contig2 string, count double")
    if whitelist is not None:
        for side in ("contig1", "contig2"):
            names = whitelist.select(F.col("contig").alias("_w")).distinct()
            rows = rows.join(names, F.regexp_extract(side, "^(.*)_([^_]*)$", 1) == F.col("_w"), "left_semi")
    return rows


def read_allele_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, ALLELES).withColumn("ordinal", F.col("idx1"))


def read_allele_header(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", " ")
    rows = text_lines(spark, path).where(F.startswith("value", F.lit("#")))
    return rows.select(F.substring(f[0], F.lit(2), F.length(f[0])).alias("contig"), F.get(f, F.lit(1)).try_cast("long").alias("size"), F.get(f, F.lit(2)).try_cast("long").alias("minimizers"), F.get(f, F.lit(3)).try_cast("long").alias("unique_minimizers"))


def read_allele_groups(spark: SparkSession, path: str) -> DataFrame:
    """row (the second column) and members: all from the third on."""
    f = F.split("value", "\t")
    return text_lines(spark, path).where(F.trim("value") != "").select(F.concat_ws(":", f[0], F.get(f, F.lit(1))).alias("row"), F.filter(F.slice(f, 3, F.greatest(F.lit(0), F.size(f) - 2)), lambda x: x != "").alias("members"))


def read_allele_strand(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, ALLELE_STRAND)


def read_count_re(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "contig string, re long, size long")


def read_prune(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, PRUNE)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """cluster, contig: the first word, and each word after the count."""
    f = F.split(F.trim("value"), "\\s+")
    rows = text_lines(spark, path).where(F.trim("value") != "")
    return rows.select(f[0].alias("cluster"), F.explode(F.slice(f, 3, F.greatest(F.lit(0), F.size(f) - 2))).alias("contig"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return text_lines(spark, path).where(F.trim("value") != "").select(F.trim("value").alias("contig"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "contig string, group string")


def read_collapsed(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "contig string, duplicate string")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text: 11 fields, nm, as_score, mm, ml and all tags."""
    f = text_lines(spark, path).where(~F.startswith("value", F.lit("@")) & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    names = (("name", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "short"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string"))
    rows = f.select(*[F.get("f", F.lit(k)).try_cast(kind).alias(n) for k, (n, kind) in enumerate(names)], F.slice("f", 12, F.greatest(F.lit(0), F.size("f") - 11)).alias("tags"))
    first = lambda p: F.when(F.exists("tags", lambda t: F.startswith(t, F.lit(p))), F.get(F.filter("tags", lambda t: F.startswith(t, F.lit(p))), F.lit(0)))
    value = lambda p: F.substring(first(p), len(p) + 1, 1 << 30)
    return rows.select("*", value("NM:i:").try_cast("long").alias("nm"), value("AS:i:").try_cast("long").alias("as_score"), value("MM:Z:").alias("mm"), F.split(value("ML:B:C,"), ",").cast("array<int>").alias("ml"))


def with_modifications(records: DataFrame) -> DataFrame:
    """Rows of BamSource with reverse, mm and ml (array<int>) of their tags, as modified_reads() and methylation_support() take them."""
    ml = F.split(F.regexp_replace(F.col("tags")["ML"], "^[cC],?", ""), ",")
    return records.select("*", (F.col("flag").bitwiseAND(16) != 0).alias("reverse"), F.col("tags")["MM"].alias("mm"), F.filter(ml, lambda x: x != "").cast("array<int>").alias("ml"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    rows = _table(spark, path, "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string")
    return rows.where(F.col("pos").isNotNull())


def read_vcf_region(spark: SparkSession, path: str, index: str, chrom: str, low: int, high: int) -> DataFrame:
    """Variants of block-compressed VCF files that overlap [low, high], read from the members that gztext.build_index() names."""
    f = gztext.region_lines(spark, path, index, chrom, low, high).where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f"))
    names = (("chrom", "string"), ("pos", "long"), ("id", "string"), ("ref", "string"), ("alt", "string"), ("qual", "string"), ("filter", "string"), ("info", "string"))
    rows = f.select(*[F.get("f", F.lit(k)).try_cast(kind).alias(n) for k, (n, kind) in enumerate(names)])
    return rows.where((F.col("chrom") == chrom) & (F.col("pos") <= high) & (F.col("pos") + F.length("ref") - 1 >= low))
