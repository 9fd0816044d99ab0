"""Queries of readers and writers: a table is written in its format to the shared folder, read back, and compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import new_path
from ..operators import contacts as C
from ..operators import clm as L
from ..operators import pairs as R
from ..operators import pieces as P
from ..sources import bam as B
from ..sources import fasta as T
from ..sources import gztext as Z
from ..sources import readers as I
from ..sources import writers as W
from . import roles
from .queries import _FRAG, _KEPT, _ORIENT, _QUAL, _SAM, _STATUS, PAIR, _clm, _marked, _sam, query
from .roles import sql


def _text(df, s, *columns: str, sep: str = "\t") -> str:
    """path of df, written with these columns as separated text."""
    path = new_path(s, "format")
    W.write_table(df.selectExpr(*columns) if columns else df, path, sep=sep)
    return path


def _lines(df, s, expression: str) -> str:
    path = new_path(s, "format")
    df.selectExpr(f"{expression} AS value").write.text(path)
    return path


@query("SRC1_gzip_text", sql("SELECT concat(name, ' ', coalesce(seq, '')) AS value FROM fasta", "fasta"))
def _(s, d):
    path = new_path(s, "format")
    roles.fasta(s, d).selectExpr("concat(name, ' ', coalesce(seq, '')) AS value").write.option("compression", "gzip").text(path)
    return I.text_lines(s, path, 8)


@query("SRC1_block_text", sql("SELECT concat(name, ' ', coalesce(seq, '')) AS value FROM fasta", "fasta"))
def _(s, d):
    path = new_path(s, "format")
    Z.write_lines(roles.fasta(s, d).selectExpr("concat(name, ' ', coalesce(seq, '')) AS value"), path)
    return Z.read_lines(s, path, split_bytes=1 << 19)


@query("SRC2_sizes", sql("SELECT contig, size FROM sizes", "sizes"))
def _(s, d):
    return I.read_sizes(s, _text(roles.sizes(s, d), s))


_PAF = "SELECT concat('r', read_idx) AS query, query_start, query_end, strand, target, target_length, target_start, target_end, matches, aln_length, mapq FROM paf WHERE {w}"


def _paf_file(s, d):
    return _text(
        roles.paf(s, d), s, "concat('r', read_idx)", "query_end", "query_start", "query_end", "strand", "target", "target_length", "target_start", "target_end", "matches", "aln_length", "mapq",
        "CASE WHEN ordinal % 3 = 0 THEN 'tp:A:S' ELSE 'tp:A:P' END", "'NM:i:1'",
    )


for _name, _second in (("SRC3_paf", False), ("SRC3_paf_secondary", True)):

    @query(_name, sql(_PAF.format(w="true" if _second else "ordinal % 3 <> 0"), "paf"))
    def _(s, d, second=_second):
        return I.read_paf(s, _paf_file(s, d), secondary=second).drop("query_length", "tags")


@query("SRC4_porec", sql("SELECT read_idx, query_start, query_end, strand, target, target_start, target_end, mapq, 'pass' AS filter_reason FROM paf", "paf"))
def _(s, d):
    path = _text(roles.paf(s, d), s, "read_idx", "query_end", "query_start", "query_end", "strand", "target", "target_start", "target_end", "mapq", "0.5", "'pass'")
    return I.read_porec(s, path).drop("query_length", "identity")


_AS_TEXT = sql(f"SELECT {PAIR.replace('read_idx', 'read_idx::VARCHAR AS read_idx')} FROM pairs", "pairs")


@query("SRC5_pairs", _AS_TEXT)
def _(s, d):
    return I.read_pairs(s, _text(roles.pairs(s, d), s, *PAIR.split(", ")))


def _pairs_dir(s, d):
    path = new_path(s, "format")
    W.write_pairs(roles.pairs(s, d), roles.sizes(s, d), path, compression="gzip")
    return path


@query("SNK2_pairs_rows", _AS_TEXT)
def _(s, d):
    return I.read_pairs(s, _pairs_dir(s, d) + "/rows")


@query("SNK2_pairs_header", sql("SELECT contig, size FROM sizes", "sizes"))
def _(s, d):
    return I.read_pairs_sizes(s, _pairs_dir(s, d) + "/header")


def _pqs_dir(s, d):
    path = new_path(s, "format")
    W.write_pqs(R.canonical(roles.pairs(s, d)).withColumn("mapq", F.col("mapq") % 7), roles.sizes(s, d), path)
    return path


for _least in (0, 1, 3):

    @query(f"SRC6_pqs_q{_least}", sql(f"SELECT read_idx::VARCHAR AS read_idx, chrom1, pos1, chrom2, pos2, strand1, strand2, mapq % 7 AS mapq FROM pairs WHERE mapq % 7 >= {_least}", "pairs"))
    def _(s, d, least=_least):
        return I.read_pqs(s, _pqs_dir(s, d), min_mapq=least)


@query("SNK3_pqs_counts", sql("SELECT count(*) AS q0, count(*) FILTER (mapq % 7 >= 1) AS q1 FROM pairs", "pairs"))
def _(s, d):
    return s.read.schema("q0 long, q1 long").csv(_pqs_dir(s, d) + "/_metadata_counts", sep="\t")


@query("SRC7_bed3", sql("SELECT chrom, s AS start, e AS \"end\" FROM bed", "bed"))
def _(s, d):
    return I.read_bed3(s, _text(roles.bed(s, d), s, "chrom", "start", "end", "name"))


@query("SRC7_bed4", sql("SELECT chrom, s AS start, e AS \"end\", name FROM bed", "bed"))
def _(s, d):
    return I.read_bed4(s, _text(roles.bed(s, d), s, "chrom", "start", "end", "name"))


@query("SRC7_bedgraph", sql("SELECT chrom, s AS start, e AS \"end\", (s % 8)::DOUBLE / 8 AS value FROM bed", "bed"))
def _(s, d):
    return I.read_bedgraph(s, _text(roles.bed(s, d), s, "chrom", "start", "end", "CAST(start % 8 AS DOUBLE) / 8"))


@query("SRC7_bedmethyl", sql("SELECT chrom, s AS start, e AS \"end\", CAST(s % 9 AS INT) AS coverage, (s % 4)::DOUBLE / 4 AS percent FROM bed", "bed"))
def _(s, d):
    path = _text(roles.bed(s, d), s, "chrom", "start", "end", "'m'", "1", "'+'", "start", "end", "'0,0,0'", "start % 9", "CAST(start % 4 AS DOUBLE) / 4")
    return I.read_bedmethyl(s, path).select("chrom", "start", "end", "coverage", "percent")


@query("SRC8_fasta", sql("SELECT name, coalesce(seq, '') AS seq FROM fasta", "fasta"))
def _(s, d):
    path = new_path(s, "format")
    W.write_fasta(roles.fasta(s, d).withColumn("seq", F.coalesce("seq", F.lit(""))), path)
    return I.read_fasta(s, path)


@query("SRC8_fasta_tiles", sql("SELECT name, t AS tile, t * 300 AS start, substr(s, t * 300 + 1, 310) AS seq FROM (SELECT name, coalesce(seq, '') AS s, unnest(range(greatest(1, (length(coalesce(seq, '')) + 299) // 300))) AS t FROM fasta)", "fasta"))
def _(s, d):
    path = new_path(s, "format")
    W.write_fasta(roles.fasta(s, d).withColumn("seq", F.coalesce("seq", F.lit(""))), path)
    return T.read_tiles(s, path, tile=300, right=10, split_bytes=5000)


@query("SRC8_fastq", sql("SELECT name, seq, translate(seq, 'ACGT', '!+5?') AS qual FROM fasta WHERE seq IS NOT NULL", "fasta"))
def _(s, d):
    path = new_path(s, "format")
    W.write_fastq(roles.fastq(s, d).where("seq IS NOT NULL"), path)
    return I.read_fastq(s, path)


@query("SNK9_paired_fastq", sql("SELECT name, seq AS seq1, reverse(seq) AS seq2 FROM fasta WHERE seq IS NOT NULL", "fasta"))
def _(s, d):
    path = new_path(s, "format")
    W.write_paired_fastq(roles.fastq(s, d).where("seq IS NOT NULL").selectExpr("name", "seq AS seq1", "qual AS qual1", "reverse(seq) AS seq2", "reverse(qual) AS qual2"), path)
    one, two = I.read_fastq(s, path + "_R1"), I.read_fastq(s, path + "_R2")
    return one.selectExpr("name", "seq AS seq1").join(two.selectExpr("name", "seq AS seq2"), "name")


@query("SRC9_sam", sql("SELECT name, flag, rname, pos, mapq, cigar, CAST(nm AS BIGINT) AS nm, as_score, concat('C+m,', nm, ';') AS mm, [CAST(nm AS INT), 7] AS ml FROM sam", also=_SAM))
def _(s, d):
    path = _text(
        _sam(s, d), s, "name", "flag", "rname", "pos", "mapq", "cigar", "'*'", "0", "0", "'*'", "'*'", "concat('NM:i:', nm)", "concat('AS:i:', as_score)", "concat('MM:Z:C+m,', nm, ';')", "concat('ML:B:C,', nm, ',7')"
    )
    return I.read_sam(s, path).select("name", "flag", "rname", "pos", "mapq", "cigar", "nm", "as_score", "mm", "ml")


_BAM = """reads AS (SELECT name, CAST(CASE WHEN length(s) % 3 = 0 THEN 16 ELSE 0 END AS INT) AS flag, concat('ctg', length(s) % 5 + 1) AS rname, CAST(substr(name, 2) AS BIGINT) * 10 + 1 AS pos, CAST(length(s) % 61 AS INT) AS mapq,
 CASE WHEN s = '' THEN '*' ELSE concat(length(s), 'M') END AS cigar, CASE WHEN s = '' THEN '*' ELSE s END AS seq, CASE WHEN s = '' THEN '*' ELSE translate(s, 'ACGT', '!+5?') END AS qual FROM (SELECT name, coalesce(seq, '') AS s FROM fasta))"""
_BAM_ROW = "name, flag, rname, pos, mapq, cigar, seq, qual"


def _bam_reads(s, d):
    t = roles.fasta(s, d).selectExpr("name", "coalesce(seq, '') AS s")
    return t.selectExpr(
        "name", "CASE WHEN length(s) % 3 = 0 THEN 16 ELSE 0 END AS flag", "concat('ctg', length(s) % 5 + 1) AS rname", "CAST(substr(name, 2) AS BIGINT) * 10 + 1 AS pos", "length(s) % 61 AS mapq",
        "CASE WHEN s = '' THEN '*' ELSE concat(length(s), 'M') END AS cigar", "CASE WHEN s = '' THEN '*' ELSE s END AS seq", "CASE WHEN s = '' THEN '*' ELSE translate(s, 'ACGT', '!+5?') END AS qual",
    )


def _bam_dir(records, s, d, **options):
    path = new_path(s, "format")
    B.write_bam(records, roles.sizes(s, d), path, **options)
    return path


@query("SRC9_bam", sql(f"SELECT {_BAM_ROW} FROM reads", "fasta", also=_BAM))
def _(s, d):
    path = _bam_dir(_bam_reads(s, d), s, d)
    return s.read.format("bam_records").option("split_bytes", 1 << 20).load(path).select(*_BAM_ROW.split(", "))


@query("SRC9_bam_region", sql(f"SELECT {_BAM_ROW} FROM reads WHERE rname = 'ctg2' AND pos >= 501 AND pos < 100000", "fasta", also=_BAM))
def _(s, d):
    path, index = _bam_dir(_bam_reads(s, d), s, d), new_path(s, "index")
    B.build_index(s, path, index)
    return B.read_bam(s, path, index).where("rname = 'ctg2' AND pos >= 501 AND pos < 100000").select(*_BAM_ROW.split(", "))


@query("SNK8_pairs2bam", sql("SELECT read_idx::VARCHAR AS name, CAST(65 + CASE WHEN strand1 = '-' THEN 16 ELSE 0 END AS INT) AS flag, chrom1 AS rname, pos1 AS pos, mapq, '1M' AS cigar, chrom2 AS rnext, pos2 AS pnext FROM pairs UNION ALL SELECT read_idx::VARCHAR, CAST(129 + CASE WHEN strand2 = '-' THEN 16 ELSE 0 END AS INT), chrom2, pos2, mapq, '1M', chrom1, pos1 FROM pairs", "pairs"))
def _(s, d):
    path = _bam_dir(R.to_sam(roles.pairs(s, d)).withColumnRenamed("qname", "name"), s, d)
    return s.read.format("bam_records").load(path).select("name", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext")


@query("SNK8_slide2raw_bam", sql("SELECT regexp_replace(name, '_[0-9]+$', '') AS name, CASE WHEN name LIKE '%\\_0' ESCAPE '\\' THEN flag ELSE flag | 2048 END AS flag, rname, pos, mapq, cigar FROM sam", also=_SAM))
def _(s, d):
    path = _bam_dir(P.slide_to_raw(_sam(s, d)).select("name", "flag", "rname", "pos", "mapq", "cigar"), s, d)
    return s.read.format("bam_records").load(path).select("name", "flag", "rname", "pos", "mapq", "cigar")


@query(
    "LIM2_split_bam",
    sql(
        "SELECT concat('split_', f, '.bam') AS file, count(*) AS records, count(DISTINCT name) AS reads, min(name) AS first, max(name) AS last FROM placed GROUP BY f",
        also=_SAM + ", placed AS (SELECT name, (min(p) OVER (PARTITION BY name) - 1) // 1000 AS f FROM (SELECT name, row_number() OVER (ORDER BY name) AS p FROM sam))",
    ),
)
def _(s, d):
    path = _bam_dir(_sam(s, d).select("name", "flag", "rname", "pos", "mapq", "cigar"), s, d, rows_per_file=1000)
    t = s.read.format("bam_records").load(path)
    return t.groupBy("file").agg(F.count("*").alias("records"), F.count_distinct("name").alias("reads"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("SRC10_vcf", sql("SELECT chrom, s + 1 AS pos, 'A' AS ref, 'C' AS alt FROM bed", "bed"))
def _(s, d):
    return I.read_vcf(s, _text(roles.bed(s, d), s, "chrom", "start + 1", "name", "'A'", "'C'", "'.'", "'PASS'", "'.'")).select("chrom", "pos", "ref", "alt")


@query("SRC10_vcf_region", sql("SELECT chrom, s + 1 AS pos, name AS id FROM bed WHERE chrom = 'ctg3' AND s + 1 BETWEEN 2001 AND 6000", "bed"))
def _(s, d):
    path, index = new_path(s, "format"), new_path(s, "index")
    rows = roles.bed(s, d).repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")
    Z.write_lines(rows.selectExpr("concat_ws('\t', chrom, start + 1, name, 'A', 'C', '.', 'PASS', '.') AS value"), path)
    Z.build_index(s, path, index)
    return I.read_vcf_region(s, path, index, "ctg3", 2001, 6000).select("chrom", "pos", "id")


@query("SNK4_contacts", sql("SELECT contig1, contig2, count::DOUBLE AS count FROM contacts", "contacts"))
def _(s, d):
    return I.read_contacts(s, _text(C.count_contacts(roles.pairs(s, d)), s, "contig1", "contig2", "count"))


@query("SRC12_allele_pairs", sql("SELECT CAST(s_suppkey AS INT) AS idx1, concat('ctg', s_suppkey) AS contig1, 'x' AS contig2, s_suppkey * 3 AS mz_shared, 0.5::DOUBLE AS similarity, -1 AS strand FROM supplier"))
def _(s, d):
    path = _text(roles.table(s, d, "supplier"), s, "s_suppkey", "2", "concat('ctg', s_suppkey)", "'x'", "9", "8", "s_suppkey * 3", "0.5", "-1")
    return I.read_allele_pairs(s, path).select("idx1", "contig1", "contig2", "mz_shared", "similarity", "strand")


@query("SRC12_allele_header", sql("SELECT contig, size, 7::BIGINT AS minimizers, 5::BIGINT AS unique_minimizers FROM sizes", "sizes"))
def _(s, d):
    return I.read_allele_header(s, _lines(roles.sizes(s, d), s, "concat('#', contig, ' ', size, ' 7 5')"))


@query("SRC12_allele_groups", sql("SELECT concat(cluster, ':', s_suppkey) AS row, [contig, concat(contig, 'b')] AS members FROM clusters", "clusters"))
def _(s, d):
    return I.read_allele_groups(s, _lines(roles.clusters(s, d), s, "concat_ws('\t', cluster, s_suppkey, contig, concat(contig, 'b'))"))


@query("SRC13_clusters", sql("SELECT cluster, contig FROM clusters", "clusters"))
def _(s, d):
    t = roles.clusters(s, d).groupBy("cluster").agg(F.array_join(F.collect_list("contig"), " ").alias("c"), F.count("*").alias("n"))
    return I.read_clusters(s, _lines(t, s, "concat(cluster, '\t', n, '\t', c)"))


@query("SRC13_prune", sql("SELECT contig1, contig2, 3::BIGINT AS mz1, 0.25::DOUBLE AS similarity, 1 AS type FROM prune", "prune"))
def _(s, d):
    return I.read_prune(s, _text(roles.prune(s, d), s, "contig1", "contig2", "3", "4", "5", "0.25", "1")).select("contig1", "contig2", "mz1", "similarity", "type")


@query("SRC13_count_re", sql("SELECT contig, size % 9 AS re, size FROM sizes", "sizes"))
def _(s, d):
    return I.read_count_re(s, _text(roles.sizes(s, d), s, "contig", "size % 9", "size"))


@query("SRC13_names", sql("SELECT contig FROM sizes", "sizes"))
def _(s, d):
    return I.read_names(s, _lines(roles.sizes(s, d), s, "contig"))


@query("SRC13_groups", sql("SELECT contig, cluster AS \"group\" FROM clusters", "clusters"))
def _(s, d):
    return I.read_groups(s, _text(roles.clusters(s, d), s, "contig", "cluster"))


@query("SNK5_clm", sql(_ORIENT, "pairs", also=_KEPT))
def _(s, d):
    path = new_path(s, "format")
    W.write_clm(_clm(s, d), path)
    return I.read_clm(s, path).select("contig1", "strand1", "contig2", "strand2", "count", F.array_join(F.col("values").cast("array<string>"), " ").alias("distances"))


@query("SRC14_clm_merged", sql(f"SELECT contig1, strand1, contig2, strand2, count, distances FROM ({_ORIENT})", "pairs", also=_KEPT))
def _(s, d):
    path = new_path(s, "format")
    W.write_clm(_clm(s, d), path)
    t = L.merge_lists(I.read_clm(s, path))
    return t.select("contig1", "strand1", "contig2", "strand2", "count", F.array_join(F.col("values").cast("array<string>"), " ").alias("distances"))


@query("SRC15_split_contacts", sql("SELECT concat(contig1, '_0') AS contig1, concat(contig2, '_1') AS contig2, count::DOUBLE AS count FROM contacts WHERE contig1 IN (SELECT contig FROM clusters WHERE s_suppkey % 2 = 0) AND contig2 IN (SELECT contig FROM clusters WHERE s_suppkey % 2 = 0)", "contacts", "clusters"))
def _(s, d):
    path = _text(C.count_contacts(roles.pairs(s, d)), s, "concat(contig1, '_0')", "concat(contig2, '_1')", "count")
    return I.read_split_contacts(s, path, roles.clusters(s, d).where("s_suppkey % 2 = 0").select("contig"))


@query("SNK6_depth", sql("SELECT chrom, s AS start, e AS \"end\", (e - s)::DOUBLE AS value FROM bed", "bed"))
def _(s, d):
    return I.read_bedgraph(s, _text(roles.bed(s, d), s, "chrom", "start", "end", "end - start"))


@query("SNK7_mnd", sql("SELECT CASE WHEN strand1 = '+' THEN 0 ELSE -1 END AS str1, chrom1 AS chr1, pos1, chrom2 AS chr2, pos2, read_idx::VARCHAR AS name FROM pairs WHERE mapq >= 3", "pairs"))
def _(s, d):
    path = new_path(s, "format")
    W.write_mnd(R.to_mnd(roles.pairs(s, d), q=3), path)
    f = F.split("value", " ")
    return I.text_lines(s, path).select(f[0].cast("int").alias("str1"), f[1].alias("chr1"), f[2].cast("long").alias("pos1"), f[5].alias("chr2"), f[6].cast("long").alias("pos2"), f[14].alias("name"))


@query("SNK8_sam_text", sql("SELECT read_idx::VARCHAR AS name, CAST(65 + CASE WHEN strand1 = '-' THEN 16 ELSE 0 END AS INT) AS flag, chrom1 AS rname, pos1 AS pos FROM pairs UNION ALL SELECT read_idx::VARCHAR, CAST(129 + CASE WHEN strand2 = '-' THEN 16 ELSE 0 END AS INT), chrom2, pos2 FROM pairs", "pairs"))
def _(s, d):
    return I.read_sam(s, _text(R.to_sam(roles.pairs(s, d)), s)).select("name", "flag", "rname", "pos")


@query("SNK10_tours", sql("SELECT cluster, string_agg(concat(contig, '+'), ' ' ORDER BY s_suppkey) AS tour FROM clusters GROUP BY 1", "clusters"))
def _(s, d):
    path = new_path(s, "format")
    W.write_tours(roles.clusters(s, d).select("cluster", F.col("s_suppkey").alias("place"), "contig", F.lit("+").alias("strand")), path)
    f = F.split("value", "\t")
    return I.text_lines(s, path).select(f[0].alias("cluster"), f[1].alias("tour"))


@query("SNK11_summary_file", sql("SELECT status, count(*) AS n_reads FROM st GROUP BY 1", "paf", also=_QUAL + ", " + _STATUS))
def _(s, d):
    path = _text(P.read_summary(_marked(s, d), max_order=4), s, "status", "n_reads")
    return s.read.schema("status string, n_reads long").csv(path, sep="\t")


@query("SET5_by_cluster", sql("SELECT contig, s_suppkey, cluster FROM clusters", "clusters"))
def _(s, d):
    path = new_path(s, "format")
    W.write_by_cluster(roles.clusters(s, d).select("contig", "s_suppkey", "cluster"), path)
    return s.read.schema("contig string, s_suppkey long, cluster string").csv(path, sep="\t")


@query("SORT1_fragments_file", sql("SELECT read_idx, fragment1, fragment2 FROM f WHERE fragment1 IS NOT NULL AND fragment2 IS NOT NULL", "pairs", "bed", also=_FRAG))
def _(s, d):
    path = _text(R.fragments(roles.pairs(s, d), roles.bed(s, d)).orderBy("read_idx"), s, "read_idx", "fragment1", "fragment2")
    return s.read.schema("read_idx long, fragment1 string, fragment2 string").csv(path, sep="\t")
