"""The driver's tables in the roles of this library's inputs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg((F.max("p_partkey") * 50 + 1000).alias("size"))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.concat(F.lit("ctg"), F.col("s_suppkey").cast("string")).alias("contig")).crossJoin(F.broadcast(length(spark, d)))


def paf(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS read_idx", "l_linenumber AS ordinal", "concat('ctg', l_suppkey) AS target", "l_partkey * 50 AS target_start", "l_partkey * 50 + CAST(l_quantity AS BIGINT) * 10 AS target_end",
        "CAST(l_quantity AS BIGINT) * 10 AS aln_length", "CAST(l_quantity AS BIGINT) * 10 - CAST(round(l_quantity * 10 * l_discount) AS BIGINT) AS matches", "CAST(0 AS BIGINT) AS query_start",
        "CAST(l_quantity AS BIGINT) * 10 AS query_end", "CAST(l_quantity AS INT) AS mapq", "CASE WHEN l_returnflag = 'A' THEN '-' ELSE '+' END AS strand",
    )
    return rows.crossJoin(F.broadcast(length(spark, d).withColumnRenamed("size", "target_length")))


def pieces(spark: SparkSession, d: str) -> DataFrame:
    return paf(spark, d).select("read_idx", "ordinal", "target", "target_start", "target_end", "strand", "mapq")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.pairs import virtual_pairs

    return virtual_pairs(pieces(spark, d))


def bed(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    return table(spark, d, "part").crossJoin(F.broadcast(n)).selectExpr("concat('ctg', p_partkey % n + 1) AS chrom", "p_partkey * 40 AS start", "p_partkey * 40 + p_size * 10 AS end", "concat('frag', p_partkey) AS name")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").selectExpr("concat('n', s_nationkey) AS cluster", "concat('ctg', s_suppkey) AS contig", "s_suppkey", "s_nationkey")


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_suppkey % 10 = 0").selectExpr("concat('ctg', s_suppkey) AS contig", "concat('ctg', s_suppkey, '_d1') AS duplicate")


def prune(spark: SparkSession, d: str) -> DataFrame:
    c = clusters(spark, d)
    a, b = c.select("cluster", F.col("contig").alias("contig1")), c.select("cluster", F.col("contig").alias("contig2"))
    return a.join(b, "cluster").where("contig1 <> contig2").select("contig1", "contig2")


def fasta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def fastq(spark: SparkSession, d: str) -> DataFrame:
    return fasta(spark, d).withColumn("qual", F.translate("seq", "ACGT", "!+5?"))


#: The same as SQL; queries put the ones they need before their own.
SQL = {
    "len": "len AS (SELECT max(p_partkey) * 50 + 1000 AS size FROM part)",
    "sizes": "sizes AS (SELECT concat('ctg', s_suppkey) AS contig, len.size FROM supplier, len)",
    "paf": """paf AS (SELECT l_orderkey AS read_idx, l_linenumber AS ordinal, concat('ctg', l_suppkey) AS target, l_partkey * 50 AS target_start, l_partkey * 50 + CAST(l_quantity AS BIGINT) * 10 AS target_end,
 CAST(l_quantity AS BIGINT) * 10 AS aln_length, CAST(l_quantity AS BIGINT) * 10 - CAST(round(l_quantity * 10 * l_discount) AS BIGINT) AS matches, 0::BIGINT AS query_start, CAST(l_quantity AS BIGINT) * 10 AS query_end,
 CAST(l_quantity AS INT) AS mapq, CASE WHEN l_returnflag = 'A' THEN '-' ELSE '+' END AS strand, len.size AS target_length FROM lineitem, len)""",
    "ranked": "ranked AS (SELECT *, row_number() OVER (PARTITION BY read_idx ORDER BY target, target_start, target_end, ordinal, strand, mapq) AS rn, count(*) OVER (PARTITION BY read_idx) AS n FROM paf WHERE mapq >= 1)",
    "pairs": """pairs AS (SELECT a.read_idx, a.target AS chrom1, (a.target_start + a.target_end) // 2 AS pos1, b.target AS chrom2, (b.target_start + b.target_end) // 2 AS pos2, a.strand AS strand1, b.strand AS strand2, least(a.mapq, b.mapq) AS mapq
 FROM ranked a JOIN ranked b ON a.read_idx = b.read_idx AND a.rn < b.rn WHERE a.n BETWEEN 2 AND 49)""",
    "bed": "bed AS (SELECT concat('ctg', p_partkey % (SELECT count(*) FROM supplier) + 1) AS chrom, p_partkey * 40 AS s, p_partkey * 40 + p_size * 10 AS e, concat('frag', p_partkey) AS name FROM part)",
    "clusters": "clusters AS (SELECT concat('n', s_nationkey) AS cluster, concat('ctg', s_suppkey) AS contig, s_suppkey, s_nationkey FROM supplier)",
    "prune": "prune AS (SELECT a.contig AS contig1, b.contig AS contig2 FROM clusters a JOIN clusters b ON a.cluster = b.cluster AND a.contig <> b.contig)",
    "contacts": "contacts AS (SELECT least(chrom1, chrom2) AS contig1, greatest(chrom1, chrom2) AS contig2, count(*) AS count FROM pairs GROUP BY ALL)",
    "fasta": "fasta AS (SELECT concat('d', doc_id) AS name, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)",
}
_NEEDS = {"sizes": ["len"], "paf": ["len"], "ranked": ["paf"], "pairs": ["ranked"], "prune": ["clusters"], "contacts": ["pairs"]}


def sql(body: str, *names: str, also: str = "") -> str:
    """WITH the named roles (and what they need), and also, before body."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [SQL[n] for n in order] + ([also] if also else [])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def draw_sql(seed: int | str, *keys: str) -> str:
    """functions.columns.draw in SQL."""
    out = str(seed)
    for k in keys:
        out = f"((({out}) * 48271 + (({k}) % 1000003) * 69621 + 12345) % 1000003)"
    return out


def wide_draw_sql(seed: int | str, *keys: str) -> str:
    """functions.select.wide_draw in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {seed}, {', '.join(keys)})), 1, 15) AS BIGINT)"
