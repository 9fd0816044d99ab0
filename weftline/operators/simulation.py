"""Simulated reads: long reads cut into pieces, and fragments that carry a sample's variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw, revcomp
from ..functions.intervals import BIN


def split_reads(reads: DataFrame, *, gap: int = 500, shortest: int = 1000, seed: int = 345) -> DataFrame:
    """name_piece, seq of reads of shortest or more, cut at drawn places more than gap apart and from the ends.

    The read is laid out in cells of 2 * gap + 1; each inner cell has at most one cut, in
    its first half, so cuts are far enough from each other whatever is drawn.
    """
    cell = 2 * gap + 1
    rows = reads.where(F.length("seq") >= shortest).withColumn("_h", F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(1_000_003)))
    last = F.greatest(F.lit(0), F.floor((F.length("seq") - gap - 1) / cell)).cast("int")
    cells = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda k: (k <= last) & (draw(seed, F.col("_h"), k) % 2 == 0))
    cuts = F.filter(F.transform(cells, lambda k: (k * cell + draw(seed + 1, F.col("_h"), k) % gap).cast("int")), lambda x: (x > gap) & (x < F.length("seq") - gap))
    marked = rows.withColumn("_b", F.concat(F.array(F.lit(0)), cuts, F.array(F.length("seq"))))
    spans = F.zip_with(F.slice("_b", 1, F.size("_b") - 1), F.slice("_b", 2, F.size("_b") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = marked.select("name", "seq", F.posexplode(spans).alias("piece", "s"))
    return out.select(F.concat_ws("_", "name", F.col("piece").cast("string")).alias("name"), F.substring(F.col("seq"), F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("seq"))


def with_variants(fragments: DataFrame, fasta: DataFrame, vcf: DataFrame) -> DataFrame:
    """fragments (fragment, chrom, start, end) with seq: the reference with the variants inside it put in, left to right.

    vcf: chrom, pos (1-based), ref, alt.  A variant that reaches over the end of the
    fragment or into an earlier one is left out.
    """
    v = vcf.select(F.col("chrom"), (F.col("pos") - 1).alias("p"), "ref", "alt", F.floor((F.col("pos") - 1) / BIN).alias("bin"))
    f = fragments.select("fragment", "chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / BIN))).alias("bin"))
    hit = f.join(v, ["chrom", "bin"]).where("p >= start and p + length(ref) <= end")
    lists = hit.groupBy("fragment").agg(F.sort_array(F.collect_list(F.struct("p", "ref", "alt"))).alias("vs"))
    rows = fragments.join(fasta.select(F.col("name").alias("chrom"), F.col("seq").alias("_g")), "chrom").join(lists, "fragment", "left")
    rows = rows.withColumn("_r", F.substring(F.col("_g"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    none = F.array().cast("array<struct<p:bigint,ref:string,alt:string>>")

    def step(s: Column, x: Column) -> Column:
        at = (x["p"] - F.col("start")).cast("int")
        early = at < s["at"]
        kept = F.concat(s["out"], F.substring(F.col("_r"), s["at"] + 1, at - s["at"]), x["alt"])
        return F.struct(F.when(early, s["out"]).otherwise(kept).alias("out"), F.when(early, s["at"]).otherwise(at + F.length(x["ref"])).alias("at"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    seq = F.aggregate(F.coalesce("vs", none), first, step, lambda s: F.concat(s["out"], F.substring(F.col("_r"), s["at"] + 1, F.length("_r"))))
    return rows.select("fragment", seq.alias("seq"))


def simulate_porec(fragments: DataFrame, fasta: DataFrame, vcf: DataFrame) -> DataFrame:
    """read_idx, seq: the fragments of each read joined in order.  fragments: read_idx, ordinal, chrom, start, end."""
    named = fragments.withColumn("fragment", F.struct("read_idx", "ordinal").cast("string"))
    made = named.select("fragment", "read_idx", "ordinal").join(with_variants(named, fasta, vcf), "fragment")
    return made.groupBy("read_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def simulate_hic(mates: DataFrame, fasta: DataFrame, vcf: DataFrame, *, q: int = 1) -> DataFrame:
    """name, seq1, seq2 of mate pairs on one chromosome with mapq >= q both; reverse mates are reverse-complemented."""
    ok = mates.where((F.col("chrom1") == F.col("chrom2")) & (F.col("mapq1") >= q) & (F.col("mapq2") >= q))
    out = ok.select("name", "strand1", "strand2")
    for k in ("1", "2"):
        f = ok.select(F.col("name").alias("fragment"), F.col(f"chrom{k}").alias("chrom"), F.col(f"start{k}").alias("start"), F.col(f"end{k}").alias("end"))
        s = with_variants(f, fasta, vcf).select(F.col("fragment").alias("name"), F.col("seq").alias(f"_s{k}"))
        out = out.join(s, "name").withColumn(f"seq{k}", F.when(F.col(f"strand{k}") == "-", revcomp(F.col(f"_s{k}"))).otherwise(F.col(f"_s{k}")))
    return out.select("name", "seq1", "seq2")
