"""Virtual pairs and the operators on pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw, midpoint
from ..functions.intervals import disjoint, inside, locate, overlap_filter
from ..functions.scratch import spool
from ..functions.select import crossing, share, smallest, wide_draw

PAIR = ["read_idx", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "mapq"]
#: Contigs whose clusters are broadcast; more of them are joined by shuffle.
BROADCAST_CONTIGS = 500_000


def rank_pieces(pieces: DataFrame, *, read: str = "read_idx") -> DataFrame:
    """rn: rank by (target, start, end, ordinal) in the read; n: pieces of the read."""
    w = Window.partitionBy(read)
    return pieces.withColumn("rn", F.row_number().over(w.orderBy("target", "target_start", "target_end", "ordinal"))).withColumn("n", F.count("*").over(w))


def virtual_pairs(pieces: DataFrame, *, q: int = 1, min_order: int = 2, max_order: int = 50) -> DataFrame:
    """All pairs of pieces inside each read of min_order <= pieces < max_order; positions are midpoints, mapq the lesser.

    Pieces of a read are gathered into one sorted array (fewer than max_order) and expanded
    in place: one shuffle by read instead of a self-join.  Larger reads are counted before
    the shuffle and taken out, so none is gathered.  Pieces without a read make no pairs.
    """
    kept = pieces.where((F.col("mapq") >= q) & F.col("read_idx").isNotNull())
    large = kept.groupBy("read_idx").agg(F.count("*").alias("_n")).where(F.col("_n") >= max_order).select("read_idx")
    item = F.struct("target", "target_start", "target_end", "ordinal", "strand", "mapq")
    reads = kept.join(large, "read_idx", "left_anti").groupBy("read_idx").agg(F.sort_array(F.collect_list(item)).alias("a")).where(F.size("a") >= min_order)
    one = reads.select("read_idx", "a", F.posexplode("a").alias("i", "x"))
    both = one.select("read_idx", "x", F.explode(F.slice("a", F.col("i") + 2, F.size("a"))).alias("y"))
    return both.select(
        "read_idx", F.col("x.target").alias("chrom1"), midpoint(F.col("x.target_start"), F.col("x.target_end")).alias("pos1"), F.col("y.target").alias("chrom2"),
        midpoint(F.col("y.target_start"), F.col("y.target_end")).alias("pos2"), F.col("x.strand").alias("strand1"), F.col("y.strand").alias("strand2"), F.least("x.mapq", "y.mapq").alias("mapq"),
    )


def bam_pairs(sam: DataFrame, *, q: int = 1) -> DataFrame:
    """All pairs of the alignments of each read name, in their order along the read, canonical by (chrom, pos).

    sam: name, flag, rname, pos, mapq, cigar.  Unmapped, secondary, duplicate and failed
    records (flag 0x704) and those with mapq < q don't count.  The order is that of the
    first aligned base of the read as sequenced, ties by place.  Ends are swapped with
    their strands so that (chrom1, pos1) <= (chrom2, pos2).  A read's alignments are one array.
    """
    op = lambda k: F.expr(f"regexp_extract_all(cigar, '([0-9]+)[{k}]', 1)")
    total = lambda a: F.aggregate(a.cast("array<bigint>"), F.lit(0).cast("long"), lambda x, y: x + y)
    clip = lambda p: F.expr(f"regexp_extract(cigar, '{p}', 0)")
    ahead = lambda c: total(F.regexp_extract_all(c, F.lit("([0-9]+)[SH]"), F.lit(1)))
    reverse = F.col("flag").bitwiseAND(16) != 0
    good = sam.where((F.col("flag").bitwiseAND(0x704) == 0) & (F.col("mapq") >= q) & (F.length(F.concat_ws("", op("MIX="))) > 0))
    start = F.when(reverse, ahead(clip("([0-9]+[SH])*$"))).otherwise(ahead(clip("^([0-9]+[SH])*")))
    item = F.struct(start.alias("at"), F.col("rname").alias("chrom"), "pos", F.when(reverse, "-").otherwise("+").alias("strand"), "mapq")
    reads = good.groupBy("name").agg(F.sort_array(F.collect_list(item)).alias("a")).where(F.size("a") > 1)
    one = reads.select("name", "a", F.posexplode("a").alias("i", "x"))
    both = one.select("name", "x", F.explode(F.slice("a", F.col("i") + 2, F.size("a"))).alias("y"))
    swap = F.struct("x.chrom", "x.pos") > F.struct("y.chrom", "y.pos")
    first, second = F.when(swap, F.col("y")).otherwise(F.col("x")), F.when(swap, F.col("x")).otherwise(F.col("y"))
    ends = both.select("name", first.alias("p"), second.alias("s"))
    return ends.select(
        F.col("name").alias("read_idx"), F.col("p.chrom").alias("chrom1"), F.col("p.pos").alias("pos1"), F.col("s.chrom").alias("chrom2"), F.col("s.pos").alias("pos2"),
        F.col("p.strand").alias("strand1"), F.col("s.strand").alias("strand2"), F.least("p.mapq", "s.mapq").alias("mapq"),
    )


def canonical(pairs: DataFrame) -> DataFrame:
    """Ends swapped, strands with them, so that chrom1 <= chrom2."""
    swap = F.col("chrom1") > F.col("chrom2")

    def pick(a: str, b: str, name: str):
        return F.when(swap, F.col(b)).otherwise(F.col(a)).alias(name)

    rest = [k for k in pairs.columns if k not in PAIR or k in ("read_idx", "mapq")]
    out = [pick("chrom1", "chrom2", "chrom1"), pick("pos1", "pos2", "pos1"), pick("chrom2", "chrom1", "chrom2"), pick("pos2", "pos1", "pos2"), pick("strand1", "strand2", "strand1"), pick("strand2", "strand1", "strand2")]
    return pairs.select(*rest, *out)


def filter_pairs(pairs: DataFrame, *, q: int = 1, whitelist: DataFrame | None = None) -> DataFrame:
    """mapq >= q (rows without mapq pass), and both contigs in whitelist (contig), if given."""
    out = pairs.where((F.col("mapq") >= q) | F.col("mapq").isNull())
    if whitelist is not None:
        names = whitelist.select("contig").distinct()
        for side in ("chrom1", "chrom2"):
            out = out.join(names.withColumnRenamed("contig", side), side, "left_semi")
    return out


def near_ends(pairs: DataFrame, sizes: DataFrame, edge: int) -> DataFrame:
    """Pairs whose ends are both within edge of an end of their contig."""
    out = pairs
    for k in ("1", "2"):
        out = out.join(sizes.select(F.col("contig").alias(f"chrom{k}"), F.col("size").alias(f"_size{k}")), f"chrom{k}")
        out = out.where((F.col(f"pos{k}") <= edge) | (F.col(f"pos{k}") >= F.col(f"_size{k}") - edge)).drop(f"_size{k}")
    return out


def down_weight_q0(pairs: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Rows with mapq >= 1 all stay; rows with mapq 0 with probability min(1, q1 * ratio / q0); ratio 0: all."""
    if ratio == 0:
        return pairs
    q1 = F.sum(F.when(F.col("mapq") >= 1, 1).otherwise(0))
    totals = pairs.agg(q1.alias("_q1"), (F.count("*") - q1).alias("_q0"))
    out = pairs.crossJoin(F.broadcast(totals))
    p = F.least(F.lit(1.0), F.col("_q1") * F.lit(float(ratio)) / F.greatest(F.col("_q0"), F.lit(1)))
    return out.where((F.col("mapq") >= 1) | (draw(seed, F.col("read_idx"), F.col("pos1"), F.col("pos2")) < p * 1_000_003)).drop("_q1", "_q0")


def drop_ordered(pairs: DataFrame, prune: DataFrame) -> DataFrame:
    """Rows whose contigs, as written, aren't in prune (contig1, contig2)."""
    keys = prune.select(F.col("contig1").alias("chrom1"), F.col("contig2").alias("chrom2")).distinct()
    return pairs.join(keys, ["chrom1", "chrom2"], "left_anti")


def drop_unordered(pairs: DataFrame, prune: DataFrame) -> DataFrame:
    """Rows whose contigs, in either order, aren't in prune."""
    keys = prune.select(F.least("contig1", "contig2").alias("_a"), F.greatest("contig1", "contig2").alias("_b")).distinct()
    return pairs.join(keys, (F.least("chrom1", "chrom2") == F.col("_a")) & (F.greatest("chrom1", "chrom2") == F.col("_b")), "left_anti")


def _without_clustered(pairs: DataFrame, clusters: DataFrame, apart: Column) -> DataFrame:
    held = clusters.where("contig is not null and cluster is not null").groupBy("contig").agg(F.collect_set("cluster").alias("_c"))
    if held.limit(BROADCAST_CONTIGS + 1).count() <= BROADCAST_CONTIGS:
        held = F.broadcast(held)
    out = pairs
    for k in (1, 2):
        out = out.join(held.select(F.col("contig").alias(f"chrom{k}"), F.col("_c").alias(f"_c{k}")), f"chrom{k}", "left")
    return out.where(~F.coalesce(F.arrays_overlap("_c1", "_c2") & apart, F.lit(False))).select(pairs.columns)


def drop_clustered_ordered(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """drop_ordered() of the prune table of all contig1 < contig2 that share a cluster (cluster, contig), which isn't made: it grows as the square of the clusters."""
    return _without_clustered(pairs, clusters, F.col("chrom1") < F.col("chrom2"))


def drop_clustered(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """drop_unordered() of the prune table of all different contigs that share a cluster, which isn't made."""
    return _without_clustered(pairs, clusters, F.col("chrom1") != F.col("chrom2"))


def to_mnd(pairs: DataFrame, *, q: int = 1) -> DataFrame:
    """The 16 columns of a Juicer medium-format row."""
    strand = lambda k: F.when(F.col(k) == "+", 0).otherwise(-1)
    return pairs.where(F.col("mapq") >= q).select(
        strand("strand1").alias("str1"), F.col("chrom1").alias("chr1"), "pos1", F.lit(0).alias("frag1"), strand("strand2").alias("str2"), F.col("chrom2").alias("chr2"), "pos2", F.lit(1).alias("frag2"),
        F.col("mapq").alias("mapq1"), F.lit("-").alias("cigar1"), F.lit("-").alias("seq1"), F.col("mapq").alias("mapq2"), F.lit("-").alias("cigar2"), F.lit("-").alias("seq2"),
        F.col("read_idx").cast("string").alias("name1"), F.col("read_idx").cast("string").alias("name2"),
    )


def to_sam(pairs: DataFrame, *, q: int = 1) -> DataFrame:
    """Two mate records for each pair."""
    mate = lambda a, b, flag: F.struct(F.lit(flag).alias("flag"), F.col(f"chrom{a}").alias("rname"), F.col(f"pos{a}").alias("pos"), F.col(f"strand{a}").alias("strand"), F.col(f"chrom{b}").alias("rnext"), F.col(f"pos{b}").alias("pnext"))
    out = pairs.where(F.col("mapq") >= q).select("read_idx", "mapq", F.explode(F.array(mate(1, 2, 65), mate(2, 1, 129))).alias("m"))
    reverse = F.when(F.col("m.strand") == "-", 16).otherwise(0)
    return out.select(F.col("read_idx").cast("string").alias("qname"), (F.col("m.flag") + reverse).alias("flag"), F.col("m.rname").alias("rname"), F.col("m.pos").alias("pos"), "mapq", F.lit("1M").alias("cigar"), F.col("m.rnext").alias("rnext"), F.col("m.pnext").alias("pnext"), F.lit(0).alias("tlen"), F.lit("*").alias("seq"), F.lit("*").alias("qual"))


def intersect_pairs(pairs: DataFrame, bed: DataFrame, *, invert: bool = False, q: int = 1) -> DataFrame:
    """Pairs with both ends inside intervals; inverted: with not both."""
    segments = disjoint(bed)
    out = inside(pairs.where(F.col("mapq") >= q), segments, "chrom1", F.col("pos1"), "_in1")
    out = inside(out, segments, "chrom2", F.col("pos2"), "_in2")
    both = F.col("_in1") & F.col("_in2")
    return out.where(~both if invert else both).drop("_in1", "_in2")


def intersect_pieces(pieces: DataFrame, bed: DataFrame, *, invert: bool = False) -> DataFrame:
    """Pieces that overlap any interval; inverted: none."""
    return overlap_filter(pieces, disjoint(bed), "target", "target_start", "target_end", invert=invert)


def break_pairs(pairs: DataFrame, bed: DataFrame) -> DataFrame:
    """Ends in a broken contig move to its part: pos - start + 1; others stay."""
    out = pairs
    segments = disjoint(bed)
    for k in ("1", "2"):
        out = locate(out, segments, f"chrom{k}", F.col(f"pos{k}"), "_b_")
        out = out.withColumn(f"pos{k}", F.when(F.col("_b_start").isNull(), F.col(f"pos{k}")).otherwise(F.col(f"pos{k}") - F.col("_b_start") + 1)).withColumn(f"chrom{k}", F.coalesce("_b_name", f"chrom{k}")).drop("_b_start", "_b_end", "_b_name")
    return out


def break_sizes(sizes: DataFrame, bed: DataFrame) -> DataFrame:
    """Sizes after breaking: parts of stop - start + 1, and contigs that aren't broken."""
    whole = sizes.join(bed.select(F.col("chrom").alias("contig")).distinct(), "contig", "left_anti")
    return whole.select("contig", "size").union(bed.select(F.col("name").alias("contig"), (F.col("end") - F.col("start") + 1).alias("size")))


def break_pieces(pieces: DataFrame, bed: DataFrame) -> DataFrame:
    """Pieces wholly in the part that holds their start move to it; others stay."""
    out = locate(pieces, disjoint(bed), "target", F.col("target_start"), "_b_")
    s = F.col("target_start") - F.col("_b_start") + 1
    e = F.col("target_end") - F.col("_b_start") + 1
    ok = F.col("_b_start").isNotNull() & (e <= F.col("_b_end") - F.col("_b_start") + 1)
    out = out.withColumn("_s", s).withColumn("_e", e).withColumn("_ok", ok)
    moved = lambda new, old: F.when(F.col("_ok"), F.col(new)).otherwise(F.col(old))
    out = out.withColumn("target", moved("_b_name", "target")).withColumn("target_start", moved("_s", "target_start")).withColumn("target_end", moved("_e", "target_end"))
    return out.drop("_b_start", "_b_end", "_b_name", "_s", "_e", "_ok")


def chrom_to_contig(pairs: DataFrame, bed: DataFrame) -> DataFrame:
    """1-based chromosome positions to contigs: both ends must map; result canonical, strands included."""
    out = pairs
    segments = disjoint(bed)
    for k in ("1", "2"):
        out = locate(out, segments, f"chrom{k}", F.col(f"pos{k}") - 1, "_b_", how="inner")
        out = out.withColumn(f"pos{k}", F.col(f"pos{k}") - F.col("_b_start")).withColumn(f"chrom{k}", F.col("_b_name")).drop("_b_start", "_b_end", "_b_name")
    return canonical(out)


def chrom_to_contig_pieces(pieces: DataFrame, bed: DataFrame) -> DataFrame:
    """Pieces whose midpoint is in a contig that holds them wholly, in its coordinates."""
    out = locate(pieces, disjoint(bed), "target", midpoint(F.col("target_start"), F.col("target_end")), "_b_", how="inner")
    out = out.where("target_start >= _b_start and target_end <= _b_end")
    out = out.withColumn("target_start", F.col("target_start") - F.col("_b_start")).withColumn("target_end", F.col("target_end") - F.col("_b_start")).withColumn("target", F.col("_b_name"))
    return out.drop("_b_start", "_b_end", "_b_name")


def fragments(pairs: DataFrame, digest: DataFrame) -> DataFrame:
    """Pairs with the restriction fragment (name) of each end; both must be in one."""
    out = pairs
    segments = disjoint(digest)
    for k in ("1", "2"):
        out = locate(out, segments, f"chrom{k}", F.col(f"pos{k}"), f"_f{k}_", how="inner").withColumnRenamed(f"_f{k}_name", f"fragment{k}").drop(f"_f{k}_start", f"_f{k}_end")
    return out


def duplicate_pairs(pairs: DataFrame, collapsed: DataFrame, *, seed: int = 42) -> DataFrame:
    """Contigs with duplicates are replaced by one of [self, duplicates], drawn for each end."""
    names = collapsed.groupBy("contig").agg(F.sort_array(F.collect_set("duplicate")).alias("_d"))
    out = pairs
    for k in ("1", "2"):
        out = out.join(names.withColumnRenamed("contig", f"chrom{k}"), f"chrom{k}", "left")
        pool = F.concat(F.array(f"chrom{k}"), F.coalesce("_d", F.array().cast("array<string>")))
        out = out.withColumn(f"chrom{k}", F.element_at(pool, (draw(seed + int(k), F.col("read_idx"), F.col("pos1"), F.col("pos2")) % F.size(pool)).cast("int") + 1)).drop("_d")
    return out.select(pairs.columns)


def duplicate_pieces(pieces: DataFrame, collapsed: DataFrame, *, seed: int = 42) -> DataFrame:
    """As duplicate_pairs, with one draw for each read and contig: contigs are told apart by a hash of their name."""
    names = collapsed.groupBy(F.col("contig").alias("target")).agg(F.sort_array(F.collect_set("duplicate")).alias("_d"))
    out = pieces.join(names, "target", "left")
    pool = F.concat(F.array("target"), F.coalesce("_d", F.array().cast("array<string>")))
    number = F.conv(F.substring(F.md5(F.col("target").cast("binary")), 1, 7), 16, 10).cast("long")
    return out.withColumn("target", F.element_at(pool, (draw(seed, F.col("read_idx"), number) % F.size(pool)).cast("int") + 1)).select(pieces.columns)


def merge_pairs(first: DataFrame, *others: DataFrame) -> DataFrame:
    out = first
    for o in others:
        out = out.unionByName(o)
    return out


def _pair_draw(seed: int) -> Column:
    return wide_draw(seed, F.col("read_idx"), F.col("pos1"), F.col("pos2"))


def sample_fraction(pairs: DataFrame, p: float, *, q: int = 0, seed: int = 42) -> DataFrame:
    """Rows with mapq >= q, each with probability p, by a repeatable draw of 60 bits."""
    return pairs.where(F.col("mapq") >= q).where(_pair_draw(seed) < share(p))


def sample_number(pairs: DataFrame, n: int, *, q: int = 0, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer): those of the smallest draws, ties in the order of the columns."""
    return smallest(pairs.where(F.col("mapq") >= q), _pair_draw(seed), n)


def sample_reads(pieces: DataFrame, *, mode: str = "pairs", target: float = 0, q: int = 1, min_order: int = 2, max_order: int = 50, seed: int = 42) -> DataFrame:
    """All rows of reads taken in the order of a draw until pairs, reads or a share (frac) of reads is reached.

    The draw up to which all reads are taken is found by its digits; only the reads around
    it are ordered.
    """
    ok = pieces.groupBy("read_idx").agg(F.sum(F.when(F.col("mapq") >= q, 1).otherwise(0)).alias("k"))
    ok = ok.where((F.col("k") >= min_order) & (F.col("k") < max_order))
    ok = spool(ok.select("read_idx", (F.expr("k * (k - 1) div 2") if mode == "pairs" else F.lit(1)).cast("long").alias("x"), wide_draw(seed, F.col("read_idx")).alias("d")), "sample-reads")
    goal = target * ok.count() if mode == "frac" else target
    found = crossing(ok, goal) if goal > 0 else (0, 0, 0)
    chosen = ok
    if found is not None:
        low, high, before = found
        running = F.sum("x").over(Window.orderBy("d", "read_idx").rowsBetween(Window.unboundedPreceding, -1))
        around = ok.where((F.col("d") >= low) & (F.col("d") < high)).withColumn("before", F.lit(before) + F.coalesce(running, F.lit(0)))
        chosen = ok.where(F.col("d") < low).select("read_idx").union(around.where(F.col("before") < goal).select("read_idx"))
    return pieces.join(chosen.select("read_idx"), "read_idx", "left_semi")


def sample_alignments(pieces: DataFrame, *, mode: str = "pairs", target: float = 0, q: int = 0, min_order: int = 1, max_order: int = 50, seed: int = 42) -> DataFrame:
    """Reads kept whole with one probability, target over the total of eligible pairs, reads or bases (bases ignore the order), or a share (frac)."""
    good = F.col("mapq") >= q
    per = pieces.groupBy("read_idx").agg(F.sum(F.when(good, 1).otherwise(0)).alias("k"), F.sum(F.when(good, F.col("target_end") - F.col("target_start")).otherwise(0)).alias("bases"))
    if mode != "bases":
        per = per.where((F.col("k") >= min_order) & (F.col("k") < max_order))
    x = {"pairs": F.expr("k * (k - 1) div 2"), "reads": F.lit(1), "bases": F.col("bases"), "frac": F.lit(1)}[mode]
    total = per.agg(F.sum(x).alias("_all"))
    p = F.lit(float(target)) if mode == "frac" else F.lit(float(target)) / F.greatest(F.col("_all"), F.lit(1))
    chosen = per.crossJoin(F.broadcast(total)).where(wide_draw(seed, F.col("read_idx")) < share(p))
    return pieces.join(chosen.select("read_idx"), "read_idx", "left_semi")


def phase_reads(pieces: DataFrame, groups: DataFrame, *, q: int = 0) -> DataFrame:
    """Each read's group with most pieces (smallest name on ties), else Unassigned."""
    named = pieces.where(F.col("mapq") >= q).join(groups.select(F.col("contig").alias("target"), "group"), "target")
    votes = named.groupBy("read_idx", "group").agg(F.count("*").alias("n"))
    best = votes.groupBy("read_idx").agg(F.min_by("group", F.struct(-F.col("n"), F.col("group"))).alias("group"))
    return pieces.select("read_idx").distinct().join(best, "read_idx", "left").select("read_idx", F.coalesce("group", F.lit("Unassigned")).alias("group"))
