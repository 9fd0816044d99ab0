"""Sequences: sizes, digestion, windows, k-mers, masking, extraction, CIGAR folding, base modifications."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import revcomp
from ..functions.scratch import spool, unspool
from ..sources.taskfiles import files, filesystem

#: Letters of the longest k-mer of which a task can hold a number for each.
SHORT = 11
_BASE = np.full(256, 4, np.int32)
_BASE[[ord(ch) for ch in "ACGT"]] = range(4)


def sizes(fasta: DataFrame) -> DataFrame:
    """First word of the name, and the length."""
    return fasta.select(F.split("name", "\\s+")[0].alias("contig"), F.length("seq").cast("long").alias("size"))




def stretches(fasta: DataFrame, width: int, size: int = 2_000) -> DataFrame:
    """name, offset, seq: stretches of size windows of width characters, overlapping by width - 1, so each window is in one.

    Finding a character in a string takes time in proportion to its place; in short
    stretches, windows of sequences of any length cost the same each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = range(0, max(0, len(seq or "") - width + 1), size)
                for k in range(0, len(at), 500):
                    part = at[k : k + 500]
                    yield pa.RecordBatch.from_pydict({"name": pa.array([name] * len(part), pa.string()), "offset": pa.array(list(part), pa.int64()), "seq": pa.array([seq[i : i + size + width - 1] for i in part], pa.string())})

    return fasta.select("name", "seq").mapInArrow(run, "name string, offset long, seq string")


def digest(fasta: DataFrame, pattern: str = "GATC", slope: int = 30) -> DataFrame:
    """name, start, end around each cut, place + len/2, clamped to the sequence; occurrences may overlap."""
    n, cut = len(pattern), len(pattern) // 2
    hits = F.filter(F.sequence(F.lit(1), F.length("seq") - (n - 1)), lambda i: F.substring(F.col("seq"), i, F.lit(n)) == F.lit(pattern))
    found = stretches(fasta, n).select("name", "offset", F.explode(hits).alias("i"))
    rows = found.join(fasta.select("name", F.length("seq").alias("_n")), "name").withColumn("at", F.col("offset") + F.col("i") - 1 + cut)
    return rows.select("name", F.greatest(F.lit(0), F.col("at") - slope).cast("long").alias("start"), F.least(F.col("_n"), F.col("at") + slope).cast("long").alias("end"))


def site_counts(fasta: DataFrame, patterns: str = "AAGCTT", *, min_re: int = 1, pseudo: int = 1) -> DataFrame:
    """contig, re, size: sites of the comma-separated patterns, not overlapping, plus pseudo; shorter patterns first."""
    some = sorted(patterns.upper().split(","), key=len)
    n = F.regexp_count(F.upper("seq"), F.lit("|".join(f"({p})" for p in some))) + pseudo
    return fasta.select(F.split("name", "\\s+")[0].alias("contig"), n.cast("long").alias("re"), F.length("seq").cast("long").alias("size")).where(F.col("re") >= min_re)


def cut_reads(fastq: DataFrame, pattern: str = "GATC") -> DataFrame:
    """Pieces of reads between cuts at place + len/2; each keeps its read's name.  piece numbers them from 0."""
    cut = len(pattern) // 2
    marked = fastq.withColumn("_p", F.split("seq", f"(?<={pattern[:cut]})(?={pattern[cut:]})"))
    marked = marked.withColumn("_l", F.transform("_p", lambda x: F.length(x)))
    rows = marked.select("name", "qual", "_l", F.posexplode("_p").alias("piece", "seq"))
    before = F.aggregate(F.slice("_l", F.lit(1), F.col("piece")), F.lit(0), lambda s, x: s + x)
    return rows.where(F.length("seq") > 0).select("name", "piece", "seq", F.substring(F.col("qual"), before + 1, F.length("seq")).alias("qual"))


def slide_fasta(fasta: DataFrame, window: int = 10_000, step: int = 0) -> DataFrame:
    """Windows name:start-end; the window that reaches the end is the last."""
    step = step or window
    last = F.greatest(F.lit(0), F.ceil((F.length("seq") - window) / step)).cast("int")
    rows = fasta.where(F.length("seq") > 0).select("name", "seq", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    a, b = F.col("k") * step, F.least(F.length("seq"), F.col("k") * step + window)
    return rows.select(F.concat(F.col("name"), F.lit(":"), a.cast("string"), F.lit("-"), b.cast("string")).alias("name"), F.substring(F.col("seq"), a + 1, b - a).alias("seq"))


def slide_fastq(fastq: DataFrame, window: int = 5_000, step: int = 0, *, min_length: int = 0, coordinate: bool = False) -> DataFrame:
    """Windows name_i or name:start-end while start < length; only those of min_length or more."""
    step = step or window
    rows = fastq.where(F.length("seq") > 0).select("name", "seq", "qual", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / step).cast("int"))).alias("k"))
    a, b = F.col("k") * step, F.least(F.length("seq"), F.col("k") * step + window)
    label = F.concat(F.lit(":"), a.cast("string"), F.lit("-"), b.cast("string")) if coordinate else F.concat(F.lit("_"), F.col("k").cast("string"))
    part = lambda k: F.substring(F.col(k), a + 1, b - a)
    return rows.where(b - a >= min_length).select(F.concat("name", label).alias("name"), part("seq").alias("seq"), part("qual").alias("qual"))


def _kmers(fasta: DataFrame, k: int) -> DataFrame:
    """name, i (1-based place), kmer of every window."""
    rows = stretches(fasta, k).select("name", "offset", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - (k - 1))).alias("j"))
    return rows.select("name", (F.col("offset") + F.col("j")).alias("i"), F.substring(F.col("seq"), F.col("j"), F.lit(k)).alias("kmer"))


def kmer_counts(fasta: DataFrame, k: int = 19) -> DataFrame:
    """Windows as they are and reverse-complemented: each counts once both ways.  One aggregation before the strands are united."""
    one = _kmers(fasta, k).groupBy("kmer").agg(F.count("*").alias("n"))
    both = one.union(one.select(revcomp(F.col("kmer")), "n"))
    return both.groupBy("kmer").agg(F.sum("n").alias("n"))


def kmer_positions(fasta: DataFrame, kmers: DataFrame, k: int = 19) -> DataFrame:
    """name, start, end of windows that are, or whose reverse complement is, in kmers (kmer)."""
    wanted = kmers.select("kmer").union(kmers.select(revcomp(F.col("kmer")))).distinct()
    return _kmers(fasta, k).join(wanted, "kmer", "left_semi").select("name", (F.col("i") - 1).cast("long").alias("start"), (F.col("i") - 1 + k).cast("long").alias("end"))


def _windows(text: pa.Array, k: int, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """The windows of an array of sequences, over their joined bytes, for at most so many starts: the first start, and each window's number in base 4, -1 where a letter isn't one of ACGT, -2 where it leaves its sequence."""
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends[1:] - ends[0]
    over = np.zeros(len(data), bool)
    crossing = (ends[:, None] - np.arange(1, k)).ravel()
    over[crossing[crossing >= 0]] = True
    for first in range(0, len(data), most):
        code = _BASE[data[first : first + most + k - 1]]
        n = min(most, len(data) - first)
        code = np.concatenate([code, np.zeros(max(0, n + k - 1 - len(code)), np.int32)])
        number, other = np.zeros(n, np.int32), np.zeros(n, bool)
        plain = not (code > 3).any()
        for j in range(k):
            number *= 4
            number += code[j : j + n] & 3
            if not plain:
                other |= code[j : j + n] > 3
        number[other] = -1
        number[over[first : first + n]] = -2
        yield first, number


def _dense_counts(k: int):
    """kmer (its number), n of all windows of a task; -1 for those with other letters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, other = np.zeros(4**k, np.int64), 0
        for batch in batches:
            for _, number in _windows(pc.fill_null(batch.column(0), ""), k):
                other += int((number == -1).sum())
                number = number[number >= 0]
                if len(number) > len(counts) >> 3:
                    counts += np.bincount(number, minlength=4**k)
                else:
                    at, n = np.unique(number, return_counts=True)
                    counts[at] += n
        at = np.flatnonzero(counts)
        for first in range(0, len(at), 1 << 16):
            part = at[first : first + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"kmer": part, "n": counts[part]})
        yield pa.RecordBatch.from_pydict({"kmer": np.array([-1] * bool(other), np.int64), "n": np.array([other] * bool(other), np.int64)})

    return run


def _both_strands(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            rest, turned = number, np.zeros(len(number), np.int64)
            for _ in range(k):
                turned, rest = turned * 4 + 3 - (rest & 3), rest >> 2
            yield batch
            yield pa.RecordBatch.from_arrays([pa.array(turned), batch.column(1)], ["kmer", "n"])

    return run


def _mask_short(fasta: DataFrame, k: int, ploidy: int) -> DataFrame | None:
    """mask_kmers() for few possible k-mers: each task counts them all, and looks them up in a table of a bit for each.  None if a window has another letter than ACGT."""
    counts = spool(fasta.select("seq").mapInArrow(_dense_counts(k), "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n")), "kmer-counts")
    if counts.where("kmer < 0").limit(1).count():
        unspool(counts)
        return None
    many = counts.mapInArrow(_both_strands(k), "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n")).where(F.col("n") > ploidy).select("kmer")
    uri = spool(many, "kmer-many")._spool_path
    unspool(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as pads

        found = [path for path, _ in files(uri, ".parquet")]
        often = np.zeros(4**k, bool)
        for part in pads.dataset(found, filesystem=filesystem(uri)[0], format="parquet").to_batches(columns=["kmer"]) if found else ():
            often[part.column(0).to_numpy()] = True
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
            chars = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].copy()
            edges = np.zeros(len(chars) + 1, np.int8)
            for first, number in _windows(text, k):
                starts = np.flatnonzero((number >= 0) & often[number]) + first
                # A place is the start of one window and the end of one at most.
                edges[starts] += 1
                edges[starts + k] -= 1
            chars[np.cumsum(edges[:-1], dtype=np.int32) > 0] = ord("N")
            seq = pa.StringArray.from_buffers(len(text), pa.py_buffer(ends - ends[0]), pa.py_buffer(chars))
            yield pa.RecordBatch.from_arrays([batch.column(0), seq], ["name", "seq"])

    return fasta.select(F.col("name").cast("string").alias("name"), "seq").mapInArrow(run, "name string, seq string")


def mask_kmers(fasta: DataFrame, k: int = 19, ploidy: int = 12) -> DataFrame:
    """Bases inside windows whose k-mer is counted more than ploidy times become N.

    All windows are judged on the sequence as given, so the result has no order of
    replacement.  k-mers of up to SHORT letters are counted and looked up as numbers, where
    sequences are of A, C, G and T only; else places are gathered by sequence.
    """
    if k <= SHORT and (short := _mask_short(fasta, k, ploidy)) is not None:
        return short
    many = kmer_counts(fasta, k).where(F.col("n") > ploidy).select("kmer")
    starts = _kmers(fasta, k).join(many, "kmer", "left_semi").groupBy("name").agg(F.collect_list(F.col("i") - 1).alias("_at"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                chars = np.frombuffer((seq or "").encode(), np.uint8).copy()
                edges = np.zeros(len(chars) + 1, np.int64)
                np.add.at(edges, np.array(at or (), np.int64), 1)
                np.add.at(edges, np.array(at or (), np.int64) + k, -1)
                chars[np.cumsum(edges)[:-1] > 0] = ord("N")
                out.append(chars.tobytes().decode())
            yield pa.RecordBatch.from_pydict({"name": batch.column(0), "seq": pa.array(out, pa.string())})

    return fasta.join(starts, "name", "left").select("name", "seq", "_at").mapInArrow(run, "name string, seq string")


def extract_clusters(fasta: DataFrame, clusters: DataFrame, trim: int = 25_000) -> DataFrame:
    """cluster, name, seq of ranges contig|start_end (or whole contigs); long ranges that touch an end lose trim bases there."""
    t = clusters.select("cluster", F.col("contig").alias("item"), F.split("contig", "\\|")[0].alias("name"), F.regexp_extract("contig", "\\|([0-9]+)_([0-9]+)$", 1).alias("_a"), F.regexp_extract("contig", "\\|([0-9]+)_([0-9]+)$", 2).alias("_b"))
    rows = t.join(fasta, "name").withColumn("_n", F.length("seq"))
    rows = rows.withColumn("s", F.when(F.col("_a") == "", F.lit(0)).otherwise(F.col("_a").try_cast("int") - 1)).withColumn("e", F.when(F.col("_b") == "", F.col("_n")).otherwise(F.least(F.col("_b").try_cast("int"), F.col("_n"))))
    ranged = F.col("_a") != ""
    head = ranged & (F.col("e") - F.col("s") > 3 * trim) & (F.col("s") < trim)
    rows = rows.withColumn("s", F.when(head, F.col("s") + trim).otherwise(F.col("s")))
    tail = ranged & (F.col("e") - F.col("s") > 3 * trim) & (F.col("_n") - F.col("e") < trim)
    rows = rows.withColumn("e", F.when(tail, F.col("e") - trim).otherwise(F.col("e")))
    return rows.select("cluster", F.col("item").alias("name"), F.substring(F.col("seq"), F.col("s") + 1, F.greatest(F.lit(0), F.col("e") - F.col("s"))).alias("seq"))


def fold_cigar(cigar: Column) -> Column:
    """Struct of summed lengths by operation (M with = and X), and of clips in front and behind."""
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHPX=])"), 1)
    of = lambda kinds: F.aggregate(F.filter(ops, lambda o: F.substring(o, -1, 1).isin(*kinds)), F.lit(0).cast("long"), lambda s, o: s + F.substring(o, F.lit(1), F.length(o) - 1).cast("long"))
    front = F.coalesce(F.regexp_extract(cigar, "^([0-9]+)[SH]", 1).try_cast("long"), F.lit(0))
    back = F.coalesce(F.regexp_extract(cigar, "[MIDNPX=]([0-9]+)[SH]$", 1).try_cast("long"), F.lit(0))
    return F.struct(of("M=X").alias("m"), of("I").alias("i"), of("D").alias("d"), of("N").alias("n"), of("P").alias("p"), front.alias("front"), back.alias("back"))


def sam_to_paf(sam: DataFrame, sizes_: DataFrame, *, secondary: bool = False) -> DataFrame:
    """PAF rows of SAM records (name, flag, rname, pos 1-based, mapq, cigar, nm, as_score)."""
    rows = sam.where(F.col("flag").bitwiseAND(4) == 0)
    if not secondary:
        rows = rows.where(F.col("flag").bitwiseAND(256) == 0)
    f = rows.withColumn("_c", fold_cigar(F.col("cigar"))).join(sizes_.select(F.col("contig").alias("rname"), F.col("size").alias("target_length")), "rname", "left")
    reverse = F.col("flag").bitwiseAND(16) != 0
    span = F.col("_c.m") + F.col("_c.i")
    length = span + F.col("_c.front") + F.col("_c.back")
    start = F.when(reverse, F.col("_c.back")).otherwise(F.col("_c.front"))
    nm = F.coalesce(F.col("nm"), F.lit(0))
    kind = F.when(F.col("flag").bitwiseAND(256) != 0, "tp:A:S").otherwise("tp:A:P")
    return f.select(
        F.col("name").alias("query"), length.alias("query_length"), start.alias("query_start"), (start + span).alias("query_end"), F.when(reverse, "-").otherwise("+").alias("strand"), F.col("rname").alias("target"), "target_length",
        (F.col("pos") - 1).cast("long").alias("target_start"), (F.col("pos") - 1 + F.col("_c.m") + F.col("_c.d") + F.col("_c.n")).cast("long").alias("target_end"), (F.col("_c.m") - (nm - (F.col("_c.i") + F.col("_c.d")))).alias("matches"),
        (span + F.col("_c.d") + F.col("_c.n") + F.col("_c.p")).alias("aln_length"), "mapq", F.array(F.concat(F.lit("NM:i:"), nm.cast("string")), F.concat(F.lit("AS:i:"), F.coalesce("as_score", F.lit(0)).cast("string")), kind).alias("tags"),
    )


def sam_to_fastq(sam: DataFrame, *, fasta: bool = False) -> DataFrame:
    """Primary records as reads in their first direction."""
    rows = sam.where(F.col("flag").bitwiseAND(0x900) == 0)
    reverse = F.col("flag").bitwiseAND(16) != 0
    seq = F.when(reverse, revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq")
    return rows.select("name", seq) if fasta else rows.select("name", seq, F.when(reverse, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def modify_sequence(fasta: DataFrame, sites: DataFrame, min_frac: float = 0.5) -> DataFrame:
    """Bases at sites (chrom, start, value >= min_frac) that a G or g follows become m."""
    chosen = sites.where(F.col("value") >= F.lit(float(min_frac))).groupBy(F.col("chrom").alias("name")).agg(F.collect_set("start").alias("_at"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                chars = np.frombuffer((seq or "").encode(), np.uint8).copy()
                places = np.array(at or (), np.int64)
                places = places[(places >= 0) & (places < len(chars) - 1)]
                # Judged on the sequence as given.
                chars[places[np.isin(chars[places + 1], (ord("G"), ord("g")))]] = ord("m")
                out.append(chars.tobytes().decode())
            yield pa.RecordBatch.from_pydict({"name": batch.column(0), "seq": pa.array(out, pa.string())})

    return fasta.join(chosen, "name", "left").select("name", "seq", "_at").mapInArrow(run, "name string, seq string")


def pair_reads(pairs: DataFrame, fasta: DataFrame, pieces_cols: tuple[str, str, str, str] = ("start1", "end1", "start2", "end2"), length: int = 0) -> DataFrame:
    """Fragment sequences of both ends of each virtual pair, reverse-complemented on -, cut to length if given."""
    out = pairs
    for k, (a, b) in (("1", pieces_cols[:2]), ("2", pieces_cols[2:])):
        out = out.join(fasta.select(F.col("name").alias(f"chrom{k}"), F.col("seq").alias("_s")), f"chrom{k}")
        part = F.substring(F.col("_s"), (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int"))
        part = F.when(F.col(f"strand{k}") == "-", revcomp(part)).otherwise(part)
        out = out.withColumn(f"seq{k}", F.substring(part, 1, length) if length else part).drop("_s")
    return out
