"""Alignments rescued by their read's other alignments, by methylation, or by alignment anew."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def realign_paf(paf: DataFrame, *, q: int = 1, score_share: float = 1.0, identity_share: float = 0.9, off_anchor_only: bool = False) -> DataFrame:
    """Primary rows of each read, low-mapq ones replaced by the best candidate on the read's anchor.

    paf: read_idx, piece (a primary and its secondaries share it), ordinal, primary, target,
    score, identity, mapq and others.  The anchor is the target of most primaries with
    mapq >= q (smallest name on ties).  Candidates of a low primary: itself if on the anchor,
    and secondaries on the anchor with score >= score_share * its score and identity >=
    identity_share * its identity; the highest score wins, the earliest of equals.  The
    winner's mapq is min(q, 10).
    """
    good = paf.where(F.col("primary") & (F.col("mapq") >= q)).groupBy("read_idx", "target").agg(F.count("*").alias("n"))
    anchor = good.groupBy("read_idx").agg(F.min_by("target", F.struct(-F.col("n"), F.col("target"))).alias("_anchor"))
    first = paf.where("primary").groupBy("read_idx", "piece").agg(*[F.min_by(k, "ordinal").alias(f"_{k}") for k in ("score", "identity", "mapq", "target")])
    t = paf.join(anchor, "read_idx", "left").join(first, ["read_idx", "piece"])
    low = F.col("_anchor").isNotNull() & (F.col("_mapq") < q)
    on = F.col("target") == F.col("_anchor")
    fits = F.col("primary") | ((F.col("score") >= score_share * F.col("_score")) & (F.col("identity") >= identity_share * F.col("_identity")))
    if off_anchor_only:
        fits = fits & (F.col("primary") | (F.col("_target") != F.col("_anchor")))
    candidate = low & on & fits
    rank = Window.partitionBy("read_idx", "piece").orderBy(F.desc("_ok"), F.desc(F.when(F.col("_ok"), F.col("score"))), F.desc(F.when(~F.col("_ok"), F.col("primary"))), "ordinal")
    ranked = t.withColumn("_ok", candidate).where("_ok or primary").withColumn("_r", F.row_number().over(rank))
    out = ranked.where("_r = 1").withColumn("mapq", F.when(F.col("_ok"), F.lit(min(q, 10))).otherwise(F.col("mapq"))).withColumn("primary", F.lit(True))
    return out.select(paf.columns)


def _two_pieces(paf: DataFrame) -> DataFrame:
    return paf.groupBy("read_idx").agg(F.count_distinct("piece").alias("n"), F.min("piece").alias("p1"), F.max("piece").alias("p2")).where("n = 2").drop("n")


def _best_mates(paf: DataFrame, two: DataFrame, scores: DataFrame, alpha: float, beta: float, top: int | None, score_share: float) -> DataFrame:
    """read_idx, value and b, the chosen alternatives of both pieces, for the reads of two."""
    t = paf.join(two, "read_idx")
    if top is None:
        t = t.withColumn("_r", F.col("ordinal"))
    else:
        piece = Window.partitionBy("read_idx", "piece")
        t = t.withColumn("_r", F.row_number().over(piece.orderBy(F.desc("score"), F.desc("primary"), "ordinal"))).withColumn("_best", F.max("score").over(piece))
        t = t.where((F.col("_r") <= top) & (F.col("score") >= score_share * F.col("_best")))
    side = lambda k: t.where(f"piece = p{k}").select("read_idx", F.col(f"p{k}"), F.col("ordinal").alias(f"o{k}"), F.col("target").alias(f"t{k}"), F.col("mapq").alias(f"m{k}"), F.col("_r").alias(f"r{k}"))
    pairs = side(1).join(side(2), "read_idx").withColumn("contig1", F.least("t1", "t2")).withColumn("contig2", F.greatest("t1", "t2")).join(scores, ["contig1", "contig2"], "left")
    value = beta * F.coalesce("score", F.lit(0.0)) + alpha * (F.col("m1") + F.col("m2"))
    order = F.struct(value.alias("v"), (-F.col("r1")).alias("x"), (-F.col("r2")).alias("y"))
    return pairs.groupBy("read_idx").agg(F.max_by(F.struct("p1", "o1", "t1", "p2", "o2", "t2"), order).alias("b"), F.max(value).alias("value"))


def realign_by_contacts(paf: DataFrame, scores: DataFrame, *, alpha: float = 0.05, beta: float = 1.0, top: int | None = 4, score_share: float = 0.95) -> DataFrame:
    """For reads of two pieces, the pair of alternatives with the largest beta * graph score + alpha * (sum of mapq).

    scores: contig1, contig2, score.  Of each piece the top best-scored alternatives count
    that reach score_share of its best score; on ties the better-scored ones, then primaries,
    then the earliest.  top None: all alternatives, the earliest on ties.
    """
    best = _best_mates(paf, _two_pieces(paf), scores, alpha, beta, top, score_share)
    return best.select("read_idx", F.col("b.t1").alias("target1"), F.col("b.t2").alias("target2"), "value")


def realign_reads(paf: DataFrame, scores: DataFrame, *, q: int = 1, alpha: float = 0.05, beta: float = 1.0, top: int = 4, score_share: float = 0.95) -> DataFrame:
    """One row for each piece of every read: reads of two pieces by realign_by_contacts(), others by their anchor.

    Columns as in realign_paf().  Rows chosen by contacts get mapq max(q, 1) where theirs is
    below q.  For the others, secondaries count only where the primary is off the anchor,
    whatever their identity.
    """
    two = _two_pieces(paf)
    best = _best_mates(paf, two, scores, alpha, beta, top, score_share)
    mates = best.select("read_idx", F.explode(F.array(*[F.struct(F.col(f"b.p{k}").alias("piece"), F.col(f"b.o{k}").alias("ordinal")) for k in (1, 2)])).alias("m"))
    paired = paf.join(mates.select("read_idx", "m.piece", "m.ordinal"), ["read_idx", "piece", "ordinal"])
    kind = dict(paf.dtypes)["mapq"]
    paired = paired.withColumn("mapq", F.when(F.col("mapq") < q, F.lit(max(q, 1))).otherwise(F.col("mapq")).cast(kind)).withColumn("primary", F.lit(True))
    rest = realign_paf(paf.join(two, "read_idx", "left_anti"), q=q, score_share=score_share, identity_share=0.0, off_anchor_only=True)
    return paired.select(paf.columns).unionByName(rest.withColumn("mapq", F.col("mapq").cast(kind)))


def methylation_scores(alns: DataFrame, *, match: int = 0, read_penalty: int = 2, ref_penalty: int = 2, mapq: int = 2) -> DataFrame:
    """Groups whose best new score is unique swap their primary and get the mapq.

    new score = score + match * matches - read_penalty * read_missing - ref_penalty *
    ref_missing.  Groups of one, or whose primary has mapq already, stay.
    alns: group, ordinal, primary, score, mapq, matches, read_missing, ref_missing.
    """
    w = Window.partitionBy("group")
    new = F.col("score") + match * F.col("matches") - read_penalty * F.col("read_missing") - ref_penalty * F.col("ref_missing")
    t = alns.withColumn("new_score", new)
    t = t.withColumn("_top", F.max("new_score").over(w)).withColumn("_n", F.count("*").over(w)).withColumn("_own", F.max(F.when(F.col("primary"), F.col("mapq"))).over(w))
    t = t.withColumn("_tops", F.sum(F.when(F.col("new_score") == F.col("_top"), 1).otherwise(0)).over(w))
    change = (F.col("_n") > 1) & (F.col("_own") < mapq) & (F.col("_tops") == 1)
    best = change & (F.col("new_score") == F.col("_top"))
    t = t.withColumn("_primary", F.when(change, best).otherwise(F.col("primary"))).withColumn("_mapq", F.when(best, F.lit(mapq)).when(change, F.lit(0)).otherwise(F.col("mapq")))
    return t.select("group", "ordinal", F.col("_primary").alias("primary"), "score", F.col("_mapq").cast("int").alias("mapq"), "new_score")


def methylated_sites(seq: str, mm: str, ml: list[int], cutoff: int = 128) -> dict[int, bool]:
    """Places of C in the read as sequenced, and whether each is called methylated."""
    places = [i for i, b in enumerate(seq) if b in "Cc"]
    sites = dict.fromkeys(places, False)
    used = 0
    for part in filter(None, mm.rstrip(";").split(";")):
        head, *skips = part.split(",")
        at = -1
        for token in skips:
            asked = token.endswith("?")
            at += int(token.rstrip("?")) + 1
            if head.lower().startswith(("c+m", "c-m")) and at < len(places) and not asked and used < len(ml):
                sites[places[at]] = ml[used] >= cutoff
            used += not asked
    return sites


def consistency(seq: str, cigar: str, start: int, reverse: bool, sites: dict[int, bool], reference: set[int]) -> tuple[int, int, int]:
    """(matches, read_missing, ref_missing) of called and known sites along an alignment of the stored sequence."""
    n = len(seq)
    got = [0, 0, 0]
    q, t = 0, start
    for length, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        length = int(length)
        if op in "M=X":
            for k in range(length):
                place = n - 1 - (q + k) if reverse else q + k
                if place in sites:
                    known = (t + k - 1 if reverse else t + k) in reference
                    if known == sites[place]:
                        got[0] += 1
                    elif known:
                        got[1] += 1
                    else:
                        got[2] += 1
        q += length * (op in "MIS=X")
        t += length * (op in "MDN=X")
    return tuple(got)


def aligned_sites(seq: str, cigar: str, start: int, reverse: bool, mm: str, ml: list[int], cutoff: int = 128) -> list[tuple[int, bool]]:
    """(place in the reference, methylated) of each C of the read as sequenced that lies in an aligned stretch of the stored sequence."""
    n = len(seq)
    read = seq.translate(_COMPLEMENT)[::-1] if reverse else seq
    sites = methylated_sites(read, mm, ml, cutoff)
    if not sites:
        return []
    places = np.fromiter(sites, np.int64, len(sites))
    called = np.fromiter(sites.values(), bool, len(sites))
    places = n - 1 - places if reverse else places
    order = np.argsort(places)
    places, called = places[order], called[order]
    out: list[tuple[int, bool]] = []
    q, t = 0, start - reverse
    for length, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        length = int(length)
        if op in "M=X":
            i, j = np.searchsorted(places, (q, q + length))
            out += zip((places[i:j] - q + t).tolist(), called[i:j].tolist(), strict=True)
        q += length * (op in "MIS=X")
        t += length * (op in "MDN=X")
    return out


def methylation_support(alns: DataFrame, sites: DataFrame, *, cutoff: int = 128) -> DataFrame:
    """alns with matches, read_missing and ref_missing: called sites of each alignment against the known ones.

    alns: group, ordinal (together a key), target, start (0-based), seq, cigar, reverse, mm,
    ml and others.  sites: chrom, start.  Calls are made row by row, found by a join on the
    place, and counted before the shuffle.
    """

    def run(batches):
        for t in batches:
            rows = [
                (g, o, target, place, called)
                for g, o, target, start, seq, cigar, reverse, mm, ml in t.itertuples(index=False)
                for place, called in aligned_sites(seq or "", cigar or "", start, reverse, mm or "", list(ml) if ml is not None else [], cutoff)
            ]
            yield pd.DataFrame(rows, columns=["group", "ordinal", "target", "place", "called"])

    schema = f"group {dict(alns.dtypes)['group']}, ordinal {dict(alns.dtypes)['ordinal']}, target string, place long, called boolean"
    calls = alns.select("group", "ordinal", "target", "start", "seq", "cigar", "reverse", "mm", "ml").mapInPandas(run, schema)
    known = sites.select(F.col("chrom").alias("target"), F.col("start").alias("place")).distinct().withColumn("known", F.lit(True))
    judged = calls.join(known, ["target", "place"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    kinds = (("matches", F.col("known") == F.col("called")), ("read_missing", F.col("known") & ~F.col("called")), ("ref_missing", ~F.col("known") & F.col("called")))
    counts = judged.groupBy("group", "ordinal").agg(*[F.count_if(c).alias(name) for name, c in kinds])
    out = alns.join(counts, ["group", "ordinal"], "left")
    return out.withColumns({name: F.coalesce(name, F.lit(0).cast("long")) for name, _ in kinds})


def methylation_rescue(alns: DataFrame, sites: DataFrame, *, cutoff: int = 128, match: int = 0, read_penalty: int = 2, ref_penalty: int = 2, mapq: int = 2) -> DataFrame:
    """methylation_scores() of methylation_support()."""
    return methylation_scores(methylation_support(alns, sites, cutoff=cutoff), match=match, read_penalty=read_penalty, ref_penalty=ref_penalty, mapq=mapq)


def modified_reads(reads: DataFrame, min_prob: float = 0.75) -> DataFrame:
    """name, seq with modified bases replaced by m where (q + 0.5) / 256 >= min_prob.  reads: name, seq, reverse, mm, ml."""

    def run(batches):
        for t in batches:
            out = []
            for seq, rev, mm, ml in zip(t["seq"], t["reverse"], t["mm"], t["ml"], strict=True):
                s = seq.translate(_COMPLEMENT)[::-1] if rev else seq
                cut = int(np.ceil(min_prob * 256 - 0.5))
                chars = list(s)
                for i, on in methylated_sites(s, mm or "", list(ml) if ml is not None else [], cut).items():
                    if on:
                        chars[i] = "m"
                out.append("".join(chars))
            yield pd.DataFrame({"name": t["name"], "seq": out})

    return reads.select("name", "seq", "reverse", "mm", "ml").mapInPandas(run, "name string, seq string")


def banded_score(a: str, b: str, *, band: int = 5, match: int = 2, mismatch: int = -5, gap_open: int = -2, gap_extend: int = -1) -> int:
    """Best score of a against a stretch of b, affine gaps, in a band around each diagonal that all of b allows."""
    n, m = len(a), len(b)
    low = -(10**9)
    width = max(band, abs(m - n) + band)
    h = np.zeros(m + 1, dtype=np.int64)
    e = np.full(m + 1, low, dtype=np.int64)
    bb = np.frombuffer(b.encode(), dtype=np.uint8)
    columns = np.arange(m + 1)
    for i in range(1, n + 1):
        diag = h[:-1] + np.where(bb == ord(a[i - 1]), match, mismatch)
        e = np.maximum(e, h + gap_open) + gap_extend
        new = np.maximum(np.concatenate([[gap_open + i * gap_extend], diag]), e)
        # Gaps along b: best earlier cell with its opening, less an extension a step.
        lead = np.maximum.accumulate(new + gap_open - columns * gap_extend)
        new[1:] = np.maximum(new[1:], lead[:-1] + columns[1:] * gap_extend)
        new[np.abs(columns - i) > width] = low
        h = new
    return int(h.max())


def banded_scores(pairs: list[tuple[str, str]], *, band: int = 5, match: int = 2, mismatch: int = -5, gap_open: int = -2, gap_extend: int = -1) -> np.ndarray:
    """banded_score() of many pairs (a, b), row by row of all at once."""
    out = np.zeros(len(pairs), np.int64)
    width = np.array([max(band, abs(len(b) - len(a)) + band) for a, b in pairs], np.int64)
    rows = np.array([len(a) for a, _ in pairs], np.int64)
    order = np.lexsort((-rows, np.ceil(np.log(np.maximum(width, 1)) / np.log(1.3))))
    at = 0
    while at < len(order):
        # Bands of about one width, and no more text than fits.
        group, most, widest = [], 0, 0
        while at < len(order) and len(group) < 4096:
            k = int(order[at])
            most, widest = max(most, len(pairs[k][1]), int(rows[k])), max(widest, int(width[k]))
            if group and (width[k] > 1.4 * width[group[0]] + 1 or width[group[0]] > 1.4 * width[k] + 1 or (most + 4 * widest) * (len(group) + 1) > 1 << 25):
                break
            group.append(k)
            at += 1
        group.sort(key=lambda k: -rows[k])
        out[group] = _scores_in_step([pairs[k] for k in group], width[group], match, mismatch, gap_open, gap_extend)
    return out


def _scores_in_step(pairs: list[tuple[str, str]], width: np.ndarray, match: int, mismatch: int, gap_open: int, gap_extend: int) -> np.ndarray:
    """Scores of pairs that come by falling length of a.  Row i holds of each the columns i - w to i + w, where w is the largest width."""
    low, w = -(10**9), int(width.max())
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    wide, many = 2 * w + 1, len(pairs)
    a, b = np.zeros((int(n.max()), many), np.uint8), np.zeros((max(int(m.max()), int(n.max())) + 2 * wide, many), np.uint8)
    for k, (x, y) in enumerate(pairs):
        a[: n[k], k] = np.frombuffer(x.encode("latin-1", "replace"), np.uint8)
        b[w : w + m[k], k] = np.frombuffer(y.encode("latin-1", "replace"), np.uint8)
    d = np.arange(wide)[:, None]
    in_band = np.abs(d - w) <= width
    h = np.where((d >= w) & (d - w <= m), 0, low).astype(np.int32)
    e = np.full((wide, many), low, np.int32)
    # The best gap along b from columns left of the rows held, in steps of d as below.
    left = np.full(many, 2 * low, np.int64)
    step = (d * gap_extend).astype(np.int32)
    out = h.max(axis=0).astype(np.int64)
    active = many
    for i in range(1, int(n.max(initial=0)) + 1):
        if n[active - 1] < i:
            active = int(np.searchsorted(-n, -i, side="right"))
            h, e, left, in_band, m = h[:, :active].copy(), e[:, :active].copy(), left[:active], in_band[:, :active].copy(), m[:active]
        # A column that is left behind goes on downwards only.
        gone = np.maximum(e[0], h[0] + gap_open) + gap_extend
        left = np.maximum(left + 2 * gap_extend, np.where(i - 1 - w >= 0, gone.astype(np.int64) + gap_open + gap_extend, 2 * low))
        new = h + np.where(b[i - 1 : i - 1 + wide, :active] == a[i - 1, :active], np.int32(match), np.int32(mismatch))
        e[:-1] = np.maximum(e[1:], h[1:] + gap_open) + gap_extend
        # The new column has been above the band: a gap from the first row on.
        e[-1] = gap_open + i * gap_extend
        np.maximum(new, e, out=new)
        lead = new - step
        lead += gap_open
        lead[0] = np.maximum(lead[0], left)
        np.maximum.accumulate(lead, axis=0, out=lead)
        lead[:-1] += step[1:]
        np.maximum(new[1:], lead[:-1], out=new[1:])
        new[0] = np.maximum(new[0], left)
        fits = in_band
        if i - w < 0:
            fits = fits & (d >= w - i)
        if i + w > m.min():
            fits = fits & (d - w + i <= m)
        h = np.where(fits, new, np.int32(low))
        done = int(np.searchsorted(-n[:active], -i, side="left"))
        if done < active:
            out[done:active] = h[:, done:].max(axis=0)
    return out


def realign_sequences(reads: DataFrame, *, band: int = 5) -> DataFrame:
    """group, ordinal, score, mapq, primary: candidates scored anew; the best gets mapq 2, others 0; groups with two best drop out.

    reads: group, ordinal, seq, candidate.  A group is one read piece with its few candidates.
    A candidate is aligned whole with a stretch of the read; what the read has around it is free.
    """

    def run(batches):
        for t in batches:
            yield pd.DataFrame({"group": t["group"], "ordinal": t["ordinal"], "score": banded_scores([(b or "", a or "") for a, b in zip(t["seq"], t["candidate"], strict=True)], band=band)})

    scored = reads.select("group", "ordinal", "seq", "candidate").mapInPandas(run, "group long, ordinal long, score long")
    w = Window.partitionBy("group")
    t = scored.withColumn("_top", F.max("score").over(w))
    t = t.withColumn("_tops", F.sum(F.when(F.col("score") == F.col("_top"), 1).otherwise(0)).over(w)).where("_tops = 1")
    best = F.col("score") == F.col("_top")
    return t.select("group", "ordinal", "score", F.when(best, 2).otherwise(0).alias("mapq"), best.alias("primary"))
