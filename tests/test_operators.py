"""Hand-made cases for operators that SQL can't express, and properties."""

import itertools
import random
import struct
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from weftline.functions import intervals, select
from weftline.operators import alleles, clm, contacts, depth, graph, ordering, pairs, prune, rescue, sequences, simulation
from weftline.sources import bam, readers, writers

PAIR = "read_idx long, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, mapq int"


def some_pairs(spark, n=60, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(i, r.choice("ABC"), r.randint(0, 999), r.choice("ABC"), r.randint(0, 999), r.choice("+-"), r.choice("+-"), r.randint(0, 3)) for i in range(n)], PAIR)


def bed(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, end long, name string")


def sizes(spark):
    return spark.createDataFrame([("A", 1000), ("B", 1000), ("C", 1000)], "contig string, size long")


def test_intersect_and_inverse_are_all(spark):
    t = some_pairs(spark)
    b = bed(spark, [("A", 0, 500, "x"), ("A", 400, 700, "y"), ("B", 10, 10, "z"), ("C", 0, 999, "w")])
    one, two = (pairs.intersect_pairs(t, b, q=0, invert=i) for i in (False, True))
    assert one.count() + two.count() == t.count() and one.intersect(two).count() == 0


def test_depth_and_contacts_count_every_pair(spark):
    t = some_pairs(spark)
    assert depth.pair_depth(t, sizes(spark), binsize=300).agg(F.sum("depth")).first()[0] == 120
    assert contacts.count_contacts(t, q=0).agg(F.sum("count")).first()[0] == 60


def test_every_bin_is_listed_without_a_shuffle_of_bins(spark, monkeypatch):
    monkeypatch.setattr(depth, "STRETCH", 7)
    r = random.Random(8)
    lasts = {"a": 0, "b": 6, "c": 7, "d": 40, "e": -1}
    held = {(c, b): r.randint(1, 9) for c, last in lasts.items() for b in [-1, 0, last, last + 1, *r.sample(range(60), 12)]}
    contigs = spark.createDataFrame([(c, 10 * (last + 1), last) for c, last in lasts.items()], "contig string, size long, last long")
    counts = spark.createDataFrame([(*k, v) for k, v in held.items()], "contig string, bin long, value long")
    got = depth.every_bin(contigs, counts)
    assert sorted((x.contig, x.bin, x.value) for x in got.collect()) == [(c, b, held.get((c, b), 0)) for c, last in lasts.items() for b in range(last + 1)]
    # The bins are listed behind the last join.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence(_from") < plan.index("Join")


def test_orientations_add_up(spark):
    t = clm.distance_lists(some_pairs(spark), sizes(spark), max_depth_ratio=None)
    both = {(r.contig1, r.contig2, r.strand1 + r.strand2): r["values"] for r in t.collect()}
    for (a, b, s), v in both.items():
        if s == "++":
            assert all(x + y == 2000 for x, y in zip(v, both[a, b, "--"]))


def test_hot_pair_is_cut_into_chunks(spark, tmp_path):
    """A pair with a third of all rows, in few places: no row holds more than a chunk, lines of the file are whole."""
    r = random.Random(3)
    rows = [(i, "A", r.randint(0, 20), "B", r.randint(0, 20), "+", "+", 5) for i in range(900)] + [(i, r.choice("ABC"), r.randint(0, 999), r.choice("ABC"), r.randint(0, 999), "+", "-", 5) for i in range(1800)]
    t = spark.createDataFrame(rows, PAIR).repartition(5)
    lists = clm.distance_lists(t, sizes(spark), max_depth_ratio=None, chunk=64)
    got = {}
    for x in sorted(lists.collect(), key=lambda x: x.chunk):
        assert len(x["values"]) <= 64 and x.chunk == len(got.get((x.contig1, x.contig2, x.strand1 + x.strand2), [])) // 64
        got.setdefault((x.contig1, x.contig2, x.strand1 + x.strand2), []).extend(x["values"])
    ends = {}
    for _, a, p, b, q, *_ in rows:
        if a != b:
            (a, p), (b, q) = sorted([(a, p), (b, q)])
            ends.setdefault((a, b), []).append((p, q))
    assert got == {(a, b, s): [{"++": 1000 - p + q, "+-": 2000 - p - q, "-+": p + q, "--": p + 1000 - q}[s] for p, q in sorted(v)] for (a, b), v in ends.items() for s in ("++", "+-", "-+", "--")}
    writers.write_clm(lists, f"file://{tmp_path}/clm")
    back = {(x.contig1, x.contig2, x.strand1 + x.strand2): x["values"] for x in readers.read_clm(spark, str(tmp_path / "clm")).collect()}
    assert back == got and max(map(len, got.values())) > 900
    merged = clm.merge_lists(lists, lists.where("contig1 = 'A'"))
    twice = {}
    for x in sorted(merged.collect(), key=lambda x: x.chunk):
        twice.setdefault((x.contig1, x.contig2, x.strand1 + x.strand2), []).extend(x["values"])
        assert x["count"] == len(got[x.contig1, x.contig2, x.strand1 + x.strand2]) * (2 if x.contig1 == "A" else 1)
    assert twice == {k: v + v if k[0] == "A" else v for k, v in got.items()}


def test_virtual_pairs_number(spark):
    rows = [(i % 5, k, "ABC"[k % 3], 10 * k, 10 * k + 7, "+", 5) for i in range(5) for k in range(i + 1)]
    t = spark.createDataFrame(rows, "read_idx long, ordinal int, target string, target_start long, target_end long, strand string, mapq int")
    assert pairs.virtual_pairs(t).count() == sum(n * (n - 1) // 2 for n in range(1, 6))
    assert pairs.virtual_pairs(t, max_order=4).count() == 1 + 3


def test_matching_is_best():
    from itertools import permutations

    r = np.random.default_rng(0)
    for n, m in ((2, 2), (3, 4), (4, 3), (1, 5), (4, 4)):
        w = r.integers(0, 20, (n, m)).astype(float)
        got = sum(w[i, j] for i, j in prune.best_matching(w))
        small, large = (w, m) if n <= m else (w.T, n)
        assert got == max(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(large), len(small)))


def test_kprune(spark):
    a = spark.createDataFrame([("a1", "a2", 1, 9, 9, 8, 0.9), ("a2", "a1", 2, 9, 9, 8, 0.9), ("b1", "b2", 3, 9, 9, 8, 0.9), ("b2", "b1", 4, 9, 9, 8, 0.9)], "contig1 string, contig2 string, ordinal int, mz1 long, mz2 long, mz_shared long, similarity double")
    c = spark.createDataFrame([("a1", "b1", 9.0), ("a2", "b2", 8.0), ("a1", "b2", 2.0), ("a1", "a2", 1.0)], "contig1 string, contig2 string, value double")
    got = {(r.contig1, r.contig2, r.type) for r in prune.kprune(a, c).collect()}
    assert got == {("a1", "a2", 0), ("a1", "b2", 1)}
    w = spark.createDataFrame([("a1",)], "contig string")
    assert prune.kprune(a, c, whitelist=w).count() == 0 and prune.kprune(a, c, whitelist=w, partial_whitelist=True).count() == 2


def test_scores_in_step_equal_single_ones():
    r = random.Random(1)
    dna = lambda n, letters="ACGT": "".join(r.choice(letters) for _ in range(n))
    pairs_ = []
    for _ in range(400):
        b = dna(r.choice((0, 1, 2, 3, 8, 20, 60, 100)))
        a = "".join(c if r.random() > 0.1 else r.choice(("", "A", c + "G")) for c in b) if r.random() < 0.7 else dna(r.choice((0, 1, 5, 40)), "AC")
        pairs_.append((a[r.randrange(4) :], b))
    for options in ({}, {"band": 0}, {"band": 2, "gap_open": -1}, {"gap_extend": -3}):
        assert rescue.banded_scores(pairs_, **options).tolist() == [rescue.banded_score(a, b, **options) for a, b in pairs_]
    start = time.process_time()
    rescue.banded_scores([(dna(300), dna(302)) for _ in range(1000)])
    assert time.process_time() - start < 2  # one after the other it takes over 5 s


def test_pairs_in_clusters_are_dropped_without_a_prune_table(spark, monkeypatch):
    names = ["a", "b", "c", "d", "e", None]
    t = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(itertools.product(names, names))], "read_idx int, chrom1 string, chrom2 string")
    # c is in two clusters, e in none, b twice in one.
    c = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "b"), ("1", "c"), ("2", "c"), ("2", "d"), (None, "a"), (None, "e"), ("2", None)], "cluster string, contig string")
    a, b = c.select("cluster", F.col("contig").alias("contig1")), c.select("cluster", F.col("contig").alias("contig2"))
    prune_ = a.join(b, "cluster").where("contig1 < contig2").select("contig1", "contig2")
    rows = lambda df: sorted(r.read_idx for r in df.select(t.columns).collect())
    for most in (500_000, 0):
        monkeypatch.setattr(pairs, "BROADCAST_CONTIGS", most)
        assert rows(pairs.drop_clustered_ordered(t, c)) == rows(pairs.drop_ordered(t, prune_))
        assert rows(pairs.drop_clustered(t, c)) == rows(pairs.drop_unordered(t, prune_))


def test_small_matchings_equal_large_ones(monkeypatch):
    r = np.random.default_rng(3)
    for _ in range(300):
        w = r.integers(0, 4, (r.integers(1, 7), r.integers(1, 7))).astype(float)
        small = prune.best_matching(w)
        monkeypatch.setattr(prune, "SMALL", 0)
        assert prune.best_matching(w) == small
        monkeypatch.undo()


def test_cells_of_any_best_matching():
    r = random.Random(4)
    for _ in range(300):
        n, m = r.randint(1, 5), r.randint(1, 5)
        w = np.array([[r.choice((0, 0, 1, 2, 3)) for _ in range(m)] for _ in range(n)], dtype=float)
        if n > m:
            ways = [{(i, j) for j, i in enumerate(p)} for p in itertools.permutations(range(n), m)]
        else:
            ways = [set(enumerate(p)) for p in itertools.permutations(range(m), n)]
        totals = [sum(w[c] for c in way) for way in ways]
        wanted = set().union(*[way for way, t in zip(ways, totals) if t == max(totals)])
        assert {(int(i), int(j)) for i, j in zip(*np.nonzero(prune.in_best_matchings(w)))} == wanted
        cells = [(f"a{i}", f"b{j}", float(w[i, j])) for i in range(n) for j in range(m) if w[i, j]]
        assert prune.matched_cells(cells) == {(f"a{i}", f"b{j}") for i, j in wanted if w[i, j]}


def test_kprune_matches_large_groups_once(spark):
    # Two groups of 40: a matrix of 1,600 cells for each of 1,600 pairs would be 2,560,000 rows.
    names = {g: [f"{g}{k:02d}" for k in range(40)] for g in "ab"}
    alleles = [(x, y, 1, 9, 9, 8, 0.9) for g in names.values() for x in g for y in g if x != y]
    a = spark.createDataFrame(alleles, "contig1 string, contig2 string, ordinal int, mz1 long, mz2 long, mz_shared long, similarity double")
    r = random.Random(6)
    w = np.array([[r.random() for _ in range(40)] for _ in range(40)])
    c = spark.createDataFrame([(names["a"][i], names["b"][j], float(w[i, j])) for i in range(40) for j in range(40)], "contig1 string, contig2 string, value double")
    got = {(x.contig1, x.contig2) for x in prune.kprune(a, c).collect()}
    kept = {(names["a"][i], names["b"][j]) for i, j in prune.best_matching(w)}
    assert got == {(x, y) for x in names["a"] for y in names["b"]} - kept
    plan = prune.kprune(a, c)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_components_and_cliques(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (8, 9), (9, 7)], "a long, b long")
    assert {(r.node, r.component) for r in graph.connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7)}
    assert [r.members for r in graph.clique_reads(e).collect()] == [["1", "2", "3"]]


def test_components_of_random_graphs(spark):
    r = random.Random(9)
    for n, m in ((50, 20), (200, 220), (30, 0)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7000, 7000)]
        up = {}

        def top(v):
            while up.setdefault(v, v) != v:
                v = up[v]
            return v

        for a, b in edges:
            x, y = sorted((top(a), top(b)))
            up[y] = x
        got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
        assert got == {v: top(v) for v in up}


def test_mates_stand_at_the_same_places(spark, tmp_path):
    rows = [("same", f"A{k}", "!!", f"C{k}", "??") for k in range(200)] + [(f"n{k}", f"G{k}", "!!", f"T{k}", "??") for k in range(50)]
    writers.write_paired_fastq(spark.createDataFrame(rows, "name string, seq1 string, qual1 string, seq2 string, qual2 string").repartition(7), str(tmp_path / "m"), rows_per_file=30)
    one, two = ([p.read_text().split("\n")[1::4] for p in sorted((tmp_path / f"m_R{k}").glob("part-*"))] for k in (1, 2))
    assert [[x[1:] for x in p] for p in one] == [[x[1:] for x in p] for p in two] and sum(map(len, one)) == 250


def test_order_is_not_worse(spark):
    r = np.random.default_rng(2)
    n = 8
    lengths = r.integers(100, 900, n).astype(float)
    w = np.triu(r.integers(0, 30, (n, n)).astype(float), 1)
    w = w + w.T
    got = ordering.improve_order(lengths, w)
    assert sorted(got) == list(range(n)) and ordering.tour_cost(got, lengths, w) <= ordering.tour_cost(np.arange(n), lengths, w)
    logs = {(0, 1): np.array([[0, 0], [9, 0]]), (1, 2): np.array([[0, 0], [0, 9]])}
    assert ordering.orient(np.array([0, 1, 2]), logs).tolist() == [1, 1, -1]


def test_minimizers_meet_both_strands():
    r = random.Random(5)
    seq = "".join(r.choice("ACGT") for _ in range(400))
    back = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    a, b = (alleles.minimizers(s, 11, 7) for s in (seq, back))
    assert set(a[2].tolist()) == set(b[2].tolist())
    assert alleles.longest_chain([5, 1, 2, 9, 3, 4]) == 4


def test_alleles_find_a_copy(spark):
    r = random.Random(6)
    seq = "".join(r.choice("ACGT") for _ in range(2000))
    mutated = list(seq)
    for k in range(50, 2000, 400):
        mutated[k] = "ACGT"["ACGT".index(mutated[k]) - 1]
    other = "".join(r.choice("ACGT") for _ in range(2000))
    flipped = "".join(mutated).translate(str.maketrans("ACGT", "TGCA"))[::-1]
    t = spark.createDataFrame([("x", seq), ("y", flipped), ("z", other)], "name string, seq string")
    got = {(g.contig1, g.contig2, g.strand) for g in alleles.allele_table(t).collect()}
    assert got == {("x", "y", -1), ("y", "x", -1)}


def test_short_kmers_are_masked_as_long_ones(spark, monkeypatch):
    r = random.Random(12)
    rows = [(f"s{k}", "".join(r.choice("ACGT"[: r.randint(1, 4)]) for _ in range(r.choice((0, 1, 3, 4, 5, 30, 90))))) for k in range(60)] + [("none", None)]
    for extra in ([], [("x", "ACGNNNNNACGTTTNNNN"), ("y", "acgtacgtacgt"), ("z", "\u00e9\u00e9AC")]):
        t = spark.createDataFrame(rows + extra, "name string, seq string").repartition(3)
        for k, ploidy in ((4, 20), (3, 60), (1, 5)):
            got = dict(sequences.mask_kmers(t, k, ploidy).collect())
            assert (sequences._mask_short(t, k, ploidy) is None) == bool(extra)
            monkeypatch.setattr(sequences, "SHORT", 0)
            assert got == dict(sequences.mask_kmers(t, k, ploidy).collect())
            monkeypatch.undo()
    import pyarrow as pa

    text = pa.array(["", "ACGTACGTAC", "AC", "GGGNGGG", "TTTTTTTT"]).slice(1)
    whole = [x.tolist() for _, x in sequences._windows(text, 3)]
    assert [v for _, x in sequences._windows(text, 3, 4) for v in x.tolist()] == sum(whole, [])


def test_similar_contigs_in_shares(spark, monkeypatch):
    r = random.Random(13)
    base = "".join(r.choice("ACGT") for _ in range(400))
    rows = [(f"c{k}", "".join(c if r.random() > 0.01 else "A" for c in base)) for k in range(12)] + [("d", "".join(r.choice("ACGT") for _ in range(300)))]
    sketches = alleles.sketch(spark.createDataFrame(rows, "name string, seq string"), 11, 5)
    wanted = sorted(map(tuple, alleles.similarities(alleles.anchors(sketches), alleles.minimizer_counts(sketches), k=11).collect()))
    assert wanted and sorted(map(tuple, alleles.similar_contigs(sketches, k=11).collect())) == wanted
    made = []
    monkeypatch.setattr(alleles, "ANCHORS", 1000)
    chained = alleles.chains
    monkeypatch.setattr(alleles, "chains", lambda m: chained(made.append(m.count()) or m))
    assert sorted(map(tuple, alleles.similar_contigs(sketches, k=11).collect())) == wanted
    assert len(made) == 8 and sum(made) == alleles.anchors(sketches).count() and max(made) < 0.6 * sum(made)


def test_mask_and_modify(spark):
    t = spark.createDataFrame([("a", "ACGTACGTTT"), ("b", "GGG"), ("c", None)], "name string, seq string")
    got = dict(sequences.mask_kmers(t, 4, 2).collect())
    n = dict(sequences.kmer_counts(t, 4).collect())
    want = list("ACGTACGTTT")
    for i in range(7):
        if n["ACGTACGTTT"[i : i + 4]] > 2:
            want[i : i + 4] = "NNNN"
    assert got["a"] == "".join(want) and got["b"] == "GGG"
    s = spark.createDataFrame([("a", 1, 2, 0.9), ("a", 5, 6, 0.2), ("a", 9, 10, 1.0)], "chrom string, start long, end long, value double")
    assert dict(sequences.modify_sequence(t, s).collect())["a"] == "AmGTACGTTT"


def test_long_sequence_windows(spark):
    r = random.Random(3)
    seq = "".join(r.choice("ACGT") for _ in range(9000))
    t = spark.createDataFrame([("a", seq)], "name string, seq string")
    assert {x.start for x in sequences.digest(t, "GATC", 0).collect()} == {i + 2 for i in range(len(seq)) if seq[i : i + 4] == "GATC"}
    assert sequences.kmer_counts(t, 5).agg(F.sum("n")).first()[0] == 2 * (9000 - 4)
    cut = sequences.cut_reads(spark.createDataFrame([("r", seq, seq)], "name string, seq string, qual string")).orderBy("piece").collect()
    assert "".join(x.seq for x in cut) == seq and all(x.seq == x.qual for x in cut)


def test_methylated_sites():
    assert rescue.methylated_sites("ACGCC", "C+m,1,0;", [200, 10]) == {1: False, 3: True, 4: False}
    assert rescue.consistency("ACGCC", "5M", 100, False, {1: False, 3: True, 4: False}, {103, 104}) == (2, 1, 0)


def test_banded_score():
    assert rescue.banded_score("ACGTACGT", "TTACGTACGTTT") == 16
    assert rescue.banded_score("ACGTTACGT", "ACGTACGT") < 16


def test_realign_takes_the_anchor(spark):
    schema = "read_idx long, piece int, ordinal int, primary boolean, target string, score long, identity double, mapq int"
    rows = [(1, 1, 1, True, "X", 90, 0.99, 30), (1, 2, 1, True, "X", 80, 0.99, 20), (1, 3, 1, True, "Y", 70, 0.99, 0), (1, 3, 2, False, "X", 70, 0.95, 0), (1, 3, 3, False, "X", 60, 0.99, 0), (2, 1, 1, True, "Z", 5, 0.9, 0)]
    got = {(r.read_idx, r.piece): (r.target, r.mapq) for r in rescue.realign_paf(spark.createDataFrame(rows, schema), q=1).collect()}
    assert got == {(1, 1): ("X", 30), (1, 2): ("X", 20), (1, 3): ("X", 1), (2, 1): ("Z", 0)}


def test_candidates_are_aligned_whole(spark):
    """A read longer than its candidate loses nothing; a candidate longer than the read pays a gap."""
    rows = [(1, 1, "TTACGTACGTTT", "ACGTACGT"), (1, 2, "TTACGTACGTTT", "GACGTACGTC"), (2, 1, "ACGT", "ACGT"), (2, 2, "ACGT", "ACGT")]
    got = {(r.group, r.ordinal): (r.score, r.mapq, r.primary) for r in rescue.realign_sequences(spark.createDataFrame(rows, "group long, ordinal long, seq string, candidate string")).collect()}
    assert set(got) == {(1, 1), (1, 2)}
    assert got[1, 1] == (16, 2, True) and got[1, 2][0] < 16 and got[1, 2][1:] == (0, False)


def test_realign_reads_keeps_every_read(spark):
    """Two pieces go by contacts, among alternatives near the best score; other reads go by their anchor."""
    schema = "read_idx long, piece int, ordinal int, primary boolean, target string, score long, identity double, mapq int"
    rows = [
        (1, 1, 1, True, "A", 100, 0.9, 0), (1, 1, 2, False, "B", 96, 0.5, 0), (1, 1, 3, False, "C", 90, 0.9, 0), (1, 2, 1, True, "D", 50, 0.9, 9),
        (2, 1, 1, True, "A", 100, 0.9, 0),
        (3, 1, 1, True, "X", 90, 0.9, 30), (3, 2, 1, True, "X", 90, 0.9, 30), (3, 3, 1, True, "Y", 100, 0.9, 0), (3, 3, 2, False, "X", 95, 0.1, 0),
        (4, 1, 1, True, "X", 90, 0.9, 30), (4, 2, 1, True, "X", 90, 0.9, 0), (4, 3, 1, True, "Y", 100, 0.9, 0), (4, 3, 2, False, "X", 94, 0.9, 0),
    ]
    scores = spark.createDataFrame([("B", "D", 5.0), ("C", "D", 9.0)], "contig1 string, contig2 string, score double")
    got = {(r.read_idx, r.piece): (r.target, r.mapq) for r in rescue.realign_reads(spark.createDataFrame(rows, schema), scores, q=3).collect()}
    assert got == {(1, 1): ("B", 3), (1, 2): ("D", 9), (2, 1): ("A", 0), (3, 1): ("X", 30), (3, 2): ("X", 30), (3, 3): ("X", 3), (4, 1): ("X", 30), (4, 2): ("X", 3), (4, 3): ("Y", 0)}


def test_variants(spark):
    fa = spark.createDataFrame([("c", "AAAACCCCGGGG")], "name string, seq string")
    v = spark.createDataFrame([("c", 2, "A", "T"), ("c", 5, "CC", "G"), ("c", 6, "C", "A"), ("c", 12, "G", "T")], "chrom string, pos long, ref string, alt string")
    f = spark.createDataFrame([("f", "c", 1, 10)], "fragment string, chrom string, start long, end long")
    assert simulation.with_variants(f, fa, v).first().seq == "TAAGCCGG"


def test_split_reads_keep_all_bases(spark):
    seq = "ACGT" * 2500
    got = simulation.split_reads(spark.createDataFrame([("r", seq), ("s", "ACG")], "name string, seq string")).collect()
    assert "".join(x.seq for x in sorted(got, key=lambda x: int(x.name.split("_")[1]))) == seq
    assert len(got) > 1 and all(len(x.seq) > 500 for x in got)


def test_text_formats(spark, tmp_path):
    p = tmp_path / "a.paf"
    p.write_text("q\t100\t0\t90\t+\tt\t1000\t5\t95\t80\t90\t60\ttp:A:P\tNM:i:3\nq\t100\t0\t90\t-\tu\t1000\t5\t95\t80\t90\t0\ttp:A:S\nbad\tline\n")
    assert [r.target for r in readers.read_paf(spark, str(p)).collect()] == ["t"]
    assert readers.read_paf(spark, str(p), secondary=True).count() == 2
    p = tmp_path / "a.pairs"
    p.write_text("## pairs format v1.0\n#chromsize: A 1000\n#columns: readID chrom1\n1\tA\t5\tB\t6\t+\t-\n2\tA\t5\tB\t6\t+\t-\t7\n")
    assert sorted(r.mapq for r in readers.read_pairs(spark, str(p)).collect()) == [7, 60]
    assert [tuple(r) for r in readers.read_pairs_sizes(spark, str(p)).collect()] == [("A", 1000)]
    p = tmp_path / "a.fa"
    p.write_text(">a one\nACGT\nAC\n>b\nGG\n")
    assert sorted(map(tuple, readers.read_fasta(spark, str(p)).collect())) == [("a one", "ACGTAC"), ("b", "GG")]
    p = tmp_path / "a.fq"
    p.write_text("@r1 x\nACGT\n+\n!!!!\n@r2\nGG\n+\n##\n")
    assert [tuple(r) for r in readers.read_fastq(spark, str(p)).collect()] == [("r1", "ACGT", "!!!!"), ("r2", "GG", "##")]
    p = tmp_path / "c.txt"
    p.write_text("g1\t2\tA B\ng2\t1\tC\n")
    assert sorted(map(tuple, readers.read_clusters(spark, str(p)).collect())) == [("g1", "A"), ("g1", "B"), ("g2", "C")]
    p = tmp_path / "a.sam"
    p.write_text("@HD\tVN:1\nr\t16\tt\t5\t30\t2S4M\t*\t0\t0\tACGTAC\t!!!!!!\tNM:i:1\tAS:i:8\n")
    assert [(r.nm, r.as_score, r.mm) for r in readers.read_sam(spark, str(p)).collect()] == [(1, 8, None)]


def test_clm_round_trip(spark, tmp_path):
    t = clm.distance_lists(some_pairs(spark), sizes(spark), max_depth_ratio=None)
    writers.write_clm(t, str(tmp_path / "clm"))
    key = lambda x: sorted((r.contig1, r.strand1, r.contig2, r.strand2, r["count"], tuple(r["values"])) for r in x.collect())
    assert key(readers.read_clm(spark, str(tmp_path / "clm"))) == key(t)


def test_pqs_and_pairs_round_trip(spark, tmp_path):
    t = some_pairs(spark).withColumn("read_idx", F.col("read_idx").cast("string"))
    writers.write_pqs(t, sizes(spark), str(tmp_path / "pqs"))
    assert readers.read_pqs(spark, str(tmp_path / "pqs")).count() == 60
    assert readers.read_pqs(spark, str(tmp_path / "pqs"), min_mapq=2).count() == t.where("mapq >= 2").count()
    writers.write_pairs(t, sizes(spark), str(tmp_path / "txt"))
    key = lambda x: sorted(tuple(map(str, r)) for r in x.collect())
    assert key(readers.read_pairs(spark, str(tmp_path / "txt" / "rows"))) == key(t)


def _bam(path, rows, block=50):
    body = b"BAM\1" + struct.pack("<i", 4) + b"@HD\t" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"t\0" + struct.pack("<i", 1000)
    for name, flag, pos, seq in rows:
        packed = bytes((bam.BASES.index(a) << 4) | (bam.BASES.index(b) if b else 0) for a, b in zip(seq[::2], list(seq[1::2]) + [None] * (len(seq) % 2)))
        d = struct.pack("<iiBBHHHiiii", 0, pos - 1, len(name) + 1, 30, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes([20] * len(seq)) + b"NMi" + struct.pack("<i", 2) + b"MLBC" + struct.pack("<I2B", 2, 7, 9)
        body += struct.pack("<i", len(d)) + d
    out = b""
    for k in range(0, len(body), block):
        part = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = part.compress(body[k : k + block]) + part.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(body[k : k + block]), len(body[k : k + block]))
    path.write_bytes(out)


def test_bam_source(spark, tmp_path):
    _bam(tmp_path / "a.bam", [("r1", 0, 5, "ACGTA"), ("r2", 16, 9, "GG")])
    spark.dataSource.register(bam.BamSource)
    got = spark.read.format("bam_records").load(str(tmp_path / "a.bam")).orderBy("name").collect()
    assert [(r.name, r.flag, r.rname, r.pos, r.cigar, r.seq, r.qual, r.tags) for r in got] == [("r1", 0, "t", 5, "5M", "ACGTA", "55555", {"NM": "2", "ML": "C,7,9"}), ("r2", 16, "t", 9, "2M", "GG", "55", {"NM": "2", "ML": "C,7,9"})]


def test_stream_of_pairs(spark, tmp_path):
    from weftline.streaming.counts import stream_contacts

    t = some_pairs(spark)
    t.where("read_idx < 30").write.parquet(str(tmp_path / "in"))
    t.where("read_idx >= 30").write.mode("append").parquet(str(tmp_path / "in"))
    s = stream_contacts(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), q=0)
    run = s.writeStream.outputMode("complete").format("memory").queryName("running").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, contacts.count_contacts(t, q=0).collect()))


def test_bam_ranges(spark, tmp_path):
    """Every record is read once, whatever the ranges; records may go over blocks and ranges."""
    r = random.Random(11)
    rows = [(f"read{i}", r.choice((0, 16, 4)), r.randint(1, 900), "".join(r.choice("ACGT") for _ in range(r.choice((3, 40, 700, 5000))))) for i in range(200)]
    _bam(tmp_path / "a.bam", rows, block=2000)
    spark.dataSource.register(bam.BamSource)
    for split in (1 << 30, 20_000, 1_500):
        t = spark.read.format("bam_records").option("split_bytes", split).load(str(tmp_path / "a.bam"))
        assert sorted((x.name, x.pos, x.seq) for x in t.select("name", "pos", "seq").collect()) == sorted((n, p, q) for n, _, p, q in rows)
        assert split > 1 << 20 or t.rdd.getNumPartitions() > 5
    got = readers.with_modifications(t).select("reverse", "ml").distinct().collect()
    assert {(x.reverse, tuple(x.ml)) for x in got} == {(False, (7, 9)), (True, (7, 9))}


def test_fastq_of_many_splits(spark, tmp_path):
    """Plain files cut anywhere, gzip files, quality lines that begin with @, CRLF and bare headers."""
    import gzip

    r = random.Random(5)
    reads = [(f"r{i}", "".join(r.choice("ACGT") for _ in range(r.randint(1, 90)))) for i in range(2000)]
    text = "".join(f"@{n} x\n{q}\n+\n{'@' * len(q)}\n" for n, q in reads)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "in" / "b.fastq.gz", "wt") as f:
        f.write(text.replace("@r", "@z"))
    (tmp_path / "in" / "c.fastq").write_bytes(b"@\r\nAC\r\n+\r\n!!\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = sorted(map(tuple, readers.read_fastq(spark, str(tmp_path / "in")).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("", "AC", "!!")] + [(a + n[1:], q, "@" * len(q)) for n, q in reads for a in "rz"])


def test_bam_pairs_order(spark):
    """Along the read as sequenced, clips of a reverse record counted from its end; ends swap with their strands."""
    rows = [("q", 0, "B", 50, 9, "10S20M70H"), ("q", 16, "A", 5, 7, "60S30M10S"), ("q", 2048, "B", 40, 8, "40H20M5I35S"), ("q", 256, "A", 1, 9, "100M"), ("q", 0, "A", 1, 0, "100M"), ("one", 0, "A", 1, 9, "10M")]
    t = spark.createDataFrame(rows, "name string, flag int, rname string, pos long, mapq int, cigar string")
    got = sorted(tuple(r) for r in pairs.bam_pairs(t, q=1).collect())
    assert got == [("q", "A", 5, "B", 40, "-", "+", 7), ("q", "A", 5, "B", 50, "-", "+", 7), ("q", "B", 40, "B", 50, "+", "+", 8)]


def test_methylation_support_is_consistency(spark):
    r = random.Random(8)
    rows, sites = [], {p for p in range(0, 400) if r.random() < 0.4}
    for i in range(40):
        seq = "".join(r.choice("ACGT") for _ in range(r.randint(1, 80)))
        cigar = f"{len(seq)}M" if len(seq) < 9 else f"3S{len(seq) - 8}M2I1D3M"
        rows.append((i // 2, i % 2, i % 2 == 0, 50, 0, "t", r.randint(0, 300), seq, cigar, r.random() < 0.5, "C+m,1,0,2;A+a,0;", [r.choice((10, 250)) for _ in range(4)]))
    t = spark.createDataFrame(rows, "group long, ordinal long, primary boolean, score long, mapq int, target string, start long, seq string, cigar string, reverse boolean, mm string, ml array<int>")
    s = spark.createDataFrame([("t", p) for p in sites] + [("u", 1), ("t", 7), ("t", 7)], "chrom string, start long")
    got = {(x.group, x.ordinal): (x.matches, x.read_missing, x.ref_missing) for x in rescue.methylation_support(t, s).collect()}
    for g, o, _, _, _, _, start, seq, cigar, reverse, mm, ml in rows:
        read = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1] if reverse else seq
        assert got[g, o] == rescue.consistency(seq, cigar, start, reverse, rescue.methylated_sites(read, mm, ml), sites | {7})
    assert rescue.methylation_rescue(t, s, match=1).count() == 40


def test_large_samples_are_the_same(spark, monkeypatch):
    t = some_pairs(spark, 300, 4)
    small = {n: sorted(map(tuple, pairs.sample_number(t, n).collect())) for n in (1, 77, 299, 300, 500)}
    monkeypatch.setattr(select, "FEW", 0)
    assert {n: sorted(map(tuple, pairs.sample_number(t, n).collect())) for n in small} == small


def test_selection_by_digits(spark, monkeypatch):
    """Exactly n rows at any n, with rows that repeat; shares far below a millionth; reads up to a number of pairs."""
    monkeypatch.setattr(select, "FEW", 5)
    monkeypatch.setattr(select, "DIGIT", 7)
    t = some_pairs(spark, 200, 6)
    t = t.union(t.limit(1).crossJoin(spark.range(150).select())).repartition(5).cache()
    whole = sorted(map(tuple, t.collect()))
    for n in (0, 1, 6, 100, 180, 349, 350, 999):
        got = sorted(map(tuple, pairs.sample_number(t, n).collect()))
        assert len(got) == min(n, 350)
        assert not [x for x in got if got.count(x) > whole.count(x)]
    drawn = t.select(select.wide_draw(3, F.col("read_idx")).alias("d")).collect()
    assert all(0 <= x.d < 1 << 60 for x in drawn) and len({x.d for x in drawn}) == 200
    many = spark.range(400_000).select(F.col("id").alias("read_idx"), F.lit(1).alias("pos1"), F.lit(1).alias("pos2"), F.lit(9).alias("mapq"))
    assert abs(pairs.sample_fraction(many, 1e-4).count() - 40) < 35 and pairs.sample_fraction(many, 1e-12).count() == 0
    least = many.agg(F.min(pairs._pair_draw(42)).alias("m")).first().m
    assert pairs.sample_fraction(many, (least + 1024) / 2**60).count() == 1 and (least / 2**60) < 1e-4
    pieces = spark.createDataFrame([(i, k, "A", 0, 9, "+", 5) for i in range(60) for k in range(i % 6)], "read_idx long, ordinal int, target string, target_start long, target_end long, strand string, mapq int")
    order = sorted((x.d, x.read_idx) for x in pieces.select("read_idx", select.wide_draw(42, F.col("read_idx")).alias("d")).distinct().collect() if x.read_idx % 6 > 1)
    for target in (0, 1, 17, 60, 10**6):
        before, want = 0, set()
        for _, i in order:
            if before < target:
                want.add(i)
            before += (i % 6) * (i % 6 - 1) // 2
        assert {x.read_idx for x in pairs.sample_reads(pieces, target=target).collect()} == want


def test_methods_of_normalisation(spark):
    import pytest

    c = spark.createDataFrame([("a", "a", 5), ("a", "b", 2)], "contig1 string, contig2 string, count long")
    assert {r.value for r in contacts.normalize(c, "cis_unique").collect()} == {0.0}
    with pytest.raises(ValueError):
        contacts.normalize(c, "nothing of the kind")


def test_long_component(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(150)], "a long, b long")
    assert {r.component for r in graph.connected_components(e).collect()} == {0}


def test_segments_over_cells(spark, monkeypatch):
    """Intervals longer than cells, nested, equal and empty ones: each place belongs to the interval that starts first."""
    monkeypatch.setattr(intervals, "CELL", 64)
    r = random.Random(9)
    rows = [(r.choice("AB"), a, a + r.choice((0, 1, 5, 40, 300)), f"n{i}") for i, a in enumerate(r.randint(0, 900) for _ in range(80))]
    rows += [rows[0], ("A", 0, 700, "long"), ("C", 5, 5, "none")]
    got = {}
    for x in intervals.disjoint(bed(spark, rows)).collect():
        for p in range(x.seg_start, x.seg_end):
            assert (x.chrom, p) not in got
            got[x.chrom, p] = x.name
    want = {}
    for c, a, b, n in sorted(rows):
        for p in range(a, b):
            want.setdefault((c, p), n)
    assert got == want
    pieces = spark.createDataFrame([(i, r.choice("ABCD"), a, a + r.randint(0, 60)) for i, a in enumerate(r.randint(0, 1300) for _ in range(150))], "i int, chrom string, start long, end long")
    touched = {x.i for x in pieces.collect() if any((x.chrom, p) in want for p in range(x.start, x.end))}
    segments = intervals.disjoint(bed(spark, rows))
    one, two = ([x.i for x in intervals.overlap_filter(pieces.where("start < end"), segments, "chrom", "start", "end", invert=v, width=32).collect()] for v in (False, True))
    assert sorted(one) == sorted(touched) and sorted(one + two) == [x.i for x in pieces.where("start < end").orderBy("i").collect()]


def test_virtual_pairs_of_large_reads_and_none(spark):
    rows = [(1, k, "A", k, k + 2, "+", 5) for k in range(500)] + [(None, k, "A", k, k + 2, "+", 5) for k in range(3)] + [(2, k, "B", k, k + 2, "+", 5) for k in range(3)] + [(3, 0, "B", 1, 2, "+", 5)]
    t = spark.createDataFrame(rows, "read_idx long, ordinal int, target string, target_start long, target_end long, strand string, mapq int")
    assert [x.read_idx for x in pairs.virtual_pairs(t).collect()] == [2, 2, 2]
    assert pairs.virtual_pairs(t, max_order=501).count() == 500 * 499 // 2 + 3


def test_evolution_never_loses():
    from itertools import permutations

    r = np.random.default_rng(4)
    for n in (0, 1, 2, 6):
        lengths = r.integers(100, 900, n).astype(float)
        w = np.triu(r.integers(0, 30, (n, n)).astype(float), 1)
        w = w + w.T
        got = ordering.improve_order(lengths, w, generations=150)
        assert sorted(got.tolist()) == list(range(n))
        if n == 6:
            best = min(ordering.tour_cost(np.array(p), lengths, w) for p in permutations(range(n)))
            assert abs(ordering.tour_cost(got, lengths, w) - best) < 1e-9
            cost = lambda o: ordering.tour_cost(o, lengths, w)
            out = ordering.evolve(np.arange(n), cost, r, rate=0.5, population=2, stale=5)
            assert sorted(out.tolist()) == list(range(n)) and cost(out) <= cost(np.arange(n))
    assert ordering.greedy_chain(4, (np.array([0, 2]), np.array([3, 3]), np.array([5.0, 1.0]))).tolist() == [2, 3, 0, 1]
