"""Graphs of fragments and contigs: components, cliques, ordering fitness."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.scratch import spool, unspool


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b), hung to lesser nodes.  large: the greater neighbours of each node go to its least one; else its lesser ones do, and itself."""
    if large:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = sides.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b).

    Links are hung to lesser nodes until each node has one link, to the least of its
    component.  Their number falls to that of the nodes on the way, links that are done
    among them; each round's links are a written table, and the one before is deleted.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).where("node is not null").distinct()
    now = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-links")
    mark = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    before = now.agg(*mark).first()
    while before[0]:
        after = spool(_star(_star(now, True), False), "component-links")
        found = after.agg(*mark).first()
        unspool(now)
        now = after
        if found == before:
            break
        before = found
    return nodes.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def peel(edges: DataFrame, *, slack: float = 0.5) -> DataFrame:
    """node, level: the round in which a node goes when all nodes of at most (1 + slack) times the mean degree go at once, again and again.

    Of each round's nodes a share of slack / (1 + slack) goes at least, so the rounds are a
    logarithm of the nodes.  A node has at most 2 (1 + slack) times the degeneracy neighbours
    of its own or a later level.
    """
    live = spool(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "peel-edges")
    nodes = spool(live.select(F.col("a").alias("node")).distinct(), "peel-nodes")
    levels = []
    while True:
        degrees = spool(live.groupBy("a").agg(F.count("*").alias("n")), "peel-degrees")
        n, links = degrees.agg(F.count("*"), F.sum("n")).first()
        if not n:
            break
        gone = spool(degrees.where(F.col("n") <= links / n * (1 + slack)).select(F.col("a").alias("node"), F.lit(len(levels)).alias("level")), "peeled")
        rest = live.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti")
        rest = spool(rest.select("a", "b"), "peel-edges")
        unspool(live, degrees)
        levels.append(gone)
        live = rest
    known = nodes.select("node", F.lit(0).alias("level")).limit(0)
    for gone in levels:
        known = known.union(gone)
    # A node whose neighbours have all gone before it comes last; no two of these are neighbours.
    return nodes.join(known, "node", "left").select("node", F.coalesce("level", F.lit(len(levels))).alias("level"))


def _maximal(inside: dict[int, int], outside: list[int]) -> Iterator[int]:
    """Maximal cliques as bits: Bron and Kerbosch with a pivot, on an explicit stack.

    inside: bits of the neighbours of each node.  outside: bits of the nodes that someone
    from outside knows; a clique that lies in one of them isn't maximal.
    """
    stack = [(0, sum(1 << v for v in inside), 0, outside)]
    while stack:
        r, p, x, out = stack.pop()
        if any(not p & ~m for m in out):
            continue  # someone from outside knows all that is left
        if not p:
            if not x:
                yield r
            continue
        both, best, left = p | x, -1, p
        while both:
            v = (both & -both).bit_length() - 1
            both &= both - 1
            n = (p & inside[v]).bit_count()
            if n > best:
                best, left = n, p & ~inside[v]
        for m in out:
            if (p & m).bit_count() > best:
                best, left = (p & m).bit_count(), p & ~m
        while left:
            bit = left & -left
            v = bit.bit_length() - 1
            left ^= bit
            near = inside[v]
            stack.append((r | bit, p & near, x & near, list({m & near for m in out if m & bit})))
            p ^= bit
            x |= bit


def _group_cliques(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maximal cliques whose first node is each key.  Rows (node, with, common), in order of node: a later neighbour and
    their common later neighbours, or (with null) those that an earlier neighbour has in common with the node."""
    at, inner, outer = None, [], []
    found: list[list[str]] = []

    def close() -> None:
        if not inner:
            return
        names = sorted({a for a, _ in inner} | {b for _, common in inner for b in common})
        number = {name: k for k, name in enumerate(names)}
        inside = dict.fromkeys(range(len(names)), 0)
        for a, common in inner:
            for b in common:
                inside[number[a]] |= 1 << number[b]
                inside[number[b]] |= 1 << number[a]
        outside = {sum(1 << number[b] for b in common if b in number) for common in outer}
        for bits in _maximal(inside, list(outside)):
            found.append(sorted([at, *[names[k] for k in range(len(names)) if bits >> k & 1]]))

    def table() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["members"])
        found.clear()
        return out

    for batch in batches:
        for node, other, common in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != at:
                close()
                at, inner, outer = node, [], []
            if other is None:
                outer.append(common)
            else:
                inner.append((other, common))
            if len(found) > 10_000:
                yield table()
    close()
    yield table()


def maximal_cliques(edges: DataFrame, *, min_size: int = 3) -> DataFrame:
    """members (sorted) of every maximal clique of edges (a, b) of min_size nodes or more (2 at least), in graphs of any size.

    Nodes are ordered by peel(), edges go from earlier to later, and each clique belongs to
    its first node: it is that node and a clique of its later neighbours, of which there
    are few in any graph but a dense one.  For each edge its ends' common later neighbours
    are worked out by joins; they tell both how the later neighbours of the first end hang
    together and what an earlier neighbour of the second one knows, which is all that is
    needed to tell whether a clique is maximal.  A task holds the later neighbours of one
    node, never a component, and nothing is left out.
    """
    pairs = spool(edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).where("a <> b").distinct(), "clique-edges")
    levels = spool(peel(pairs), "clique-levels")
    named = lambda k: levels.select(F.col("node").alias(k), F.col("level").alias(f"l{k}"))
    directed = pairs.join(named("a"), "a").join(named("b"), "b")
    first = (F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))
    directed = spool(directed.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b")).distinct(), "clique-directed")
    later = spool(directed.groupBy("a").agg(F.collect_list("b").alias("later")), "clique-later")
    common = F.array_intersect("_la", "_lb")
    rows = directed.join(later.select("a", F.col("later").alias("_la")), "a").join(later.select(F.col("a").alias("b"), F.col("later").alias("_lb")), "b", "left")
    rows = spool(rows.select("a", "b", F.array_sort(F.coalesce(common, F.array().cast("array<string>"))).alias("common")), "clique-common")
    triangles = rows.where(F.size("common") > 0)
    inner = triangles.select(F.col("a").alias("node"), F.col("b").alias("with"), "common")
    outer = triangles.select(F.col("b").alias("node"), F.lit(None).cast("string").alias("with"), "common").distinct()
    grouped = inner.unionByName(outer).repartition("node").sortWithinPartitions("node")
    found = grouped.mapInArrow(_group_cliques, "members array<string>")
    if min_size <= 2:
        # An edge is maximal if it is in no triangle, as its first side, its middle or its last.
        sides = triangles.select("a", "b", F.explode("common").alias("c"))
        held = triangles.select("a", "b").union(sides.select("a", "c")).union(sides.select("b", "c")).distinct()
        found = found.union(directed.join(held, ["a", "b"], "left_anti").select(F.array_sort(F.array("a", "b")).alias("members")))
    out = spool(found.where(F.size("members") >= min_size), "cliques")
    unspool(pairs, levels, directed, later, rows)
    return out


def clique_reads(edges: DataFrame, *, min_size: int = 3) -> DataFrame:
    """component, number (0, 1 ... in the order of all components), clique (0, 1 ... in its component) and members: maximal cliques as virtual reads."""
    text = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).where("a <> b")
    cliques = maximal_cliques(text, min_size=min_size)
    home = spool(connected_components(text).select(F.col("node").alias("_node"), "component"), "clique-homes")
    numbers = ranked(home.select("component").distinct(), ["component"], "number", name="clique-numbers")
    rows = cliques.withColumn("_node", F.get("members", F.lit(0))).join(home, "_node").select("component", "members")
    placed = ranked(rows, ["component", "members"], "_place", name="clique-reads")
    first = spool(placed.groupBy("component").agg(F.min("_place").alias("_first")).join(numbers, "component"), "clique-firsts")
    return placed.join(first, "component").select("component", "number", (F.col("_place") - F.col("_first")).alias("clique"), "members")


def clique_lines(reads: DataFrame) -> DataFrame:
    """value: a line for each of clique_reads(), its name v_read_comp<number>_cl<clique> and its members, separated by tabs."""
    name = F.concat(F.lit("v_read_comp"), F.col("number").cast("string"), F.lit("_cl"), F.col("clique").cast("string"))
    return reads.select(F.concat_ws("\t", name, F.array_join("members", "\t")).alias("value"))


def fitness(tours: DataFrame, sizes: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, fitness: sum over edges of weight * ln(distance of mid-points + 1), times 1e6, cut to an integer.

    tours: cluster, place, contig.  edges: contig1, contig2, count.
    """
    t = tours.join(sizes, "contig")
    w = Window.partitionBy("cluster").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    mids = t.select("cluster", "contig", (F.coalesce(F.sum("size").over(w), F.lit(0)) + F.col("size") / 2).alias("mid"))
    a = mids.select("cluster", F.col("contig").alias("contig1"), F.col("mid").alias("m1"))
    b = mids.select("cluster", F.col("contig").alias("contig2"), F.col("mid").alias("m2"))
    inner = edges.where("contig1 <> contig2").join(a, "contig1").join(b, ["cluster", "contig2"])
    cost = F.col("count") * F.log(F.abs(F.col("m1") - F.col("m2")) + 1)
    return inner.groupBy("cluster").agg(F.floor(F.sum(cost) * 1e6).cast("long").alias("fitness"))
