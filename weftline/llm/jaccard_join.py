"""N-gram Jaccard join by T-occurrence search with DivideSkip, and its components.

Two documents link when their sets of word shingles have a Jaccard similarity of t
or more.  No link is lost and no group of copies is expanded into pairs:

1. Each text becomes its set of shingle hashes.  Documents with equal sets are one
   class, stood for by its smallest id.
2. Of a set of n, the n - ceil(t n) + k smallest hashes are its prefix, k = ceil(n / 10).
   Linked sets share the first k of their common hashes inside both prefixes, so a
   document with too few prefix hashes that occur elsewhere has no links.  Hashes
   are counted (aggregated before the shuffle) and joined back.
3. First search: MinHash bands name a pivot for groups of likely copies, the smallest
   id with the band, and each document is searched for in a block that holds its
   pivots.  The links make first components, which take in nearly all of a large
   group of near copies through stars instead of pairs.
4. Second search, between different components only.  Documents with too few hashes
   in other components drop out, first by their prefixes, then by their whole sets.
   The rest are dealt into blocks by the most frequent of their rarest hashes, so that
   texts with a passage in common are together, and are sent to each place that holds enough of
   their rarest hashes in components of smaller number.  Blocks are as many as the hashes of
   their documents need, and the documents searched for in a block come in parts bounded by
   their hashes, so a task holds a bounded number of bytes besides one document.
5. The search is DivideSkip: the inverted lists of a block that belong to the sought
   set are ordered by length; the longest are put aside, the short ones are merged
   with a heap, whatever occurs T - L times in them is looked up in the long ones by
   binary search, and the exact counts decide.

Defined cases: words are lower-cased (A-Z) runs without ASCII white space; fewer words
than a shingle make one shingle; a text without words, or null, has an empty set and
no links.  A row with a null id has no links and a null component.  Rows that share an
id are one node with the links of each.  Other columns are ignored, whatever their
names.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, small, spool, unspool
from .components import components
from .shingling import mix, shingle_sets, slices, word_hashes
from .sql import words

SHINGLE = 5
PERCENT = 80
BANDS, BAND_ROWS = 6, 3
#: Hashes in a block of the index, and of the documents searched for at a time in one; each document weighs DOCUMENT more.
BLOCK, PART, DOCUMENT = 250_000, 250_000, 250
#: Weight of list length in DivideSkip's choice of long lists.
MU = 0.0085
BROADCAST_ROWS = 500_000
_U = np.uint64


def need(n: int) -> int:
    """Hashes a set of n must share with any set it links to."""
    return -(-n * PERCENT // 100)


def prefix(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, n + (-n * PERCENT // 100) + -(-n // 10))


def least_marked(n):
    """Prefix hashes that a linked set of n shares with its partner: k of the smallest partner, at least."""
    return F.greatest(F.lit(1), F.ceil(F.ceil(F.col(n) * PERCENT / 100) / 10))


def need_of(n: str) -> Column:
    """need() as a column."""
    return F.floor((F.col(n) * PERCENT + 99) / 100)


def _narrow(tokens: DataFrame, least: Column) -> DataFrame:
    """Rows (id, comp, n, h) whose hash is in two components, of documents with at least so many of them; df: rows of the hash.

    Documents that link across components share what they share with two components,
    so both stay.
    """
    counts = tokens.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("df"))
    between = spool(counts.where("low < high").select("h", "df"), "set-between")
    left = tokens.join(between.hint("shuffle_hash"), "h")
    enough = left.groupBy("id", "n").agg(F.count("*").alias("k")).where(F.col("k") >= least).select(F.col("id").alias("_id"), F.col("n").alias("_n"))
    return left.join(enough, (F.col("id") == F.col("_id")) & (F.col("n") == F.col("_n")), "left_semi")


def _weight() -> Column:
    """What the documents of a group weigh: searches among many short ones cost, too."""
    return F.sum(F.col("n") + DOCUMENT)


def _docs(tokens: DataFrame) -> DataFrame:
    return tokens.select("id", "comp", "n").distinct()


def _summary(width: int):
    """key, n, two class numbers and the prefix of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices(batch.column(1)):
                offsets, sets = shingle_sets(*word_hashes(batch.column(1).slice(begin, stop - begin), lower=True), width)
                n = np.diff(offsets)
                totals = np.zeros(len(sets) + 1, dtype=_U)
                np.cumsum(sets, out=totals[1:])
                c1 = mix((totals[offsets[1:]] - totals[offsets[:-1]]) ^ mix(n.astype(_U)))
                np.cumsum(mix(sets ^ _U(0x5851F42D4C957F2D)), out=totals[1:])
                c2 = totals[offsets[1:]] - totals[offsets[:-1]]
                take = prefix(n)
                owner = np.repeat(np.arange(len(n)), take)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(take) - take, take) + offsets[owner]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(sets[place].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, stop - begin), pa.array(n), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), lists],
                    ["id", "n", "c1", "c2", "prefix"],
                )

    return run


def _whole_sets(width: int):
    """id, set and MinHash bands.  Bands: least hash in each of 18 equal ranges, three ranges a band."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = BANDS * BAND_ROWS
        for batch in batches:
            for begin, stop in slices(batch.column(1)):
                offsets, sets = shingle_sets(*word_hashes(batch.column(1).slice(begin, stop - begin), lower=True), width)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                slot = (mix(sets) >> _U(32)) % _U(ranges)
                least = np.full((len(offsets) - 1) * ranges, np.iinfo(np.uint64).max, dtype=_U)
                np.minimum.at(least, owner * ranges + slot.astype(np.int64), sets)
                bands = least.reshape(-1, BANDS, BAND_ROWS)
                factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=_U)
                keys = mix((bands * factors).sum(axis=2, dtype=_U) + np.arange(BANDS, dtype=_U))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, stop - begin),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel())),
                    ],
                    ["id", "set", "bands"],
                )

    return run


class Index:
    """Inverted lists of a block of documents, and DivideSkip over them."""

    def __init__(self, ids: list[int], comps: list[int], sets: list[np.ndarray]) -> None:
        self.ids, self.comps = ids, comps
        self.sizes = [len(s) for s in sets]
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
        order = np.lexsort((owner, flat))
        flat = flat[order]
        self.docs = owner[order].tolist()
        self.keys, starts = np.unique(flat, return_index=True)
        self.starts = np.append(starts, len(flat))

    def search(self, sought: np.ndarray, comp: int) -> list[int]:
        """Documents that link to the sought set, of components other than comp."""
        n = len(sought)
        t = need(n)
        at = np.searchsorted(self.keys, sought)
        at = at[at < len(self.keys)] if len(self.keys) else at[:0]
        if len(at) < t:
            return []
        at = np.unique(at)
        at = at[np.isin(self.keys[at], sought, assume_unique=True)]
        if len(at) < t:
            return []
        starts, ends = self.starts[at], self.starts[at + 1]
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        lists = list(zip(starts[order].tolist(), ends[order].tolist(), strict=True))
        longest = min(t - 1, int(t / (MU * math.log2(max(2, int(lengths.max()))) + 1)))
        long, short = lists[:longest], lists[longest:]
        docs, least = self.docs, t - longest
        found: list[int] = []
        last, count = -1, 0
        candidates = []
        for d in merge(*[docs[a:b] for a, b in short]):
            if d != last:
                if count >= least:
                    candidates.append((last, count))
                last, count = d, 0
            count += 1
        if count >= least:
            candidates.append((last, count))
        for d, count in candidates:
            m = self.sizes[d]
            if self.comps[d] == comp or m < t or need(m) > n:
                continue
            left = len(long)
            for a, b in long:
                left -= 1
                place = bisect_left(docs, d, a, b)
                if place < b and docs[place] == d:
                    count += 1
                elif count + left < t:
                    break
            if 100 * count >= PERCENT * (n + m - count):
                found.append(d)
        return found


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: a block's documents; right: the documents searched for.  One link a component that is found."""
    links: set[tuple[int, int]] = set()
    if left.num_rows and right.num_rows:

        def sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
            column = column.combine_chunks()
            flat, offsets = np.asarray(column.flatten()), np.asarray(column.offsets)
            offsets = offsets - offsets[0]
            return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

        index = Index(left["id"].to_pylist(), left["comp"].to_pylist(), sets_of(left["set"]))
        for comp, sought in zip(right["from"].to_pylist(), sets_of(right["sought"]), strict=True):
            for d in index.search(sought, comp):
                links.add((comp, index.comps[d]))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _search(held: DataFrame, members: DataFrame, routes: DataFrame) -> DataFrame:
    """Links between components: each route's document is searched for in the block it names.

    held: id, comp, set.  members: id, block.  routes: id, n, block.  A block whose routes
    hold many hashes is repeated for parts of them.
    """
    routes = spool(routes, "set-routes")
    parts = spool(routes.groupBy("block").agg(F.ceil(_weight() / PART).cast("long").alias("parts")), "set-parts")
    sought = routes.join(parts, "block").select("id", "block", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    blocks = members.join(parts, "block").select("id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    sought, blocks = spool(sought, "set-sought"), spool(blocks, "set-members")
    # Sets are long: where the ids are few they are broadcast, so that a set is shuffled once, to its block.
    left = held.join(small(blocks, BROADCAST_ROWS), "id").select("block", "part", "id", "comp", "set")
    right = held.join(small(sought, BROADCAST_ROWS), "id").select(F.col("block").alias("to"), F.col("part").alias("piece"), F.col("comp").alias("from"), F.col("set").alias("sought"))
    links = spool(left.groupBy("block", "part").cogroup(right.groupBy("to", "piece")).applyInArrow(_probe, "a long, b long"), "set-links")
    unspool(routes, parts, sought, blocks)
    return links


def _routes(rare: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Second search: (id, block) of all documents, (id, n, block) of what is searched for, and the written tables behind them.

    rare: id, comp, n, hs, key.  A place is a key of more than BLOCK, cut into several blocks,
    or all smaller keys of one hash value, which are one block.  Hashes are joined with places,
    not with blocks, so the hashes of a large group of like texts meet one place, however many
    blocks it has; only its documents are repeated for these.  Of two components that link, the
    one with the larger number searches for the other.
    """
    docs = rare.select("id", "n", "key").distinct()
    large = spool(docs.groupBy("key").agg(F.ceil(_weight() / BLOCK).cast("long").alias("cuts")).where("cuts > 1"), "set-large-keys")
    n_blocks = _blocks(docs.agg(_weight()).first()[0])
    cuts = small(large, BROADCAST_ROWS)
    place = F.when(F.col("cuts") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(n_blocks))).alias("place")
    block, one = F.xxhash64("place", "cut").alias("block"), F.lit(1).cast("long")  # an int hashes otherwise than a long
    at_key = rare.join(cuts, "key", "left")
    placed = at_key.select("id", place, F.pmod(F.xxhash64("id"), F.coalesce("cuts", one)).alias("cut"))
    placed = spool(placed.select("id", block).distinct(), "set-blocks")
    at = spool(at_key.select("comp", place, F.explode("hs").alias("h")).groupBy("h", "place").agg(F.min("comp").alias("low")), "set-places")
    # A set has each hash once, so rows are distinct hashes; a hot one's partition can be split.
    met = rare.select("id", "comp", "n", F.explode("hs").alias("h")).join(at, "h").where("low < comp").groupBy("id", "n", "place").agg(F.count("*").alias("met"))
    found = met.where(F.col("met") >= least_marked("n")).join(cuts, F.col("place") == F.col("key"), "left")
    each = found.select("id", "n", "place", F.explode(F.sequence(one - 1, F.coalesce("cuts", one) - 1)).alias("cut"))
    return placed, each.select("id", "n", block), [placed, at, large]


def _written_components(links: DataFrame, name: str) -> DataFrame:
    found = components(links)
    out = spool(found, name)
    unspool(links, found)
    return out


def _blocks(weight: int | None) -> int:
    return max(1, math.ceil((weight or 0) / BLOCK))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, tables: list[DataFrame] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    tables gets the written tables that the result reads, for unspool() once it is used up.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    summary = spool(rows.mapInArrow(_summary(width), "id long, n long, c1 long, c2 long, prefix array<long>"), "set-summaries")
    full = summary.where("id is not null and n > 0")
    # Written first, an aggregate doesn't tie the join back to its own shuffle, so a hot key can be split there.
    classes = spool(full.groupBy("n", "c1", "c2").agg(F.min("id").alias("rep")), "set-representatives")
    member = spool(full.select("id", "n", "c1", "c2").join(classes, ["n", "c1", "c2"]).select("id", "rep").distinct(), "set-classes")
    unspool(classes)

    # Which documents can have links at all?
    postings = full.select("id", "n", F.explode("prefix").alias("h"))
    common = spool(postings.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h"), "set-common")
    marks = spool(postings.join(common.hint("shuffle_hash"), "h").groupBy("id", "n").agg(F.collect_set("h").alias("hs")), "set-marks")
    wide, summary = summary, spool(summary.select("id", "n"), "set-sizes")
    unspool(wide, common)
    reps = member.select(F.col("rep").alias("id")).distinct()
    active = spool(marks.where(F.size("hs") >= least_marked("n")).join(reps, "id", "left_semi"), "set-active")
    unspool(marks)
    texts = rows.join(small(active.select("id").distinct(), BROADCAST_ROWS), "id")
    sets = spool(texts.mapInArrow(_whole_sets(width), "id long, set array<long>, bands array<long>"), "sets")

    # First search: blocks of pivots.
    n_blocks = _blocks(sets.select(F.size("set").alias("n")).agg(_weight()).first()[0])
    banded = sets.select("id", F.size("set").cast("long").alias("n"), F.explode("bands").alias("band"))
    pivots = banded.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("high")).where("pivot < high").select("band", "pivot")
    starred = spool(banded.join(pivots, "band").where("id <> pivot").select("id", "n", "pivot").distinct(), "set-pivots")
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks))
    members = starred.select(F.col("pivot").alias("id")).distinct().withColumn("block", block_of("id"))
    routes = starred.select("id", "n", block_of("pivot").alias("block")).distinct()
    own = sets.select("id", F.col("id").alias("comp"), "set")
    first = _written_components(_search(own, members, routes), "first-components")
    unspool(starred)

    # Second search: between components.
    comp = F.coalesce("component", "id").alias("comp")
    first_small = small(first, BROADCAST_ROWS)
    held = sets.select("id", "set").join(first_small, F.col("id") == F.col("node"), "left").select("id", comp, "set")
    named = active.join(first_small, F.col("id") == F.col("node"), "left").select("id", comp, "n", F.explode("hs").alias("h"))
    likely = spool(_docs(_narrow(named, least_marked("n"))), "set-likely")
    full = held.join(small(likely.select("id", "n"), BROADCAST_ROWS), "id").select("id", "comp", "n", F.explode("set").alias("h"))
    tokens = spool(_narrow(full, need_of("n")), "set-tokens")
    unspool(active, likely)
    wide, tokens = tokens, spool(_narrow(tokens.select("id", "comp", "n", "h"), need_of("n")), "set-tokens")
    unspool(wide)
    # Of each set the rarest hashes: linked sets share the first k of their common ones inside both cuts.
    order = F.sort_array(F.collect_set(F.struct("df", "h")))
    cut = F.slice("a", F.lit(1), (F.size("a") - need_of("n") + F.ceil(F.col("n") / 10)).cast("int"))
    # Texts of one id and size that are few hashes together have no links.
    rare = tokens.groupBy("id", "comp", "n").agg(order.alias("a")).where(F.size("a") >= need_of("n")).select("id", "comp", "n", cut.alias("a"))
    # Key of a document: the most frequent of them.  Those of one passage or one group of copies have one key.
    rare = spool(rare.select("id", "comp", "n", F.col("a.h").alias("hs"), F.element_at("a", -1)["h"].alias("key")), "set-rare")
    unspool(tokens)
    placed, routes, wide = _routes(rare)
    second = _written_components(_search(held, placed, routes), "second-components")
    unspool(sets, rare, *wide)

    # Document -> class -> first component -> second component.
    named = first.select(F.col("node").alias("rep"), F.col("component").alias("c1"))
    final = second.select(F.col("node").alias("c1"), F.col("component").alias("c2"))
    whole = member.join(named, "rep", "left").withColumn("c1", F.coalesce("c1", "rep")).join(final, "c1", "left")
    found = whole.groupBy(F.col("id").alias("_id")).agg(F.min(F.coalesce("c2", "c1")).alias("component_id"))
    out = summary.select("id", "n").join(found, F.col("id") == F.col("_id"), "left")
    if tables is not None:
        tables += [summary, member, first, second]
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """docs with one row of each component, that with the smallest id; null ids come last, and repeated ids are rows of their own.

    row_col: a number of each row that stays the same in every scan, if docs has one; it
    is dropped.  Else docs is copied with one.
    """
    rows = docs.withColumnRenamed(row_col, "_row") if row_col else keyed(docs, "jaccard-rows")
    tables: list[DataFrame] = []
    out = jaccard_components(rows, id_col="_row", text_col=text_col, tables=tables)
    out = spool(out.select(F.col("doc_id").alias("_row"), "component_id"), "jaccard-components")
    unspool(*tables)
    grouped = out.join(out.where("_row <> component_id").select("component_id").distinct(), "component_id", "left_semi")
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    order = rows.select("_row", F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.xxhash64(text).alias("text"), F.col("_row").alias("row")).alias("place"))
    members = spool(grouped.join(order, "_row"), "jaccard-members")
    unspool(out)
    # Written first, as above: a large group's rows can be split in the join.
    stays = spool(members.groupBy("component_id").agg(F.min("place").alias("first")), "jaccard-first")
    gone = spool(members.join(stays, "component_id").where("place.row <> first.row").select("_row"), "jaccard-gone")
    unspool(members, stays)
    # Where the removed rows are few, the texts aren't shuffled.
    return rows.join(small(gone, BROADCAST_ROWS), "_row", "left_anti").drop("_row")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of different sets that share a shingle are counted; ids are taken to be unique and not null.
OP6_SQL = f"""
WITH RECURSIVE {words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
w AS (SELECT doc_id, p, count(*) OVER ahead AS n, md5(array_to_string(list(word) OVER ahead, ' ')) AS h FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, h FROM w WHERE n = 5 OR p = 1),
d AS (SELECT doc_id, count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS same FROM s GROUP BY doc_id),
c AS (SELECT same, min(doc_id) AS first, min(n) AS n FROM d GROUP BY same),
u AS (SELECT first, n, h FROM c JOIN s ON s.doc_id = first),
l AS (SELECT a.first AS x, b.first AS y FROM u AS a JOIN u AS b ON a.h = b.h AND a.first <> b.first GROUP BY a.first, b.first, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT first AS x, first AS y FROM c UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT documents.doc_id, coalesce(d.n, 0) AS n_shingles, coalesce(m.low, documents.doc_id) AS component_id
FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id LEFT JOIN c ON c.same = d.same LEFT JOIN m ON m.x = c.first
"""
