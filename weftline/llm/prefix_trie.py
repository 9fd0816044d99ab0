"""Conversation prefix trie, with what caching shared prefixes saves, by smallest-member ownership.

A conversation is a path from the root; each distinct sequence of its first turns is a
node, known by its depth and a 120-bit hash.  A node is owned by its smallest member, and
as the members of a node are among those of its parent, each conversation owns a suffix
of its path: the nodes from some depth on, or none.  So

* the tokens (here bytes) of all occurrences in a node's subtree are sums over its members
  of what their paths hold from that depth on,
* those of the nodes themselves are sums over members of what they own from there on,

and the difference, what sharing saves in the subtree, is one group-by of prefixes, in
which members add their unowned rest.  A conversation that owns a childless last node
flags one leaf for each node on its path, and each child is flagged by its owner.

Hashes of prefixes are running XORs of hashes of (depth, turn), so a path can be cut into
stretches of STRETCH turns that are carried over; the windows that sum, mark and hash hold
a stretch, never a whole conversation.  Owners are found by an aggregation (combined before
the shuffle) and joined back: a window over a prefix would hold all members of a hot
first turn in one task.  Ids of conversations that end at a node are hashed in a stream.

Defined cases: turns are ordered null first; turns of a conversation that tie are ordered by
a hash of role and text; a null role or text is empty.  Rows without a conv_id belong to
no conversation and are left out.  Repeated rows are turns like others.  Texts of any
length count whole.  Other columns are ignored, whatever their names.  A conversation
without turns is a member of the root.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from .common import spool, unspool

#: Turns of a stretch.
STRETCH = 4096
#: Conversations that share a base, and the turns of it that they take.
FAMILY, BORROWED = 5, 9
_EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ("depth", "x", "y")


def _lane(digest: Column, at: int) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def turns(chats: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (1, 2 ... in the conversation), a and b (120 bits of a hash of role and text) and n_bytes of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    narrow = chats.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), digest.alias("_d"), F.octet_length(text).cast("long").alias("n_bytes"))
    narrow = narrow.where("conv_id is not null").select("conv_id", "turn", _lane(F.col("_d"), 1).alias("a"), _lane(F.col("_d"), 16).alias("b"), "n_bytes")
    rows = ranked(narrow, ["conv_id", F.col("turn").asc_nulls_first(), "a", "b", "n_bytes"], "_place", name="trie-turns")
    begins = spool(rows.groupBy("conv_id").agg(F.min("_place").alias("_begin")), "trie-begins")
    out = spool(rows.join(begins, "conv_id").select("conv_id", (F.col("_place") - F.col("_begin") + 1).alias("place"), "a", "b", "n_bytes"), "trie-places")
    unspool(rows, begins)
    return out


def rebuilt(own: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth and the hashes and bytes of each turn of the rebuilt conversations.

    A conversation starts with the first turns of the first of its family, as many as
    its id's checksum says, and goes on with its own turns after as many.  convs: conv_id.
    """
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))
    take = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(BORROWED))
    plans = convs.select("conv_id", base.alias("_base"), take.alias("_take"))
    heads = own.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("place") < BORROWED)).withColumnRenamed("conv_id", "_base")
    borrowed = spool(plans.join(heads, "_base").where("place <= _take"), "trie-heads")
    found = borrowed.groupBy("conv_id").agg(F.count("*").alias("_found"))
    kept = own.join(spool(plans.join(found, "conv_id", "left"), "trie-plans"), "conv_id").where("place > _take")
    depth = F.col("place") - F.col("_take") + F.coalesce("_found", F.lit(0))
    rest = ["a", "b", "n_bytes"]
    return borrowed.select("conv_id", F.col("place").alias("depth"), *rest).unionByName(kept.select("conv_id", depth.alias("depth"), *rest))


def _paths(turned: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node on each path, the root too: conv_id, depth, x, y (the node), n_bytes and before (bytes of the turns above)."""
    hashes = {"x": F.xxhash64("depth", "a", "b"), "y": F.xxhash64("b", "depth", "a")}
    rows = turned.select("conv_id", "depth", *[h.alias(k) for k, h in hashes.items()], "n_bytes", F.expr(f"(depth - 1) div {STRETCH}").alias("_k"))
    inside = Window.partitionBy("conv_id", "_k").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = [F.bit_xor("x").over(inside).alias("x"), F.bit_xor("y").over(inside).alias("y"), F.sum("n_bytes").over(inside).alias("_sum")]
    whole = rows.groupBy("conv_id", "_k").agg(F.bit_xor("x").alias("_cx"), F.bit_xor("y").alias("_cy"), F.sum("n_bytes").alias("_cs"))
    earlier = Window.partitionBy("conv_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("conv_id", "_k", *[f("_" + k).over(earlier).alias("_" + k) for f, k in ((F.bit_xor, "cx"), (F.bit_xor, "cy"), (F.sum, "cs"))]).where("_cs is not null")
    zero = lambda c: F.coalesce(c, F.lit(0))
    made = rows.select("conv_id", "depth", "_k", "n_bytes", *run).join(carried, ["conv_id", "_k"], "left")
    made = made.select("conv_id", "depth", F.col("x").bitwiseXOR(zero("_cx")).alias("x"), F.col("y").bitwiseXOR(zero("_cy")).alias("y"), "n_bytes", (F.col("_sum") - F.col("n_bytes") + zero("_cs")).alias("before"))
    nothing = F.lit(0).cast("long")
    roots = convs.select("conv_id", nothing.alias("depth"), nothing.alias("x"), nothing.alias("y"), nothing.alias("n_bytes"), nothing.alias("before"))
    return made.unionByName(roots)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, from rows in the order of nodes and ids; a node may span batches."""
    at, state = None, None
    done: list[tuple] = []

    def table() -> pa.RecordBatch:
        columns = [pa.array([d[k] for d in done], pa.int64()) for k in range(3)]
        out = pa.RecordBatch.from_arrays([*columns, pa.array([d[3] for d in done], pa.string())], [*NODE, "ends"])
        done.clear()
        return out

    for batch in batches:
        for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != at:
                if state is not None:
                    done.append((*at, state.hexdigest()))
                at, state = node, hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
        if len(done) > 10_000:
            yield table()
    if state is not None:
        done.append((*at, state.hexdigest()))
    yield table()


def trie(turned: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of turned (conv_id, depth, a, b, n_bytes), conversations of convs (conv_id) that have no turns among the members of the root."""
    paths = spool(_paths(turned, convs.select("conv_id")), "trie-paths")
    lengths = spool(paths.groupBy("conv_id").agg(F.max("depth").alias("length")), "trie-lengths")
    # The root's owner is one row; a hot node below it is a key of a join that can be split, as both sides are written.
    below = paths.where("depth > 0")
    long = spool(below.join(lengths, "conv_id"), "trie-long")
    owners = spool(long.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max("length").alias("_longest")), "trie-owners")
    root = lengths.agg(F.min("conv_id").alias("owner"), F.max("length").alias("_longest"))
    at_root = paths.where("depth = 0").join(lengths, "conv_id").join(F.broadcast(root))
    marked = long.join(owners, [*NODE]).select("conv_id", *NODE, "n_bytes", "before", "length", "owner", "_longest")
    marked = spool(marked.unionByName(at_root.select(*marked.columns)), "trie-marked")
    unspool(paths, lengths, long, owners)

    # What a conversation owns: its nodes from depth `own` on (null: none); `shared` are the bytes of its turns above.
    owned = F.col("owner") == F.col("conv_id")
    leaf = owned & (F.col("depth") == F.col("length")) & (F.col("_longest") == F.col("depth"))
    members = marked.groupBy("conv_id").agg(
        F.min(F.when(owned, F.col("depth"))).alias("_own"), F.sum(F.when(owned, 0).otherwise(F.col("n_bytes"))).alias("_shared"),
        F.max(F.when(~owned, F.col("owner"))).alias("_above"), F.max(leaf.cast("long")).alias("_leaf"),
    )
    rows = marked.join(spool(members, "trie-members"), "conv_id")
    mine = F.col("conv_id") == F.col("owner")
    saved = F.when(mine, 0).otherwise(F.col("_shared") - F.col("before"))
    has_child = (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("_own"))
    parent = F.when(mine & (F.col("depth") > 0), F.when(F.col("depth") > F.col("_own"), F.col("conv_id")).otherwise(F.col("_above")))
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min(parent).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.count_if(has_child).alias("n_children"),
        F.sum("_leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
    )
    ending = marked.where("depth = length").select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    ends = ending.mapInArrow(_digests, "depth long, x long, y long, ends string")
    out = nodes.join(ends, [*NODE], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    convs = spool(own.select("conv_id").distinct(), "trie-convs")
    return trie(rebuilt(own, convs), convs)


#: Turns are known by the list of them from the first on; the checksum of an id is worked out digit by digit, bit by bit.
OP11_SQL = """
WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
t AS (SELECT list(v ORDER BY i) AS v FROM bits),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))), lambda r, d: xor(r >> 8, t.v[xor(r & 255, d) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), t),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT c.conv_id, o.p AS d, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.p <= c.h),
r AS (SELECT * FROM b UNION ALL SELECT c.conv_id, o.p - c.h + (SELECT count(*) FROM b WHERE b.conv_id = c.conv_id), o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.p > c.h),
k AS (SELECT conv_id, d, octet_length(encode(text)) AS n, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, CAST([] AS STRUCT(role VARCHAR, text VARCHAR)[]) FROM c),
l AS (SELECT conv_id, max(d) AS n FROM k GROUP BY conv_id),
nodes AS (SELECT path, any_value(d) AS depth, min(k.conv_id) AS conv_id, count(*) AS n_convs, any_value(k.n) AS n,
  sha256(coalesce(string_agg(CAST(k.conv_id AS VARCHAR), ',' ORDER BY k.conv_id) FILTER (WHERE l.n = d), '')) AS ends FROM k JOIN l ON k.conv_id = l.conv_id GROUP BY path),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
f AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON nodes.path = kids.path),
below AS (SELECT path[1:i] AS path, CAST(sum((n_convs - 1) * n) AS BIGINT) AS saved, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS i FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.leaves AS n_leaves, below.saved AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN below ON f.path = below.path LEFT JOIN f AS up ON f.depth > 0 AND up.path = f.path[1:f.depth - 1]
"""
