"""Sharding by proportional stratified interleaving: every shard holds the mixture of sources, and as many rows as the others.

Rows of each source are shuffled by a seeded hash of their id; row r of a source's n rows
(from 0) has the fractional rank (2 r + 1) / 2 n.  Sorted by fractional rank, each stretch of the
whole holds each source in proportion, so cutting it into equal stretches gives shards
that match the mixture: of a source, a shard holds its share to within one row and what
the other sources' rounding adds, which is below the number of sources.

A source may hold any share of the rows: ranks come from files written in order
(functions.ranks), not from a window over a source.  Only ids, sources and sizes are
sorted; texts are read once for their sizes and don't move.

Law: `rows` (counts of rows differ by one at most).  Slots of a shard are 0, 1, 2 ... in
the order of the interleaving.

Defined cases: a null source is a source of its own; a null text is empty; rows with a
null id, and repeated ids, are rows like others, ordered by size and checksum of their
texts among themselves (equal rows are interchangeable).  Texts that are equal aren't kept
together.  Fewer rows than shards leave the rest of the shards empty.  Other columns are
carried along, whatever their names, but for shard and slot (and _row, when shards are
written), which give way.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from .common import free_name, numbered, spool, unspool
from .sql import CRC_TABLE, crc32

SHARDS = 24
SEED = 12
#: Columns of the result; columns of these names give way, in any case.
RESULT = {"shard", "slot"}


def _draw(seed: int, id_: Column) -> Column:
    """60 bits of an MD5 of seed and id; null for a null id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def interleave(rows: DataFrame, n_shards: int = SHARDS, *, source: Column, id_: Column, ties: tuple[Column, ...] = (), seed: int = SEED) -> DataFrame:
    """rows with shard and slot.  Give it narrow rows: they are sorted twice. ties: what orders rows of the same source and id."""
    rows = rows.drop(*[c for c in rows.columns if c.lower() in RESULT])
    names = {k: free_name(f"_{k}", rows.columns) for k in ("source", "hash", "id", "place", "begin", "n", "rank", "whole", "shard")}
    tied = [free_name(f"_tie{k}", rows.columns) for k in range(len(ties))]
    keyed = rows.select("*", source.alias(names["source"]), _draw(seed, id_).alias(names["hash"]), id_.alias(names["id"]), *[t.alias(n) for t, n in zip(ties, tied, strict=True)])
    order = [names["source"], names["hash"], names["id"], *tied]
    shuffled = ranked(keyed, order, names["place"], name="shard-shuffled")
    of_source = free_name("_of", shuffled.columns)
    sources = shuffled.groupBy(F.col(names["source"]).alias(of_source)).agg(F.min(names["place"]).alias(names["begin"]), F.count("*").alias(names["n"]))
    # Written first, so that a source with most of the rows can be split in the join.
    sources = spool(sources, "shard-sources")
    joined = shuffled.join(sources, F.col(names["source"]).eqNullSafe(F.col(of_source)))
    fraction = (2 * (F.col(names["place"]) - F.col(names["begin"])) + 1) / (2 * F.col(names["n"]))
    merged = ranked(joined.select(*rows.columns, fraction.alias(names["rank"]), *order), [names["rank"], *order], names["place"], name="shard-merged")
    unspool(shuffled, sources)
    total = merged.agg(F.count("*").alias(names["whole"]))
    place = F.col(names["place"])
    shard = F.expr(f"({names['place']} * {n_shards}) div {names['whole']}")
    first = F.expr(f"({names['shard']} * {names['whole']} + {n_shards - 1}) div {n_shards}")
    out = merged.join(F.broadcast(total)).withColumn(names["shard"], shard)
    return out.select(*rows.columns, F.col(names["shard"]).cast("int").alias("shard"), (place - first).alias("slot"))


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes and 8 more) and text_crc32 of each row, and its row_col."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *([row_col] if row_col else []))


def assign(docs: DataFrame, n_shards: int = SHARDS, *, seed: int = SEED, **columns) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of each row of docs."""
    narrow = spool(sized(docs, **columns), "shard-rows")
    out = interleave(narrow, n_shards, source=F.col("source"), id_=F.col("doc_id"), ties=(F.col("size"), F.col("text_crc32")), seed=seed)
    unspool(narrow)
    return out


def write_shards(docs: DataFrame, out_dir: str, n_shards: int = SHARDS, *, seed: int = SEED, **columns) -> DataFrame:
    """Write docs (a plain read of Parquet files) as folders shard=0, 1 ... of Parquet files, rows in the order of their slots.

    Returns shard, n_rows and bytes.  A large shard is several files, each a range of slots.
    """
    rows = numbered(docs.drop(*[c for c in docs.columns if c.lower() in RESULT]), "shard-files")
    placed = assign(rows, n_shards, seed=seed, row_col="_row", **columns).select("_row", "size", "shard", "slot")
    placed = spool(placed, "shard-places")
    whole = rows.join(placed.drop("size"), "_row").drop("_row")
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out_dir)
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


OP12_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc32("coalesce(text, '')")} AS crc, substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 15) AS h FROM documents, t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h NULLS FIRST, doc_id NULLS FIRST, size, crc) AS r, count(*) OVER (PARTITION BY source) AS n FROM d),
m AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), source NULLS FIRST, h NULLS FIRST, doc_id NULLS FIRST, size, crc) - 1 AS place, count(*) OVER () AS whole FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(place * {SHARDS} // whole AS INT) AS shard,
  place - (place * {SHARDS} // whole * whole + {SHARDS - 1}) // {SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard, source FROM m
"""
