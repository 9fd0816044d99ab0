"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.  DataFrame functions only.

Items are short and documents long, so the similarity of their whole sets says
little; what counts is containment, the share of an item's shingles that a document
holds.  Items are partitioned by size into classes (powers of two).  For an item of m
shingles, threshold t and class of least size c, the sketch is the
k = m - ceil(t m) + 1 + r smallest of its shingle hashes (the bottom-k MinHash), with
r = c / 16: a document that holds ceil(t m) of the m shingles holds r + 1 of any such k,
so probing for r + 1 hits loses no leak, and a large item needs several.

The sketches are broadcast, and each hash of a document is looked up where it is read:
one that is in no sketch goes no further, whatever its class and however many classes and
items there are.  Sketches of more than BROADCAST_ROWS hashes are joined by shuffle
instead, behind the bound of each class: a hash goes on once for each class whose largest sketch hash
isn't below it, with the class beside it.  Candidates are then verified by the exact
shingle strings, joined one by one.

Defined cases: words are lower-cased (A-Z) runs without ASCII white space; an item
with fewer words than a shingle is its whole sequence, as is a document.  Items or
documents without words, or with null ids or texts, match nothing in leaks(); clean()
judges rows whatever their ids, so a row with a null id that holds an item goes.
Repeated (id, text) rows count once; one id with several texts is matched text by text
and reported once with its highest count.  Other columns are ignored.  Empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, keyed, shingles, small, spool, words

SHINGLE = 5
THRESHOLD = 0.8
#: Rows of sketches or items that are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Least size of a class over the hits that its items need besides one.
HITS = 16


def _hashes(hashed_words: Column, width: int) -> Column:
    """Shingle hashes of an array of word hashes; fewer words than the width: one hash of them all."""
    n = F.size(hashed_words)
    many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(hashed_words, i + k) for k in range(width)]))
    return F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(hashed_words))).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame, text: str, width: int, *keep: str) -> DataFrame:
    """Adds _h, the shingle hashes; each step reads a column of the step before."""
    a = df.select(*keep, F.transform(words(ascii_lower(F.col(text))), lambda w: F.xxhash64(w)).alias("_x"))
    return a.select(*keep, _hashes(F.col("_x"), width).alias("_h"))


def _strings(df: DataFrame, text: str, width: int, name: str) -> DataFrame:
    a = df.withColumn("_w", words(ascii_lower(F.col(text)))).drop(text)
    return a.withColumn(name, shingles(F.col("_w"), width)).drop("_w")


def _size_class(m: Column) -> Column:
    """Size partitions: powers of two."""
    return F.floor(F.log2(m.cast("double"))).cast("int")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = SHINGLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared) for each item that a document contains to the threshold or more."""
    percent = round(threshold * 100)
    # No filter stands on a computed array: Catalyst would push it down and evaluate the array again, inside lambdas too.
    source = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("_t")).where("item_id is not null and _t is not null").distinct()
    source = source.withColumn("_i", F.xxhash64("_t"))
    tests = spool(_strings(source, "_t", width, "_s").withColumn("_m", F.size("_s")), "benchmark-items")
    hashes = spool(_hashed(source, "_t", width, "item_id", "_i").select("item_id", "_i", F.array_sort(F.array_distinct("_h")).alias("_h")), "benchmark-hashes")
    m = F.size("_h")
    class_ = _size_class(m)
    more = F.floor(F.pow(F.lit(2.0), class_) / HITS).cast("int")
    k = m - F.ceil(m * percent / 100).cast("int") + 1 + more
    sketches = spool(hashes.where(m > 0).select("item_id", "_i", class_.alias("_class"), (more + 1).alias("_need"), F.explode(F.slice("_h", 1, k)).alias("_h")), "benchmark-sketches")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("_t")).where("doc_id is not null and _t is not null").withColumn("_d", F.xxhash64("_t"))
    hits = _probed(_hashed(texts, "_t", width, "doc_id", "_d"), sketches)
    hits = hits.groupBy("doc_id", "_d", "item_id", "_i", "_need").agg(F.count_distinct("_h").alias("_k"))
    found = spool(hits.where("_k >= _need").select("doc_id", "_d").distinct(), "leak-candidates")

    # Verification: the shingles of candidate documents, one by one, against those of the items.
    held = texts.join(small(found, BROADCAST_ROWS), ["doc_id", "_d"]).dropDuplicates(["doc_id", "_d"])
    held = _strings(held, "_t", width, "_s").select("doc_id", "_d", F.explode_outer("_s").alias("_s"))
    parts = tests.select("item_id", "_i", "_m", F.explode("_s").alias("_s"))
    counted = held.join(small(parts, BROADCAST_ROWS // 5), "_s").groupBy("doc_id", "_d", "item_id", "_i", "_m").agg(F.count("*").alias("n_shared"))
    hit = counted.where(100 * F.col("n_shared") >= percent * F.col("_m"))
    best = hit.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", F.col("_m").cast("long").alias("m"))).alias("_b"))
    return best.select("doc_id", "item_id", F.col("_b.m").alias("n_item_shingles"), F.col("_b.n_shared").alias("n_shared"))


def _probed(hashed: DataFrame, sketches: DataFrame) -> DataFrame:
    """The hashes of documents that are in sketches, with the items they belong to."""
    if sketches.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        probes = hashed.select("doc_id", "_d", F.explode_outer("_h").alias("_h"))
        return probes.join(F.broadcast(sketches.drop("_class")), "_h")
    # A row for each class, of which there are as many as the logarithm of the longest item.
    bounds = F.broadcast(sketches.groupBy("_class").agg(F.max("_h").alias("_bound")).agg(F.collect_list(F.struct("_class", "_bound")).alias("_bounds")))
    probes = hashed.join(bounds).select("doc_id", "_d", "_bounds", F.explode_outer(F.array_distinct("_h")).alias("_h"))
    probes = probes.select("doc_id", "_d", "_h", F.explode_outer(F.filter("_bounds", lambda b: F.col("_h") <= b["_bound"])).alias("_b"))
    return probes.select("doc_id", "_d", "_h", F.col("_b._class").alias("_class")).join(sketches, ["_class", "_h"])


def clean(docs: DataFrame, items: DataFrame, *, row_col: str | None = None, **options) -> DataFrame:
    """docs without the rows that hold a benchmark item, whatever their ids; all columns and other rows stay.

    row_col: a number of each row that stays the same in every scan, if docs has one; it
    is dropped.  Else docs is copied with one.
    """
    rows = docs.withColumnRenamed(row_col, "_row") if row_col else keyed(docs, "leak-rows")
    hit = spool(leaks(rows, items, **{**options, "doc_id": "_row"}).select(F.col("doc_id").alias("_row")).distinct(), "leaks")
    return rows.join(small(hit, BROADCAST_ROWS), "_row", "left_anti").drop("_row")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
bs AS (SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
m AS (SELECT id, count(*) AS m FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, CAST(any_value(m.m) AS BIGINT) AS n_item_shingles, count(*) AS n_shared
FROM ds JOIN bs ON ds.s = bs.s JOIN m ON m.id = bs.id
GROUP BY ds.id, bs.id HAVING 100 * count(*) >= 80 * any_value(m.m)
"""
