"""Substring dedup: words in long passages that also start earlier are removed, found by difference-cover anchors.

Places are words.  {0, 1, 3, 9} is a difference cover modulo 13: for any two places
there is a shift below 13 that takes both to cover places.  So two equal windows of
20 words share, at one such shift, an equal anchor of 20 - 12 = 8 words that starts
at a cover place in both.  Only anchors at cover places (4 of 13) are hashed and
shuffled.  Windows that hold an anchor seen in another document are then hashed
whole, the smallest document id with each window keeps it, and every other
document removes it; repeats inside one document are settled within its task.  Exact
copies of a text after the first lose all words and hash no windows.

A passage in a third of all documents is a counted key, never a group: both the
anchors and the windows are aggregated before the shuffle and joined back, and such
a join's large partitions can be split.

Defined cases: a null text has no words; its kept text is empty.  A null id takes part under a
negative number made of a hash of its text, so such rows count as earlier than all ids
from 0 on.  Rows that share an id aren't compared with each
other; each gets its own result.  Texts under 20 words lose nothing.  Other columns
are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool, unspool
from .shingling import slices, window_hashes, word_hashes
from .sql import words

WINDOW = 20
#: A perfect difference set.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - (PERIOD - 1)


def _owners(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of width words inside one text: its text and its place in the flat words."""
    starts = np.maximum(np.diff(offsets) - width + 1, 0)
    owner = np.repeat(np.arange(len(starts)), starts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts) + offsets[owner]
    return owner, place


def _anchors(offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, flat place and hash of each anchor at a cover place of its text."""
    owner, place = _owners(offsets, ANCHOR)
    keep = np.isin((place - offsets[owner]) % PERIOD, COVER)
    owner, place = owner[keep], place[keep]
    return owner, place, window_hashes(words, ANCHOR)[place] if len(place) else np.zeros(0, np.uint64)


def _first_in_text(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each (text, hash) is the first of its kind; order inside a text is that of the array."""
    first = np.ones(len(owner), dtype=bool)
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    first[order[1:]] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return first


def _members(owner: np.ndarray, hashes: np.ndarray, lists: list[np.ndarray | None]) -> np.ndarray:
    """Whether each hash is in the list of its text."""
    out = np.zeros(len(owner), dtype=bool)
    bounds = np.searchsorted(owner, np.arange(len(lists) + 1))
    for i, wanted in enumerate(lists):
        if wanted is not None and len(wanted):
            out[bounds[i] : bounds[i + 1]] = np.isin(hashes[bounds[i] : bounds[i + 1]], wanted)
    return out


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    return [None if x is None else np.array(x, dtype=np.int64).view(np.uint64) for x in column.to_pylist()]


def _emit_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, stop in slices(batch.column(1)):
            owner, _, hashes = _anchors(*word_hashes(batch.column(1).slice(begin, stop - begin)))
            keep = _first_in_text(owner, hashes)
            keys = np.asarray(batch.column(0).slice(begin, stop - begin))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(keys[owner[keep]])], ["h", "key"])


def _emit_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First occurrence in its text of each window that holds a marked anchor."""
    for batch in batches:
        for begin, stop in slices(batch.column(1)):
            offsets, words = word_hashes(batch.column(1).slice(begin, stop - begin))
            owner, place, hashes = _anchors(offsets, words)
            hit = _members(owner, hashes, _lists(batch.column(2).slice(begin, stop - begin)))
            near = np.zeros(len(words) + 2, dtype=np.int32)
            np.add.at(near, np.maximum(place[hit] - (PERIOD - 1), offsets[owner[hit]]), 1)
            np.add.at(near, place[hit] + 1, -1)
            owner, place = _owners(offsets, WINDOW)
            keep = np.cumsum(near)[place] > 0 if len(place) else np.zeros(0, dtype=bool)
            owner, place = owner[keep], place[keep]
            hashes = window_hashes(words, WINDOW)[place] if len(place) else np.zeros(0, np.uint64)
            keep = _first_in_text(owner, hashes)
            keys = np.asarray(batch.column(0).slice(begin, stop - begin))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(keys[owner[keep]])], ["h", "key"])


def _emit_kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, stop in slices(batch.column(1)):
            texts = batch.column(1).slice(begin, stop - begin)
            offsets, words = word_hashes(texts)
            owner, place = _owners(offsets, WINDOW)
            hashes = window_hashes(words, WINDOW)[place] if len(place) else np.zeros(0, np.uint64)
            copy = np.asarray(batch.column(4).slice(begin, stop - begin))
            gone = ~_first_in_text(owner, hashes) | _members(owner, hashes, _lists(batch.column(2).slice(begin, stop - begin))) | copy[owner]
            edges = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(edges, place[gone], 1)
            np.add.at(edges, place[gone] + WINDOW, -1)
            covered = np.cumsum(edges)[: len(words)] > 0
            removed = np.add.reduceat(np.append(covered, 0).astype(np.int64), offsets[:-1]) if len(offsets) > 1 else np.zeros(0, np.int64)
            counts = np.diff(offsets)
            removed[counts == 0] = 0
            kept = []
            for i, text in enumerate(texts.to_pylist()):
                parts = (text or "").encode().split()
                if removed[i]:
                    parts = [w for w, c in zip(parts, covered[offsets[i] : offsets[i + 1]].tolist(), strict=True) if not c]
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(3).slice(begin, stop - begin), pa.array(counts), pa.array(removed), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )


def _shared(pairs: DataFrame, marked: DataFrame, extra: str | None = None) -> DataFrame:
    """key and the set of its hashes that are in marked (further limited by the condition extra)."""
    joined = pairs.join(marked.hint("shuffle_hash"), "h")
    if extra:
        joined = joined.where(extra)
    return joined.groupBy("key").agg(F.collect_set("h").alias("hs"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by spaces) for each row of docs."""
    text = F.col(text_col).cast("string")
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(doc_id, F.xxhash64(text).bitwiseOR(F.lit(-(1 << 63)))).alias("key"), text.alias("text"), doc_id.alias("doc_id"))
    anchors = spool(rows.select("key", "text").mapInArrow(_emit_anchors, "h long, key long"), "anchors")
    # Written first, the counts don't tie the join to their own shuffle, so a hot hash can be split there.
    repeated = spool(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors-repeated")
    marked = spool(_shared(anchors, repeated), "anchor-marks")
    unspool(anchors, repeated)
    # Every window of an exact copy starts earlier in the first of its kind.
    same = rows.where("text is not null").select("key", F.md5(F.col("text").cast("binary")).alias("t"))
    lows = spool(same.groupBy("t").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("t", "low"), "text-firsts")
    copies = spool(same.join(lows, "t").where("key > low").select("key", "t").distinct(), "text-copies")
    # A copy is a text, not an id: rows that share its id and hold other texts are searched like all others.
    mixed = same.join(copies.select("key").distinct(), "key").join(copies, ["key", "t"], "left_anti").select("key").distinct()
    copies = spool(copies.join(mixed.withColumn("mixed", F.lit(True)), "key", "left"), "text-copies")
    copies = copies.groupBy("key").agg(F.collect_set("t").alias("ts"), F.max("mixed").alias("mixed"))
    is_copy = F.coalesce(F.array_contains("ts", F.md5(F.col("text").cast("binary"))), F.lit(False))
    near = marked.join(copies.where("mixed is null"), "key", "left_anti").join(copies.where("mixed").select("key", "ts"), "key", "left")
    near = rows.select("key", "text").join(near, "key").where(~is_copy).select("key", "text", "hs")
    windows = spool(near.mapInArrow(_emit_windows, "h long, key long"), "windows")
    unspool(marked)
    first = spool(windows.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("h", "low"), "windows-first")
    later = spool(_shared(windows, first, "key > low"), "window-removals")
    unspool(windows, first)
    whole = rows.join(later.join(copies, "key", "full"), "key", "left").select("key", "text", "hs", "doc_id", is_copy.alias("copy"))
    return whole.mapInArrow(_emit_kept, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: A window is known by an MD5 of its words; ids are taken to be unique and not null.
OP9_SQL = f"""
WITH {words()},
w AS (SELECT *, CASE WHEN count(*) OVER ahead = {WINDOW} THEN md5(array_to_string(list(word) OVER ahead, ' ')) END AS h FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
s AS (SELECT *, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS again FROM w),
g AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM s),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents AS d LEFT JOIN k ON k.doc_id = d.doc_id
"""
