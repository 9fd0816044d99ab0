"""HTML extraction: boosted trees over features of DOM nodes, then hierarchical decoding.

The trees are trained once a session, in one task, on n_pages made-up pages and n_wide
wide ones with known main text (fixed bounds, no corpus data), each node labelled by
whether it holds main text.  In a task each page is parsed into blocks, all nodes of a slice of pages are scored at
once, and the likeliest consistent choice is taken: nothing below a dropped node is
kept, so an ancestor and a descendant never contradict each other.  Scripts, styles
and other elements that are never shown have no text at all.

Defined cases: a null or empty page, or one without main text, gives the empty string
and 0 characters.  Null ids and urls and repeated rows are carried as they are; other
columns are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, fit_trees
from .dom import block_texts, decode, features, parse
from .html_pages import page
from .shingling import slices

N_PAGES = 700
#: Pages with long flat lists of blocks, besides.
N_WIDE = 140


def _labels(nodes, blocks: list[str]) -> np.ndarray:
    """1 for nodes with main text of their own or below."""
    left = {}
    for b in blocks:
        left[b] = left.get(b, 0) + 1
    own = np.zeros(len(nodes))
    for node in nodes:
        run: list[str] = []
        for item in [*node.items, None]:
            if type(item) is tuple:
                run.append(item[0])
                continue
            text = " ".join("".join(run).split())
            run = []
            if left.get(text, 0):
                left[text] -= 1
                own[node.order] = 1
    for node in reversed(nodes[1:]):
        own[node.parent.order] = max(own[node.parent.order], own[node.order])
    return own


@lru_cache(maxsize=2)
def train(n_pages: int = N_PAGES, n_wide: int = N_WIDE) -> Trees:
    xs, ys = [], []
    for seed in range(n_pages + n_wide):
        html, blocks = page(seed, wide=seed >= n_pages)
        nodes = parse(html)
        xs.append(features(nodes))
        ys.append(_labels(nodes, blocks))
    return fit_trees(np.vstack(xs), np.concatenate(ys))


_trained: dict[tuple, Trees] = {}


def trained(spark: SparkSession, n_pages: int = N_PAGES, n_wide: int = N_WIDE) -> Trees:
    """train() in a task; the trees, of fixed size, are kept for the session."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = train(n_pages, n_wide)
                columns = {"features": [t.features.tolist()], "cuts": [t.cuts.tolist()], "leaves": [t.leaves.tolist()], "start": [t.start]}
                yield pa.RecordBatch.from_pydict(columns)

    key = (spark.sparkContext.applicationId, n_pages, n_wide)
    if key not in _trained:
        schema = "features array<array<long>>, cuts array<array<double>>, leaves array<array<double>>, start double"
        r = spark.range(1, numPartitions=1).mapInArrow(run, schema).first()
        _trained[key] = Trees(np.array(r["features"], dtype=np.int64), np.array(r["cuts"]), np.array(r["leaves"]), r["start"])
    return _trained[key]


def main_texts(pages: list[str], trees: Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    p = trees.probability(np.vstack([features(nodes) for nodes in parsed]))
    out, at = [], 0
    for nodes in parsed:
        chosen = decode(nodes, p[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(block_texts(nodes, chosen)))
    return out


def extract(pages: DataFrame, trees: Trees | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row of pages."""
    trees = trees or trained(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices(batch.column(2), 2 << 20):
                part = batch.slice(begin, stop - begin)
                texts = main_texts([h or "" for h in part.column(2).to_pylist()], trees)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
