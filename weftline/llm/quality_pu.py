"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1; everything without a label is unlabelled web
text; labels 0 are never used.  The class prior (share of good text among the
unlabelled) is estimated by comparing upper tails: above a threshold of a first
positive-or-unlabelled model, (share of unlabelled) / (share of positives) can't be
below the prior, and the least such ratio, with a margin for sampling error, is the
estimate.  Then a logistic model is trained on the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

where a batch with a negative second part is stepped back instead.

The model is fitted at the driver on features of a bounded sample (max_rows of each
kind, by hash of the id, rows of one id included); every document is scored, whole text, in its own task.

Defined cases: a null or empty text has zero features and gets the model's score for
them.  A null id is never held out and never trains.  Several labels of an id: the
highest counts.  Without positives every score is the prior's default, 0.5.  Repeated
rows get equal scores; other columns are ignored, whatever their names.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingling import slices, window_hashes, word_hashes

THRESHOLD = 0.3
#: Unlabelled rows below which the sample is of all rows.
LEAST = 100
MAX_ROWS = 8_000
FOLDS = 5

_LETTERS, _UPPER, _DIGIT, _SPACE, _LINE, _OTHER = range(6)
_PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]
_KINDS = 6 + len(_PUNCT)


def _kinds() -> np.ndarray:
    table = np.full(256, _OTHER, dtype=np.int64)
    table[ord("a") : ord("z") + 1] = _LETTERS
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[[9, 11, 12, 13, 32]] = _SPACE
    table[10] = _LINE
    table[_PUNCT] = 6 + np.arange(len(_PUNCT))
    return table


_TABLE = _kinds()
_RATES = 7
WIDTH = _RATES + _KINDS


def _distinct_per_text(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    if not len(owner):
        return np.zeros(n)
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of rates for each text: length, word shape, repetition, and square roots of character kinds' shares."""
    n = len(texts)
    out = np.zeros((n, WIDTH))
    offsets, words = word_hashes(texts)
    counts = np.diff(offsets)
    some = np.maximum(counts, 1)
    owner = np.repeat(np.arange(n), counts)
    raw = [(t or "").encode() for t in texts.to_pylist()]
    sizes = np.array([len(r) for r in raw])
    kinds = _TABLE[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    shares = np.bincount(np.repeat(np.arange(n), sizes) * _KINDS + kinds, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    letters = sizes - shares[:, _SPACE] - shares[:, _LINE]
    lines = [[x for x in r.split(b"\n") if x.strip()] for r in raw]
    n_lines = np.array([len(x) for x in lines])
    out[:, 0] = np.log1p(counts)
    out[:, 1] = np.log1p(letters / some)
    out[:, 2] = 1 - _distinct_per_text(owner, words, n) / some
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    out[:, 3] = np.bincount(owner, weights=same, minlength=n) / some
    starts = np.maximum(counts - 2, 0)
    own3 = np.repeat(np.arange(n), starts)
    place = np.arange(len(own3)) - np.repeat(np.cumsum(starts) - starts, starts) + offsets[own3]
    grams = window_hashes(words, 3)[place] if len(place) else np.zeros(0, np.uint64)
    out[:, 4] = 1 - np.where(starts > 0, _distinct_per_text(own3, grams, n) / np.maximum(starts, 1), 1)
    out[:, 5] = np.array([1 - len(set(x)) / len(x) if x else 0 for x in lines])
    out[:, 6] = n_lines / some
    out[:, _RATES:] = np.sqrt(shares / np.maximum(sizes, 1)[:, None])
    out[sizes == 0] = 0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _soft(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, *, steps: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, float]:
    """Adam on the logistic loss: positives against unlabelled (prior None), or the non-negative risk."""
    rng = np.random.default_rng(seed)
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    ones = lambda x: np.hstack([x, np.ones((len(x), 1))])
    p, u = ones(p), ones(u)
    for t in range(1, steps + 1):
        a = p[rng.integers(0, len(p), min(len(p), 1024))]
        b = u[rng.integers(0, len(u), min(len(u), 1024))]
        za, zb = a @ w, b @ w
        up = a.T @ (_soft(za) - 1) / len(a)  # slope of the loss of positives as positive
        down = a.T @ _soft(za) / len(a)  # slope of the loss of positives as negative
        other = b.T @ _soft(zb) / len(b)  # slope of the loss of unlabelled as negative
        if prior is None:
            g = 0.5 * up + 0.5 * other
        elif np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean() >= 0:
            g = prior * up + other - prior * down
        else:
            g = prior * down - other
        g = g + decay * np.append(w[:-1], 0)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of upper tails, with a margin that widens for short tails."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.95, 96))
    tail_p = np.array([(positive >= c).mean() for c in cuts])
    tail_u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((tail_u + margin) / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, seed: int = 1) -> Model:
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale = np.where(scale < 1e-4, 1e-2, scale)
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    half_p, half_u = len(p) // 2, len(u) // 2
    w, b = _descend(p[:half_p], u[:half_u], None, steps=400, rate=0.02, decay=1e-3, seed=seed)
    prior = estimate_prior(p[half_p:] @ w + b, u[half_u:] @ w + b)
    w, b = _descend(p, u, prior, steps=1500, rate=0.02, decay=1e-4, seed=seed + 1)
    return Model(mean, scale, w, b, prior)


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model | None:
    """A model from max_rows trusted positives and max_rows unlabelled rows at most, chosen by a hash of the id.

    Rows of the held-out fold take no part, nor do their labels.  Where fewer than LEAST rows
    have no label, the sample that stands for all text is drawn from all rows, labelled
    ones among them, as the risk needs the whole's distribution.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & (fold(F.col("id")) != 0))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("id")) != 0))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64("id", F.lit(7))

    def sample(ids: DataFrame) -> np.ndarray:
        chosen = ids.select("id").distinct().orderBy(order, "id").limit(max_rows)
        made = rows.join(F.broadcast(chosen), "id").mapInArrow(_features, "id long, x array<float>")
        # An id may have any number of rows: the limit holds for rows, too.
        got = made.orderBy(order, "id", "x").limit(max_rows).select("x").collect()
        return np.array([r["x"] for r in got], dtype=float).reshape(-1, WIDTH)

    positive = sample(known.where("y = 1"))
    unlabelled = sample(rows.select("id").join(known, "id", "left_anti"))
    if len(unlabelled) < LEAST:
        unlabelled = sample(rows)
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    # Collected order follows partitions; training doesn't.
    positive, unlabelled = (x[np.lexsort(x.T[::-1])] for x in (positive, unlabelled))
    rng = np.random.default_rng(3)
    return fit(rng.permutation(positive), rng.permutation(unlabelled))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for begin, stop in slices(texts):
            x = text_features(texts.slice(begin, stop - begin)).astype(np.float32)
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, stop - begin), lists], ["id", "x"])


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices(batch.column(1)):
                texts = batch.column(1).slice(begin, stop - begin)
                got = np.full(len(texts), 0.5) if model is None else model.score(text_features(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, stop - begin), pa.array(got)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
