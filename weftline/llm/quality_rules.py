"""Quality rules: base statistics of a text and a learned decision list over them.  DataFrame functions only.

The list is learned by sequential covering.  A rule is a conjunction of threshold
tests that picks out documents labelled bad: it grows by the test with the best
information gain on two thirds of the labelled rows, and is pruned on the rest by
dropping its last tests.  Rules are taken in turn, each from the rows that the
earlier ones leave, and end up as one ordered conditional expression.  All
labelled rows take part: they are binned once at the quantiles of each statistic
and counted by bins, and each step sums those counts in Spark; one row of sums
reaches the driver.

Defined cases: a null or empty text has no words (all statistics 0, base_failed
true, kept false).  Null or repeated ids stay rows of their own; a label that is
null or whose id is null or unknown is not used; several labels for one id all
count.  Without usable labels the list is empty and only the base rules hold.
Other columns are carried whatever their names; one named _stats gives way.  An empty
table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, free_name, spool, unspool, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "mean_word", "upper_share", "mark_share", "log_words")
MIN_WORDS = 50
WINDOW = 3


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


# Repeated words: the hashes of three-word windows are sorted with their places, equal
# neighbours are repeats, and the union of the windows is the sum of the gaps between
# their places, three at most.  Each step reads a column of the step before, so no
# lambda evaluates a whole array again.


def _windows(hashed: Column) -> Column:
    places = F.transform(
        F.sequence(F.lit(0), F.size(hashed) - WINDOW),
        lambda i: F.struct(F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")),
    )
    return F.sort_array(F.when(F.size(hashed) > WINDOW, places).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))


def _repeated(ordered: Column) -> Column:
    def same(x: Column, k: Column) -> Column:
        return F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))

    return F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"]))


def _span(p: Column) -> Column:
    n = F.size(p)
    gaps = F.zip_with(F.slice(p, 2, F.greatest(n - 1, F.lit(0))), F.slice(p, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, g: s + g))


def text_stats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns named in keep) with one column _stats, a struct of counts."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "_stats"]
    t, w, l, c, h, o, p = (free_name(x, keep) for x in ("_t", "_w", "_l", "_c", "_h", "_o", "_p"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " " + SPACES, "")) > 0)
    carried = [F.col(f"`{x}`") for x in keep]
    out = docs.select(*carried, text.alias(t), words(text).alias(w), lines.alias(l))
    out = out.select("*", F.translate(t, " " + SPACES, "").alias(c), F.transform(w, lambda x: F.xxhash64(x)).alias(h))
    out = out.select("*", _windows(F.col(h)).alias(o))
    out = out.select("*", _repeated(F.col(o)).alias(p))
    stats = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(c).cast("long").alias("word_chars"),
        _count_of(F.col(t), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        _span(F.col(p)).alias("n_repeat_words"),
        F.size(l).cast("long").alias("n_lines"),
        _count_of(F.col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _count_of(F.col(c), "!?").cast("long").alias("n_marks"),
    )
    return out.select(*carried, stats.alias("_stats"))


def _share(a: str, b: str) -> Column:
    s = F.col("_stats")
    return F.when(s[b] > 0, s[a] / s[b]).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    return {
        "symbol_share": _share("n_symbols", "word_chars"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "mean_word": _share("word_chars", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "mark_share": _share("n_marks", "n_words"),
        "log_words": F.log1p(F.col("_stats")["n_words"].cast("double")),
    }


def base_failed() -> Column:
    s = F.col("_stats")
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Test:
    """feature > cut (above) or feature <= cut, as value and as bin."""

    feature: str
    place: int
    cut: float
    above: bool

    def binned(self) -> Column:
        bin_ = F.col(self.feature)
        return bin_ > self.place if self.above else bin_ <= self.place

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a document that one of them picks out is rejected."""

    rules: tuple[tuple[Test, ...], ...]

    def kept(self) -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(_all([t.column() for t in rule]), F.lit(False)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join([*(f"if {' and '.join(map(str, r))}: reject" for r in self.rules), "else: keep"])


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(
    stats: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    label_id: str = "doc_id",
    label_col: str = "quality",
    bins: int = 16,
    max_rules: int = 8,
    max_tests: int = 3,
    min_precision: float = 0.9,
    min_covered: int = 5,
) -> DecisionList:
    """Learn a decision list from the rows of stats (with _stats) that have a label 0 (bad) or 1 (good).

    Give it the rows that base rules leave, as those are what the list decides on.
    """
    marks = labels.select(F.col(label_id).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    named = features()
    rows = stats.select(F.col(id_col).cast("long").alias("_id"), *[named[f].alias(f) for f in FEATURES]).join(marks, "_id")
    rows = rows.withColumn("_prune", F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(3)) == 0)
    levels = [k / bins for k in range(1, bins)]
    found = rows.groupBy().agg(*[F.percentile_approx(f, levels, 1000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(found[f] or [])) for f in FEATURES}

    def bin_of(f: str) -> Column:
        out = F.lit(0)
        for c in cuts[f]:
            out = out + F.when(F.col(f) > c, 1).otherwise(0)
        return out.alias(f)

    cells = spool(
        rows.select("_prune", "_y", *[bin_of(f) for f in FEATURES]).groupBy("_prune", "_y", *FEATURES).count(), "quality-cells"
    )
    tests = [Test(f, k, c, above) for f in FEATURES for k, c in enumerate(cuts[f]) for above in (True, False)]

    def counts(where: Column, prune: bool, *keys: Column) -> DataFrame:
        part = cells.where(where & (F.col("_prune") == prune))
        bad = F.sum(F.when(F.col("_y") == 0, F.col("count")).otherwise(0)).alias("bad")
        return part.groupBy(*keys).agg(bad, (F.sum("count") - bad).alias("good"))

    def both(where: Column, prune: bool) -> tuple[int, int]:
        """(bad, good) rows where the condition holds."""
        got = counts(where, prune).first()
        return int(got["bad"] or 0), int(got["good"] or 0)

    def picked(where: Column) -> dict[Test, tuple[int, int]]:
        """(bad, good) rows that each test picks out among those where holds, from one count by feature and bin."""
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x")
        part = cells.where(where & ~F.col("_prune")).select("_y", "count", pairs)
        bad = F.sum(F.when(F.col("_y") == 0, F.col("count")).otherwise(0))
        got = part.groupBy("x.f", "x.b").agg(bad.alias("bad"), (F.sum("count") - bad).alias("good")).collect()
        out = {}
        for t in tests:
            rows_ = [r for r in got if r["f"] == t.feature and (r["b"] > t.place) == t.above]
            out[t] = sum(r["bad"] for r in rows_), sum(r["good"] for r in rows_)
        return out

    rules: list[tuple[Test, ...]] = []
    left = F.lit(True)
    while tests and len(rules) < max_rules:
        grown: list[Test] = []
        here = left
        p0, n0 = both(here, False)
        while p0 and n0 and len(grown) < max_tests:
            scored = [(_gain(p, n, p0, n0), p, n, t) for t, (p, n) in picked(here).items()]
            gain, p, n, best = max(scored, key=lambda x: (x[0], -x[2]))
            if gain <= 0:
                break
            grown.append(best)
            here = here & best.binned()
            p0, n0 = p, n
        if not grown:
            break
        heads = [grown[: k + 1] for k in range(len(grown))]
        pruned = [both(left & _all([t.binned() for t in h]), True) for h in heads]
        (p, n), rule = max(zip(pruned, heads, strict=True), key=lambda x: ((x[0][0] - x[0][1]) / max(1, sum(x[0])), -len(x[1])))
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(tuple(rule))
        left = left & ~_all([t.binned() for t in rule])
    unspool(cells)
    return _centred(DecisionList(tuple(rules)), rows)


def _centred(found: DecisionList, rows: DataFrame) -> DecisionList:
    """Each cut moves to the middle between the labelled values next to it, so a value just past the last one seen isn't rejected."""
    tests = sorted({(t.feature, t.cut) for r in found.rules for t in r})
    if not tests:
        return found
    below = [F.max(F.when(F.col(f) <= c, F.col(f))) for f, c in tests]
    above = [F.min(F.when(F.col(f) > c, F.col(f))) for f, c in tests]
    got = rows.groupBy().agg(*[x.alias(f"_{k}") for k, x in enumerate(below + above)]).first()
    middle = {t: t[1] if lo is None or hi is None else (lo + hi) / 2 for t, lo, hi in zip(tests, got[: len(tests)], got[len(tests) :], strict=True)}
    return DecisionList(tuple(tuple(replace(t, cut=middle[t.feature, t.cut]) for t in r) for r in found.rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; the texts are read once."""
    stats = spool(text_stats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"]), "quality-stats")
    rules = learn(stats.where(~base_failed()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return stats.select(
        "doc_id", *[F.col("_stats")[c].alias(c) for c in BASE], base_failed().alias("base_failed"), (~base_failed() & rules.kept()).alias("kept")
    )
