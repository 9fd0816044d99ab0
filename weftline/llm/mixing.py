"""Mixing sources to target weights: iterative proportional fitting, then sampling.  DataFrame functions only.

Tokens are counted by cell (source, language, topic).  Raking multiplies the cell
weights in turn so that their sums meet the target of each source, each language and
each topic.  Its state is one factor for each value of each margin.  A round is one job:
the factor of a source needs only the source's own cells, and sums by language and topic
then give the factors of these two (with more than PAIRS combinations of them, all factors
are tables).  It ends when all margins are met to TOLERANCE, relatively, or to COARSE once
a round hardly helps, as where targets can only be met by cells that fade out; targets
that contradict each other end in an error after MAX_ROUNDS.  A cell's
weight over its tokens gives the probability of its documents, scaled (and held at 1
where need be) so that the expected tokens are the wanted share.  A document stays if
the hash of its id falls below its probability, so a rerun, another partitioning or
another engine picks the same documents.

Only cells are shuffled again and again, never documents, and they are aggregated before
the shuffle: a source that holds a third of all rows is a handful of cells, and no task
holds all cells, however many sources there are.

The topic is any column (topic_of); the default tells a few kinds of text by substrings
(topics), and stands in where no classifier has marked the documents.

Defined cases: a null source, language or topic is a value of its own.  Documents
without words have no tokens and the probability of their cell (1 if the cell has
none).  A null id is hashed as the empty string.  Repeated rows each count and share
their fate.  Texts of any length count whole.  Targets for values that don't occur are
ignored and the rest rescaled; values without a target keep their observed share.  Other
columns stay, but those with a name of the result (_source, _lang, _topic, _n_tokens,
_p, _sampled, in any case) give way.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, free_name, small, spool, unspool

MARGINS = ("_source", "_lang", "_topic")
RESULT = (*MARGINS, "_n_tokens", "_p", "_sampled")
#: Relative error of the margins at which raking ends; where a round takes off less than a tenth of it, COARSE will do.
TOLERANCE = 1e-12
COARSE = 1e-3
MAX_ROUNDS = 500
#: Combinations of language and topic whose sums the driver keeps; with more, the factors are tables.
PAIRS = 2_000
#: Rounds of the SQL form, which has no test of convergence.
SQL_ROUNDS = 40
ALPHA = 0.7
SHARE = 0.8
#: Substrings by which the default topic is told, first match first.
TOPICS = (("legal", ("license", "copyright", "warranty")), ("contact", ("@", "http://", "https://")), ("markup", ("|", "</", "{", "}")))
CELLS_BROADCAST = 100_000
_SPAN = 4294967296


def n_words(text: Column) -> Column:
    """Words of a text, counted by the places where white space ends."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.regexp_count(plain, F.lit("[^ ]+")).cast("long")


def topic(text: Column, topics: Sequence[tuple[str, Sequence[str]]] = TOPICS) -> Column:
    out = F.lit("prose")
    low = F.lower(F.coalesce(text, F.lit("")))
    for name, marks in reversed(topics):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(low, F.lit(m))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def draw(id_: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(_SPAN))


def _target(share: float, value: str | None, wanted: Mapping[str | None, float] | None, alpha: float) -> float:
    """The weight of a value before rescaling: as given, else its observed share; without any given, the share tempered."""
    return share**alpha if wanted is None else float(wanted.get(value, share))


def _margin_targets(base: DataFrame, margin: str, wanted: Mapping[str | None, float] | None, alpha: float) -> DataFrame:
    """_value and _t, its target, for each value of a margin."""
    seen = base.groupBy(margin).agg(F.sum("_share").alias("_s"))
    weight = F.pow("_s", F.lit(alpha)) if wanted is None else F.col("_s")
    for value, w in (wanted or {}).items():
        weight = F.when(F.col(margin).eqNullSafe(F.lit(value)), F.lit(float(w))).otherwise(weight)
    out = spool(seen.select(F.col(margin).alias("_value"), weight.alias("_t")), "mix-targets")
    whole = out.agg(F.sum("_t")).first()[0]
    return out.withColumn("_t", F.col("_t") / F.lit(whole or 1.0))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str | None, float]] | None = None, *, alpha: float = ALPHA, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (the margins and _tokens) with _weight, whose sums over each margin fit its targets."""
    targets = targets or {}
    some = cells.where("_tokens > 0")
    whole = some.agg(F.sum("_tokens")).first()[0]
    if not whole:
        return some.withColumn("_weight", F.lit(0.0))
    base = some.withColumn("_share", F.col("_tokens") / F.lit(float(whole)))
    pairs = spool(base.groupBy("_lang", "_topic").agg(F.sum("_share").alias("_s")).coalesce(1).withColumn("_pair", F.monotonically_increasing_id()), "mix-pairs")
    known = pairs.limit(PAIRS + 1).collect()
    if len(known) > PAIRS:
        unspool(pairs)
        return _rake_tables(base, targets, alpha, tolerance)
    known.sort(key=lambda r: r["_pair"])
    of_source = _margin_targets(base, "_source", targets.get("source"), alpha)
    named = pairs.select(F.col("_lang").alias("_l"), F.col("_topic").alias("_k"), "_pair")
    base = base.join(of_source, F.col("_source").eqNullSafe(F.col("_value"))).join(F.broadcast(named), F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_topic").eqNullSafe(F.col("_k")))
    base = spool(base.select(*MARGINS, "_tokens", "_share", "_t", "_pair"), "mix-base")
    unspool(pairs, of_source)

    values, aims = {}, {}
    for margin in ("lang", "topic"):
        values[margin] = [r[f"_{margin}"] for r in known]
        shares: dict = {}
        for v, r in zip(values[margin], known, strict=True):
            shares[v] = shares.get(v, 0.0) + r["_s"]
        raw = {v: _target(s, v, targets.get(margin), alpha) for v, s in shares.items()}
        aims[margin] = {v: t / (sum(raw.values()) or 1.0) for v, t in raw.items()}
    factors = {m: dict.fromkeys(aims[m], 1.0) for m in aims}

    def of_pairs() -> list[float]:
        return [factors["lang"][a] * factors["topic"][b] for a, b in zip(values["lang"], values["topic"], strict=True)]

    def with_source(by_pair: list[float]) -> DataFrame:
        """base with _f, the factor of its source; a source has PAIRS cells at most."""
        held = F.sum(F.col("_share") * F.get(F.lit(by_pair), F.col("_pair").cast("int"))).over(Window.partitionBy("_source"))
        return base.withColumn("_f", F.when(held > 0, F.col("_t") / held).otherwise(F.lit(0.0)))

    error = before = None
    for _ in range(MAX_ROUNDS):
        last, before = error, of_pairs()
        sums = [0.0] * len(known)
        for r in with_source(before).groupBy("_pair").agg(F.sum(F.col("_share") * F.col("_f")).alias("s")).collect():
            sums[r["_pair"]] = r["s"]
        error = 0.0
        for m in ("lang", "topic"):
            met = dict.fromkeys(aims[m], 0.0)
            for v, f, s in zip(values[m], before, sums, strict=True):
                met[v] += f * s
            error = max([error, *(abs(met[v] / t - 1) if t else met[v] for v, t in aims[m].items())])
        if _done(error, last, tolerance):
            break
        for m, other in (("lang", "topic"), ("topic", "lang")):
            held = dict.fromkeys(aims[m], 0.0)
            for v, o, s in zip(values[m], values[other], sums, strict=True):
                held[v] += s * factors[other][o]
            factors[m] = {v: aims[m][v] / h if h > 0 else 0.0 for v, h in held.items()}
    else:
        raise _unmet(error)
    weight = F.col("_share") * F.col("_f") * F.get(F.lit(before), F.col("_pair").cast("int"))
    out = spool(with_source(before).select(*MARGINS, "_tokens", weight.alias("_weight")), "raked")
    unspool(base)
    return out


def _done(error: float, last: float | None, tolerance: float) -> bool:
    """Whether margins are met: as well as asked for, or well enough and hardly better than a round before."""
    return error <= tolerance or (last is not None and error <= COARSE and error > 0.9 * last)


def _unmet(error: float) -> ValueError:
    return ValueError(f"the targets of sources, languages and topics can't be met together: after {MAX_ROUNDS} rounds a margin is off by {error:.3g} of its target")


def _rake_tables(base: DataFrame, targets: Mapping[str, Mapping[str | None, float]], alpha: float, tolerance: float) -> DataFrame:
    """rake() with weights and margins in tables of any size: each round joins the cells with the sums of one margin after the other."""
    aims = {m: _margin_targets(base, f"_{m}", targets.get(m), alpha) for m in ("source", "lang", "topic")}
    now = spool(base.select(*MARGINS, "_tokens", F.col("_share").alias("_weight")), "mix-weights")

    def sums(m: str) -> DataFrame:
        """_v, its target _t and the sum of its weights."""
        held = now.groupBy(F.col(f"_{m}").alias("_v")).agg(F.sum("_weight").alias("_sum"))
        return spool(held.join(aims[m], F.col("_v").eqNullSafe(F.col("_value"))).select("_v", "_t", "_sum"), "mix-sums")

    error = None
    off = F.max(F.when(F.col("_t") > 0, F.abs(F.col("_sum") / F.col("_t") - 1)).otherwise(F.col("_sum")))
    for _ in range(MAX_ROUNDS):
        met = [sums(m) for m in aims]
        last, error = error, max(x.agg(off).first()[0] for x in met)
        unspool(*met)
        if _done(error, last, tolerance):
            break
        for m in aims:
            met = sums(m)
            factor = F.when(F.col("_sum") > 0, F.col("_t") / F.col("_sum")).otherwise(F.lit(0.0))
            after = now.join(met, F.col(f"_{m}").eqNullSafe(F.col("_v"))).select(*MARGINS, "_tokens", (F.col("_weight") * factor).alias("_weight"))
            after = spool(after, "mix-weights")
            unspool(now, met)
            now = after
    else:
        raise _unmet(error)
    unspool(*aims.values())
    return now


def calibrate(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """The margins and _p = min(1, c * weight / tokens) with the expected tokens share * total.

    c is what the cells below 1 need over their weight.  Scaling takes some cells over 1;
    they are held there and c grows, until no more cells are.  Each step is one row of sums.
    """
    ratio = F.col("_weight") / F.col("_tokens")
    c, n_full = None, -1
    while True:
        full = ratio * c >= 1 if c is not None else F.lit(False)
        sums = [F.sum("_tokens"), F.sum(F.when(full, F.col("_tokens")).otherwise(0)), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("_weight"))), F.count_if(full)]
        whole, filled, rest, n = cells.agg(*sums).first()
        if not rest or n == n_full:
            break
        c, n_full = max(0.0, whole * share - filled) / rest, n
    chance = F.lit(1.0) if c is None or not rest else F.least(F.lit(1.0), F.lit(c) * ratio)
    return cells.select(*MARGINS, chance.alias("_p"))


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str | None, float]] | None = None,
    *,
    id_col: str = "doc_id",
    source: Column | None = None,
    lang: Column | None = None,
    topic_of: Column | None = None,
    topics: Sequence[tuple[str, Sequence[str]]] = TOPICS,
    tokens: Column | None = None,
    alpha: float = ALPHA,
    share: float = SHARE,
    tolerance: float = TOLERANCE,
    text_col: str = "text",
) -> DataFrame:
    """docs with _source, _lang, _topic, _n_tokens, _p (probability) and _sampled."""
    marked = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT],
        (F.col("source") if source is None else source).alias("_source"),
        (F.col("lang") if lang is None else lang).alias("_lang"),
        (topic(F.col(text_col), topics) if topic_of is None else topic_of).alias("_topic"),
        (n_words(F.col(text_col)) if tokens is None else tokens).alias("_n_tokens"),
    )
    cells = spool(marked.groupBy(*MARGINS).agg(F.sum("_n_tokens").alias("_tokens")), "mix-cells")
    raked = rake(cells, targets, alpha=alpha, tolerance=tolerance)
    chances = spool(calibrate(raked, share), "mix-chances")
    unspool(cells, raked)
    names = {m: free_name(f"_c{m}", marked.columns) for m in MARGINS}
    named = chances.select(*[F.col(m).alias(names[m]) for m in MARGINS], "_p")
    same = [F.col(m).eqNullSafe(F.col(names[m])) for m in MARGINS]
    joined = marked.join(small(named, CELLS_BROADCAST), same[0] & same[1] & same[2], "left").drop(*names.values())
    return joined.withColumn("_p", F.coalesce("_p", F.lit(1.0))).withColumn("_sampled", draw(F.col(id_col)) < F.col("_p"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))
    return out.select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_n_tokens").alias("n_tokens"),
        F.round("_p", 6).alias("probability"),
        F.col("_sampled").alias("sampled"),
    )


def op7_sql(rounds: int = SQL_ROUNDS, alpha: float = ALPHA, share: float = SHARE) -> str:
    """The same mixing in SQL, its rounds written out."""
    topics = "".join(f" WHEN {' OR '.join(f"contains(lower(text), '{m}')" for m in marks)} THEN '{name}'" for name, marks in TOPICS)
    steps = [
        f"d AS (SELECT doc_id, source, lang, CASE{topics} ELSE 'prose' END AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)",
        "c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    keys = ("source", "lang", "topic")
    for k in keys:
        steps.append(
            f"t_{k} AS (SELECT {k}, pow(s, {alpha}::DOUBLE) / sum(pow(s, {alpha}::DOUBLE)) OVER () AS t FROM (SELECT {k}, sum(tokens) / (SELECT sum(tokens) FROM c0) AS s FROM c0 GROUP BY {k}))"
        )
    steps.append(
        "w0 AS (SELECT c0.*, t_source.t AS ts, t_lang.t AS tl, t_topic.t AS tt, tokens / sum(tokens) OVER () AS w FROM c0"
        " JOIN t_source ON c0.source IS NOT DISTINCT FROM t_source.source JOIN t_lang ON c0.lang IS NOT DISTINCT FROM t_lang.lang JOIN t_topic ON c0.topic IS NOT DISTINCT FROM t_topic.topic)"
    )
    n = 0
    for _ in range(rounds):
        for k, t in zip(keys, ("ts", "tl", "tt"), strict=True):
            steps.append(f"w{n + 1} AS (SELECT source, lang, topic, tokens, ts, tl, tt, w * {t} / sum(w) OVER (PARTITION BY {k}) AS w FROM w{n})")
            n += 1
    steps.append(f"r AS MATERIALIZED (SELECT source, lang, topic, tokens, w, w / tokens AS r FROM w{n})")
    steps.append(
        "f AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,"
        f" sum(w) OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(tokens) OVER () * {share}::DOUBLE AS want FROM r)"
    )
    steps.append("g AS (SELECT max((want - filled) / rest) AS c FROM f WHERE rest > 0 AND want >= filled AND (want - filled) / rest * r <= 1.0)")
    steps.append("p AS (SELECT source, lang, topic, CASE WHEN g.c IS NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, g.c * r) END AS p FROM r, g)")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(coalesce(p.p, 1.0::DOUBLE), 6) AS probability,"
        f" ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8))::BIGINT / {_SPAN}.0::DOUBLE < coalesce(p.p, 1.0::DOUBLE) AS sampled"
        " FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic IS NOT DISTINCT FROM p.topic"
    )
