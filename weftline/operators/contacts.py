"""Contact counts between contigs, their halves, and their normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("none", "cis", "re", "vc", "vc_sqrt", "hybrid", "tweight", "cis_density")


def count_contacts(pairs: DataFrame, *, q: int = 1, min_contacts: int = 1, sizes: DataFrame | None = None) -> DataFrame:
    """Pairs for each unordered pair of contigs."""
    rows = pairs.where(F.col("mapq") >= q)
    if sizes is not None:
        for side in ("chrom1", "chrom2"):
            rows = rows.join(sizes.select(F.col("contig").alias(side)), side, "left_semi")
    out = rows.groupBy(F.least("chrom1", "chrom2").alias("contig1"), F.greatest("chrom1", "chrom2").alias("contig2")).agg(F.count("*").alias("count"))
    return out.where(F.col("count") >= min_contacts)


def split_contacts(pairs: DataFrame, sizes: DataFrame, n: int, *, q: int = 1, min_contacts: int = 1) -> DataFrame:
    """As count_contacts between the n equal bins of each contig, named contig_bin; the last bin takes the rest."""
    out = pairs.where(F.col("mapq") >= q)
    for k in ("1", "2"):
        out = out.join(sizes.select(F.col("contig").alias(f"chrom{k}"), F.col("size").alias(f"_s{k}")), f"chrom{k}")
        width = F.greatest(F.lit(1), F.floor(F.col(f"_s{k}") / n))
        out = out.withColumn(f"chrom{k}", F.concat_ws("_", f"chrom{k}", F.least(F.lit(n - 1), F.floor(F.col(f"pos{k}") / width)).cast("string")))
    return count_contacts(out, q=q, min_contacts=min_contacts)


def quadrants(pairs: DataFrame, sizes: DataFrame, *, q: int = 1) -> DataFrame:
    """Counts between contig halves as four columns hh, ht, th, tt, and their total."""
    halves = split_contacts(pairs, sizes, 2, q=q)
    return pivot_quadrants(halves)


def pivot_quadrants(halves: DataFrame) -> DataFrame:
    """(contig_i, contig_j, count) to one row for each unordered pair of contigs; the suffix is after the last underscore."""
    name = lambda k: F.regexp_extract(k, "^(.*)_([^_]*)$", 1)
    end = lambda k: F.regexp_extract(k, "^(.*)_([^_]*)$", 2)
    rows = halves.select(name("contig1").alias("a"), end("contig1").alias("i"), name("contig2").alias("b"), end("contig2").alias("j"), "count")
    swap = F.col("a") > F.col("b")
    rows = rows.select(
        F.least("a", "b").alias("contig1"), F.greatest("a", "b").alias("contig2"), F.when(swap, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(swap, F.col("i")).otherwise(F.col("j")).alias("j"), "count"
    )
    cell = lambda i, j: F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("count")).otherwise(0)).alias({"0": "h", "1": "t"}[i] + {"0": "h", "1": "t"}[j])
    return rows.groupBy("contig1", "contig2").agg(cell("0", "0"), cell("0", "1"), cell("1", "0"), cell("1", "1"), F.sum("count").alias("total"))


def quadrants_by_cis(cells: DataFrame) -> DataFrame:
    """Each of the four cells over sqrt((cis_i + 1)(cis_j + 1)), where cis is the diagonal cell of the end."""
    own = cells.where("contig1 = contig2").select("contig1", F.col("hh").alias("h"), F.col("tt").alias("t"))
    side = lambda k: own.select(F.col("contig1").alias(f"contig{k}"), F.col("h").alias(f"_h{k}"), F.col("t").alias(f"_t{k}"))
    out = cells.join(side(1), "contig1", "left").join(side(2), "contig2", "left")
    value = lambda x: F.col(x) / F.sqrt((F.coalesce(f"_{x[0]}1", F.lit(0)) + 1) * (F.coalesce(f"_{x[1]}2", F.lit(0)) + 1).cast("double"))
    return out.select("contig1", "contig2", *[value(x).alias(x) for x in ("hh", "ht", "th", "tt")])


def log_matrix(cells: DataFrame) -> DataFrame:
    """ln(n + 1) of each cell between different contigs, in both directions."""
    logs = [F.log1p(F.col(x).cast("double")).alias(x) for x in ("hh", "ht", "th", "tt")]
    one = cells.where("contig1 <> contig2").select("contig1", "contig2", *logs)
    two = one.select(F.col("contig2").alias("contig1"), F.col("contig1").alias("contig2"), "hh", F.col("th").alias("ht"), F.col("ht").alias("th"), "tt")
    return one.unionByName(two)


def _both(contacts: DataFrame, per: DataFrame, column: str, default: Column) -> DataFrame:
    for k in ("1", "2"):
        contacts = contacts.join(per.select(F.col("contig").alias(f"contig{k}"), F.col(column).alias(f"{column}{k}")), f"contig{k}", "left").withColumn(f"{column}{k}", F.coalesce(f"{column}{k}", default))
    return contacts


def normalize(contacts: DataFrame, method: str = "cis", *, re_counts: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """contig1, contig2, value.  RE counts force the method re.  NaN and negative values become 0.

    cis_unique is known by name only: its values are 0.
    """
    if re_counts is not None:
        method = "re"
    n = F.col("count").cast("double")
    same = F.col("contig1") == F.col("contig2")
    zero, one = F.lit(0.0), F.lit(1.0)
    cis = contacts.where(same).select(F.col("contig1").alias("contig"), F.col("count").cast("double").alias("cis"))
    inter = contacts.where(~same)
    ends = inter.select(F.col("contig1").alias("contig"), "count").union(inter.select(F.col("contig2").alias("contig"), "count"))
    tot = ends.groupBy("contig").agg(F.sum("count").cast("double").alias("tot"))
    if method == "cis":
        t = _both(contacts, cis, "cis", zero)
        value = F.when(same, F.when(F.col("cis1") == 0, 0.0).otherwise(n / F.col("cis1"))).otherwise(n / F.sqrt((F.col("cis1") + 1) * (F.col("cis2") + 1)))
    elif method == "re":
        t = _both(contacts, re_counts.select("contig", F.col("re").cast("double").alias("re")), "re", one)
        value = F.when(F.col("re1") * F.col("re2") == 0, 0.0).otherwise(n / F.sqrt(F.col("re1") * F.col("re2")))
    elif method == "vc":
        t = _both(contacts, tot, "tot", zero)
        value = F.when(same, 0.0).otherwise(n / ((F.col("tot1") + 1) * (F.col("tot2") + 1)))
    elif method == "vc_sqrt":
        t = _both(contacts, tot, "tot", zero)
        value = F.when(~same & (F.col("tot1") > 0) & (F.col("tot2") > 0), n / F.sqrt(F.col("tot1") * F.col("tot2"))).otherwise(0.0)
    elif method == "hybrid":
        sums = cis.agg(F.sum("cis").alias("_c")).crossJoin(tot.agg(F.sum("tot").alias("_t")))
        per = cis.join(tot, "contig", "full").crossJoin(F.broadcast(sums))
        share = lambda x, s: F.coalesce(F.col(x) / F.col(s), zero)
        per = per.select("contig", (0.5 * share("cis", "_c") + 0.5 * share("tot", "_t") + 1e-9).alias("b"))
        t = _both(contacts, per, "b", F.lit(1e-9))
        value = F.when(same, 0.0).otherwise(n / (F.col("b1") * F.col("b2")))
    elif method == "tweight":
        first = _both(inter, tot, "tot", zero).withColumn("v", n / (F.col("tot1") * F.col("tot2")))
        rows = first.select(F.col("contig1").alias("contig"), "v").union(first.select(F.col("contig2").alias("contig"), "v"))
        t = _both(_both(contacts, tot, "tot", zero), rows.groupBy("contig").agg(F.sum("v").alias("tw")), "tw", zero)
        value = F.when(same, 0.0).otherwise(n / (F.col("tot1") * F.col("tw1") * F.col("tot2") * F.col("tw2")))
    elif method == "cis_density":
        t = _both(_both(contacts, cis, "cis", zero), sizes.select("contig", F.col("size").cast("double").alias("len")), "len", zero)
        d = lambda k: (F.col(f"cis{k}") + 1) / (F.least(F.col(f"len{k}"), F.lit(50000.0)) + 1000)
        plain = n / F.sqrt((F.col("cis1") + 1) * (F.col("cis2") + 1))
        value = F.when(same, 0.0).when((F.col("len1") == 0) | (F.col("len2") == 0), plain).otherwise(n / F.sqrt(d(1) * d(2)))
    elif method == "none":
        t, value = contacts, n
    elif method == "cis_unique":
        t, value = contacts, zero
    else:
        raise ValueError(f"no such normalisation: {method}")
    clean = F.when(value.isNull() | F.isnan(value) | (value < 0), 0.0).otherwise(value)
    return t.select("contig1", "contig2", clean.alias("value"))


def graph_scores(contacts: DataFrame, k: int = 5) -> DataFrame:
    """ln(1 + count) to the k best partners of each contig, as shares of the contig's sum, averaged over both directions."""
    logs = contacts.where("contig1 <> contig2").withColumn("s", F.log1p(F.col("count").cast("double")))
    both = logs.select(F.col("contig1").alias("u"), F.col("contig2").alias("v"), "s").union(logs.select(F.col("contig2").alias("u"), F.col("contig1").alias("v"), "s"))
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).where(F.col("r") <= k)
    shares = top.withColumn("s", F.col("s") / F.sum("s").over(Window.partitionBy("u")))
    pairs = shares.groupBy(F.least("u", "v").alias("contig1"), F.greatest("u", "v").alias("contig2"))
    return pairs.agg((F.sum("s") / 2).alias("score"))


def edge_support(fragment_pairs: DataFrame, least: int = 1) -> DataFrame:
    """Pairs for each unordered pair of different fragments, at least least."""
    rows = fragment_pairs.where("fragment1 <> fragment2")
    return rows.groupBy(F.least("fragment1", "fragment2").alias("a"), F.greatest("fragment1", "fragment2").alias("b")).agg(F.count("*").alias("support")).where(F.col("support") >= least)


def contacts_by_cluster(contacts: DataFrame, clusters: DataFrame, *, last_only: bool = False) -> DataFrame:
    """Rows whose two contigs share a cluster, with it; a contig in several counts in each, or (last_only) in its last."""
    t = clusters.select("cluster", "contig").distinct()
    if last_only:
        t = t.groupBy("contig").agg(F.max("cluster").alias("cluster"))
    a = t.select(F.col("contig").alias("contig1"), "cluster")
    b = t.select(F.col("contig").alias("contig2"), "cluster")
    return contacts.join(a, "contig1").join(b, ["contig2", "cluster"])
