"""Whole runs from alignments to pairs, as one plan without files in between."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.ranks import ranked
from ..operators import pieces as P
from ..operators.pairs import virtual_pairs


def paf_to_pieces(paf: DataFrame, *, bed: DataFrame | None = None, q: int = 1, min_identity: float = 0.8, min_length: int = 150, edge: int = 0, max_order: int = 50) -> DataFrame:
    """Passing pieces of passing reads.  paf: read_idx, ordinal and the PAF columns."""
    t = P.mark_quality(P.min_mapq(paf, q), min_length=min_length, min_identity=min_identity)
    if bed is not None:
        t = P.mark_digest(t, bed)
    return P.passing_pieces(P.mark_edges(t, edge), max_order=max_order)


def paf_to_pairs(paf: DataFrame, *, q: int = 1, min_order: int = 2, max_order: int = 50, **options) -> DataFrame:
    return virtual_pairs(paf_to_pieces(paf, q=q, max_order=max_order, **options), q=q, min_order=min_order, max_order=max_order)


def number_reads(paf: DataFrame) -> DataFrame:
    """read_idx: 0, 1, 2 ... in the order of the names in query, the same however the input is dealt.

    Names are counted where ranges of them are written, and each range gets the number of
    names before it: no window over all names, and no two names share a number.
    """
    names = ranked(paf.select("query").distinct(), ["query"], "read_idx", name="read-names")
    return paf.drop("read_idx").join(names, "query")


def named_paf_to_pairs(paf: DataFrame, **options) -> DataFrame:
    """paf_to_pairs() of alignments that have names of reads (query) only."""
    return paf_to_pairs(number_reads(paf), **options)
