"""Sharding against a plain version on small and odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from weftline.llm import sharding

KIND = "doc_id long, text string, source string, lang string"


def plain_shards(rows, hashes, n_shards):
    """(source, place) by shard: fractions compared exactly."""
    groups = defaultdict(list)
    for i, (doc_id, text, source) in enumerate(rows):
        data = (text or "").encode()
        groups[source].append((hashes[i], doc_id is not None, doc_id or 0, len(data), zlib.crc32(data), i))
    merged = []
    for source, members in groups.items():
        for r, m in enumerate(sorted(members)):
            merged.append((Fraction(2 * r + 1, 2 * len(members)), source is not None, source or "", *m))
    out = {}
    for place, m in enumerate(sorted(merged)):
        shard = place * n_shards // len(merged)
        out[m[-1]] = (shard, place - -(-shard * len(merged) // n_shards))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_interleaving(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["", "é" * r.randrange(9), f"text {i}", None]), r.choices(["hot", "b", "c", None], [6, 2, 1, 1])[0]) for i in range(400)]
    rows += [(None, "x", "hot"), (None, "y", "b"), (3, "other", "hot"), (3, "other two", "hot")]
    df = spark.createDataFrame([(*x, "en") for x in rows], KIND).repartition(5)
    got = sharding.assign(df, 24).collect()
    hashes = [-1 if x[0] is None else int(hashlib.md5(f"{sharding.SEED}:{x[0]}".encode()).hexdigest()[:15], 16) for x in rows]
    want = plain_shards(rows, hashes, 24)
    made = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), s, *want[i]) for i, (d, t, s) in enumerate(rows))
    assert Counter((x.doc_id, x.size, x.text_crc32, x.source, x.shard, x.slot) for x in got) == made


def test_law_slots_and_mixture(spark):
    rows = [(i, "t", "hot" if i % 3 else f"s{i % 7}", "en") for i in range(5000)]
    got = sharding.assign(spark.createDataFrame(rows, KIND).repartition(7), 24).collect()
    by_shard = defaultdict(list)
    for x in got:
        by_shard[x.shard].append(x)
    assert sorted(by_shard) == list(range(24))
    sizes = [len(v) for v in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    whole = Counter(x.source for x in got)
    for members in by_shard.values():
        assert sorted(x.slot for x in members) == list(range(len(members)))
        mixture = Counter(x.source for x in members)
        assert all(abs(mixture[s] - whole[s] / 24) <= 2 for s in whole)
    again = sharding.assign(spark.createDataFrame(rows[::-1], KIND).repartition(2), 24).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    other = sharding.assign(spark.createDataFrame(rows, KIND), 24, seed=5).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, got))


def test_one_source_few_rows_and_names(spark):
    assert sharding.assign(spark.createDataFrame([], KIND)).collect() == []
    same = [(7, "same", "one", "en")] * 50
    got = sharding.assign(spark.createDataFrame(same, KIND), 4).collect()
    assert sorted((x.shard, x.slot) for x in got) == sorted((p * 4 // 50, p - -(-(p * 4 // 50) * 50 // 4)) for p in range(50))
    few = sharding.assign(spark.createDataFrame(same[:3], KIND)).collect()
    assert sorted((x.shard, x.slot) for x in few) == [(0, 0), (8, 0), (16, 0)]
    from pyspark.sql import functions as F

    names = spark.createDataFrame(same, KIND).withColumns({"_place": F.lit(1), "shard": F.lit("x"), "size": F.lit(0), "_row": F.lit(2)})
    assert len(sharding.assign(names).collect()) == 50
    narrow = names.select("doc_id", "_place", F.lit(1).alias("_shard"), "shard", "source")
    out = sharding.interleave(narrow, 5, source=F.col("source"), id_=F.col("doc_id"))
    assert out.columns == ["doc_id", "_place", "_shard", "source", "shard", "slot"] and out.count() == 50


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 5), f"s{i % 3}", "en") for i in range(500)] + [(9, None, None, None)]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    manifest = sharding.write_shards(docs, f"file://{tmp_path}/shards", 6).collect()
    assert sum(m.n_rows for m in manifest) == 501 and max(m.n_rows for m in manifest) - min(m.n_rows for m in manifest) <= 1
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter((x.doc_id, x.text, x.source, x.lang) for x in back.collect()) == Counter(rows)
    want = {(x.doc_id, x.text_crc32): (x.shard, x.slot) for x in sharding.assign(docs, 6).collect()}
    import pyarrow.parquet as pq

    for path in sorted((tmp_path / "shards").glob("shard=*/*.parquet")):
        t = pq.ParquetFile(path).read()
        slots = [want[d, zlib.crc32((x or "").encode())] for d, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)]
        assert [s for _, s in slots] == sorted(s for _, s in slots) and {f"shard={k}" for k, _ in slots} == {path.parent.name}
