"""The prefix trie against a plain version and its SQL."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from weftline.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(set)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    out = []
    for path, cs in members.items():
        inside = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in cs if len(made[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in inside if p)
        parent = min(members[path[:-1]]) if path else None
        leaves = sum(not children[p] for p in inside)
        out.append((min(cs), len(path), parent, len(cs), len(children[path]), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def chats(seed):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(90), 60) + [10**15 + 1, 10**15]:
        same = r.random() < 0.5
        for t in range(r.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if same or r.random() < 0.6 else r.choice(["é", "", None, "x" * r.randrange(50)])))
    rows += [(3, None, "user", "no turn"), (4, None, None, None), (None, 0, "user", "no conversation"), (91, 0, None, None)]
    return rows


@pytest.mark.parametrize("seed, stretch", [(1, 4096), (2, 2), (3, 3)])
def test_trie(spark, monkeypatch, seed, stretch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    rows = chats(seed)
    own = prefix_trie.turns(spark.createDataFrame(rows, KIND).repartition(3))
    convs = own.select("conv_id").distinct()
    got = prefix_trie.trie(prefix_trie.rebuilt(own, convs), convs)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_equal_conversations_and_repeats(spark):
    rows = [(c, t, "user", f"{t}") for c in range(0, 300, 5) for t in range(12)] + [(7, 0, "user", "0")] * 3
    own = prefix_trie.turns(spark.createDataFrame(rows, KIND))
    convs = own.select("conv_id").distinct()
    got = sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(own, convs), convs).collect()), key=repr)
    assert got == plain_trie(rows)


def test_empty_and_long(spark):
    own = prefix_trie.turns(spark.createDataFrame([], KIND))
    convs = own.select("conv_id").distinct()
    assert prefix_trie.trie(prefix_trie.rebuilt(own, convs), convs).collect() == []
    rows = [(5, t, "user", "word " * 200_000 if t == 3 else str(t)) for t in range(6000)] + [(6, t, "user", f"own {t}") for t in range(20)]
    own = prefix_trie.turns(spark.createDataFrame(rows, KIND))
    convs = own.select("conv_id").distinct()
    got = prefix_trie.trie(prefix_trie.rebuilt(own, convs), convs).collect()
    h = zlib.crc32(b"6") % 9
    assert h > 0 and len(got) == 6001 + 20 - h
    root = next(x for x in got if x.depth == 0)
    assert (root.n_convs, root.n_leaves) == (2, 2)
    assert root.saved_tokens == sum(len(x[3]) for x in rows[:h])


def test_sql(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = chats(4)
    pq.write_table(pa.table({k: pa.array([x[i] for x in rows], pa.int64() if i < 2 else pa.string()) for i, k in enumerate(("conv_id", "turn", "role", "text"))}), tmp_path / "conversations.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        if not os.path.isdir(folder):
            continue
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
        got = sorted(map(tuple, prefix_trie.op11_prefix_trie(spark, folder).select(*NAMES).collect()), key=repr)
        want = con.execute(prefix_trie.OP11_SQL)
        assert [c[0] for c in want.description] == NAMES
        assert sorted(want.fetchall(), key=repr) == got
    assert got


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = chats(5)
    df = spark.createDataFrame(rows, KIND).withColumns({k: F.lit("z") for k in ("_place", "a", "b", "depth", "_d", "n_bytes")})
    own = prefix_trie.turns(df)
    convs = own.select("conv_id").distinct()
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(own, convs), convs).collect()), key=repr) == plain_trie(rows)
