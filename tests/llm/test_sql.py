"""The training-data queries against their SQL, on the smallest tables and on odd ones."""

import os
import random

import duckdb
import pytest

from weftline.llm import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "documents benchmark conversations"
CHAT = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([r[k] for k in order]) for r in records)


def same(spark, path, name):
    con = duckdb.connect()
    for t in TABLES.split():
        where = f"{path}/{t}.parquet"
        if os.path.exists(where):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}{'/*.parquet' if os.path.isdir(where) else ''}'")
    want = con.execute(Q.oracle_sql()[name])
    columns, want = [c[0] for c in want.description], want.fetchall()
    got = Q.queries()[name](spark, f"file://{path}")
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want)
    return len(want)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, name):
    assert same(spark, DIR, name)


@pytest.mark.parametrize("name", ["op6_jaccard_join", "op9_substring_dedup", "op12_sharding"])
def test_odd_documents(spark, tmp_path, name):
    r = random.Random(7)
    words = [f"w{k}" for k in range(40)] + ["É", "ÄB", "AB", "ab", "\xa0", " x"]
    passage = " ".join(r.choice(words) for _ in range(60))
    docs = [(k, r.choice(["", " ", "\n", "\t "]).join(r.choice(words) for _ in range(r.choice([0, 1, 3, 5, 19, 20, 21, 90])))) for k in range(0, 300, 2)]
    docs += [(1001 + k, f"{r.choice(words)} {passage if k % 3 else passage.upper()} {k % 4}") for k in range(40)]
    docs += [(2001, None), (2003, ""), (2005, " \x0b\x0c "), (2007, passage), (2009, passage), (2011, "same " * 70), (2013, "same " * 65)]
    made = [(d, t, "en", r.choice(["hot", "hot", "b", None]), None) for d, t in docs]
    r.shuffle(made)
    spark.createDataFrame(made, DOCS).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert same(spark, str(tmp_path), name) == len(made)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_turn_repair"])
def test_odd_conversations(spark, tmp_path, name):
    r = random.Random(8)
    made = []
    for c in [*range(70), 10**12]:
        t = 0
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            role = r.choices(["user", "assistant", "system", "tool", "", "unknown", None], [8, 8, 2, 1, 1, 1, 1])[0]
            made.append((c, None if r.random() < 0.03 else t, role, r.choice([f"Said {r.randrange(3)}.", "So?", "cut off", " \n", "", None, "é!", "Wow! \x0b", "\xa0", "a\nuser:b."])))
            t += r.choice([1, 1, 1, 2])
    spark.createDataFrame(made, CHAT).repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert same(spark, str(tmp_path), name)
