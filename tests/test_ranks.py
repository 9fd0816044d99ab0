"""Places in a total order: dense, the same for any dealing, with hot values and files of few rows."""

import random

from pyspark.sql import functions as F

from weftline.functions.ranks import ranked


def test_places(spark):
    r = random.Random(1)
    rows = [("hot" if k % 3 else r.choice("abc"), r.randrange(50), k) for k in range(3000)] + [(None, None, 5000 + k) for k in range(5)]
    t = spark.createDataFrame(rows, "a string, b int, k long")
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0, x[2]))
    for n in (1, 7):
        got = {x.p: (x.a, x.b, x.k) for x in ranked(t.repartition(n), ["a", "b", "k"], "p").collect()}
        assert [got[i] for i in range(len(rows))] == want


def test_places_over_several_files_a_task_and_none(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "40")
    try:
        got = ranked(spark.range(1000).withColumn("x", F.lit(-1) * F.col("id")), ["x"], "p").collect()
        assert {x.p: x.x for x in got} == {k: -999 + k for k in range(1000)}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert ranked(spark.range(0), ["id"], "p").collect() == []
