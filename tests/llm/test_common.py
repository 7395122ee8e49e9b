import random
import time

import numpy as np
import pytest

from lectern.llm import common as C


@pytest.mark.parametrize("local", [7, 250_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(C, "LOCAL_EDGES", local)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3), (-4, 900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = C.components(spark, spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(got) == len(root) and {r[0]: r[1] for r in got} == {x: find(x) for x in root}


def test_no_edges(spark):
    assert C.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_rolling_and_argmin():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 50, dtype=np.uint64)
    for k in (1, 2, 3, 8, 13, 20):
        want = [sum(int(x) * pow(31, k - 1 - j) for j, x in enumerate(h[i:i + k])) % 2**64 for i in range(50 - k + 1)]
        assert C.rolling(h, k, 31).tolist() == want
        small = h % np.uint64(5)
        assert C.sliding_argmin(small, k).tolist() == [i + int(small[i:i + k].argmin()) for i in range(50 - k + 1)]


def test_heavy_join_as_a_plain_one(spark):
    from pyspark.sql import functions as F

    from lectern.llm.common import heavy_join

    rows = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"), F.lit("s").alias("j"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c")).withColumn("y", -F.col("k"))
    want = sorted(map(tuple, rows.join(table, "k").select("k", "x", "y").collect()))
    for options in ({}, {"least": 10**6}, {"narrow": "y > 0"}, {"least": 0}):
        assert sorted(map(tuple, heavy_join(rows, table, "k", "c", **options).select("k", "x", "y").collect())) == want
    assert heavy_join(rows.limit(0), table.limit(0), "k", "c").count() == 0


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}


def test_cut_leaves_no_shuffle_on_disk(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key, None), shuffle_files(spark)
    df = spark.range(10_000).selectExpr("id", "id % 100 as k").groupBy("k").agg({"id": "sum"}).repartition(3, "k")
    out = C.cut(df)
    until = time.monotonic() + 10  # executors are told, not waited for
    while shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before  # df is still held, so no collection of garbage can have done it
    assert spark.conf.get(key, None) == was
    assert sorted(out.collect()) == sorted(df.collect())  # what was cut can be run again, too


def test_setting_comes_back_after_a_failure(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(key, "false")
    try:
        with pytest.raises(Exception, match="no such"):
            C.cut(spark.range(3).selectExpr("id", "raise_error('no such') as x"))
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.unset(key)
