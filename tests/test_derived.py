from lectern.plans import derived


def test_corpus_takes_every_row(spark, tmp_path):
    n = 1_200
    spark.createDataFrame([(i, f"R {i}") for i in range(n)], "r_regionkey int, r_name string").coalesce(1).write.parquet(f"file://{tmp_path}/region.parquet")
    spark.createDataFrame([(i, f"N {i}", i) for i in range(n)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"file://{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, f"C#{i}", i) for i in range(n)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"file://{tmp_path}/customer.parquet")
    assert derived.corpus(spark, f"file://{tmp_path}").count() == 3 * n
