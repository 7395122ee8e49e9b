import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing


@pytest.mark.parametrize("most", [0, mixing.BROADCAST_NUMBERS])
def test_rates_broadcast_or_joined(spark, monkeypatch, most):
    """A hot source, many small ones and rows without one get the same copies whichever way rates reach them."""
    rows = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 700)).alias("source"))
    want = sorted(map(tuple, mixing.mix(rows, seed=4).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", most)
    assert sorted(map(tuple, mixing.mix(rows, seed=4).collect()), key=str) == want and {r[1] for r in want} >= {"hot", None}
