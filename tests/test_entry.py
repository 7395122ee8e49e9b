import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tests.conftest import ROOT

HIDE = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"


@pytest.mark.parametrize("missing", ["lectern.llm", "a_module_that_nothing_imports", "ahocorasick", "corpus_pipeline"])
def test_queries_without_a_module(missing):
    out = subprocess.run([sys.executable, "-c", HIDE.format(missing)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    names, oracles = (x.split() for x in out.stdout.split("|"))
    assert "bm25_top" in names and set(oracles) <= set(names)
    if missing in ("lectern.llm", "corpus_pipeline"):
        assert "pipeline" not in names
    if missing in ("lectern.llm", "ahocorasick"):
        assert not any(n.startswith("op") for n in names)


def test_civil_dates_of_large_keys(spark, tmp_path):
    keys = [0, 149_999, 984_298, 984_299, 8_999_999, 700_000_000, -233_176, -233_177, -700_000_000, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"file://{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = [tuple(r) for r in __spark_entry__.queries()["civil_dates"](spark, f"file://{tmp_path}").collect()]
    assert sorted(got, key=str) == sorted(db.execute(__spark_entry__.oracle_sql()["civil_dates"]).fetchall(), key=str)
