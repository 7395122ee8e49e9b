import numpy as np

from lectern.llm import knn


def test_knn_of_repeated_ids(spark):
    """Copies of a query neither crowd out its neighbours nor narrow the search."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(4, 8))[rng.integers(0, 4, 200)] + rng.normal(size=(200, 8)) * 0.2).astype(np.float32)
    lone = np.full(8, 4, np.float32)  # far from all but its own copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[50].tolist())] * 3 + [(50, x[0].tolist()), (1000, lone.tolist())] + [(1000, (lone + i / 64).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(map(tuple, knn.top_k(df, df.where("vec_id % 50 = 0"), 5, pivots=6).collect()))
    ok = [(i, tuple(int(e) for e in np.floor(256 * np.array(v, np.float32).astype(np.float64)))) for i, v in rows]
    want = []
    for q in (0, 50, 100, 150, 1000):
        v = min(w for i, w in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
