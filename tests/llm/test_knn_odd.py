import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import knn

LOW, HIGH = -(2**63), 2**63 - 1


def brute(rows, k=5):
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) and abs(256.0 * x) <= knn.WIDEST for x in v):
            whole.setdefault(i, []).append([math.floor(256.0 * x) for x in v])
    out = []
    for q, vs in whole.items():
        if q % 50 == 0:
            score = [(min(HIGH, max(LOW, sum(x * y for x, y in zip(min(vs), v)))), i) for i, o in whole.items() if i != q for v in o]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(score, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def cases():
    rng = random.Random(8)
    even = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    yield "hot cell", [(i, [rng.gauss(i % 3 * 9, 0.1) for _ in range(4)]) for i in range(0, 6_000, 10)]
    yield "ties and repeated rows", [(i % 120, [float(i % 2)] * 4) for i in range(240)]
    yield "large", even + [(1_000, [2.0e7] * 4), (1_050, [-2.0e7, 2.0e7, 1.0, 0.0])]
    yield "beyond 64 bits", [*even[:60], (1_000, [1.0e15] * 4), (1_050, [1.0e15, -1.0e15, 1.0, 1.0]), (1_100, [-1.0e15] * 4), (1_150, [1.0e30] * 4)]
    yield "odd", [*even[:60], (None, [1.0] * 4), (400, None), (450, []), (500, [1.0, None, 1.0, 1.0]), (550, [math.nan] * 4), (600, [math.inf] * 4), (650, [1.0] * 4)]


@pytest.mark.parametrize(("name", "rows"), cases())
def test_as_all_pairs(spark, name, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in ("id", "v", "cell", "d", "grp", "block", "query_id", "rank", "score")})
    got = knn.top_k(df, df.where("vec_id % 50 = 0"), pivots=6, group_queries=15, block_rows=40)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_a_vector_goes_once_to_a_group_of_queries():
    import numpy as np

    centres = np.random.default_rng(1).normal(size=(40, 3))
    got = knn.query_groups(knn.distances(centres, centres), {i: 10 + 90 * (i == 7) for i in range(40)}, 50)
    held = {}
    for i, (g, n) in got.items():
        for x in range(g, g + n):
            held[x] = held.get(x, 0) + -(-(10 + 90 * (i == 7)) // n)
    assert set(got) == set(range(40)) and max(held.values()) <= 50 and sorted(held) == list(range(len(held))) and len(held) <= 14
