import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import knn, mixing, quality_rules, sharding, toxicity


# quality rules

def repeated_brute(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    return len({k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 8)})


def test_counts_as_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice("ab é# X!".split()) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", "\n", "\t "]) for w in words)
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        got = quality_rules.counts(text.encode(), quality_rules.WordHash())
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), repeated_brute(words))
        assert got[:6] == want
    assert quality_rules.counts(None, quality_rules.WordHash()) == (0,) * 7


def test_binomial_bound():
    for n, p in ((1, 0.3), (20, 0.01), (300, 0.2)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(want, abs=1e-9)


def test_cutoffs_keep_their_promise():
    good, bad = np.zeros(201, np.int64), np.zeros(201, np.int64)
    good[0], good[50], bad[100], bad[3] = 5000, 30, 400, 5
    c = quality_rules.choose_cutoff(good, bad, 0.0025, 0.01)
    assert 50 <= c < 100  # below 50, 30 good rows of 5 030 would go: over the limit
    assert quality_rules.choose_cutoff(good // 100, bad, 0.0025, 0.01) is None  # too few labels


def test_judge(spark):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en") for i in range(3000)]
    junk = [(10_000 + i, " ".join(f"w{i}x{j}***" for j in range(30)), "en") for i in range(200)]
    odd = [(20_000, None, None), (20_001, "", "en"), (20_002, "a b " * 40, None), (20_003, clean[0][1], "new")]
    docs = spark.createDataFrame([(*r, 1) for r in clean + junk + odd], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(r[0], 1) for r in clean[:2900]] + [(r[0], 0) for r in junk[:100]] + [(5, None), (7, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(got[r[0]]["kept"] for r in clean) and not any(got[r[0]]["kept"] for r in junk)
    assert [(got[k]["base_failed"], got[k]["kept"]) for k in (20_000, 20_001, 20_002, 20_003)] == [(True, False), (True, False), (True, False), (False, True)]
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


# toxicity

def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(0)
    rows = [sorted(rng.choice(10, k, replace=False).tolist()) if k else [] for k in rng.integers(0, 9, 3000) * (rng.random(3000) < 0.3)]
    grades = np.array([0 if not r else 1 if len(r) <= 2 else 2 if len(r) <= 5 else 3 for r in rows])
    w, t = toxicity.fit(rows, grades, 10)
    assert (np.diff(t) > 0).all()
    model = toxicity.Model({}, w, t)
    got = np.array([(model.above(r) > 0.5).sum() for r in rows])
    assert (got == grades).mean() > 0.95


def test_held_out_accuracy_and_rejection(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(1500):
        words = [rng.choice(vocabulary) for _ in range(40)]
        bad = i % 6 == 0
        for _ in range(rng.randrange(2, 8) if bad else 0):
            words[rng.randrange(40)] = rng.choice(["Vile", "nasty,", "foulxa", "foulyb", "foulzc"])
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(9000, None, 0.1), (9001, "", 0.1), (9002, "foulnew vile", 0.2)], "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 1000] + [(3, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    wrong = sum(got[i]["toxic"] != bool(y) for i, _, y in rows if i >= 1000)
    assert wrong <= 5 and not got[9000]["toxic"] and not got[9001]["toxic"] and got[9002]["toxic"]
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["toxic"]}
    assert toxicity.train(docs, labels.where("toxic = 0")) is None and toxicity.score(docs, None).where("toxic").count() == 0
    assert toxicity.reject(docs.limit(0), model).count() == 0


# mixing

def test_mixing(spark):
    rows = [(i, "t", "big" if i % 3 else "small" if i % 9 else None, 9) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no int").withColumns({"mix_cdf": F.lit(1), "_n": F.lit("x")})
    got = mixing.mix(docs, weights={"big": 1.0, "small": 3.0}).collect()
    n = {s: sum(r["source"] == s for r in got) for s in ("big", "small", None)}
    assert n[None] == 0 and abs(n["big"] - 1500) < 200 and abs(n["small"] - 4500) < 300
    per = {}
    for r in got:
        per.setdefault(r["doc_id"], []).append(r["copy_no"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in per.values())
    counts = np.bincount([len(per.get(i, [])) for i, _, s, _ in rows if s == "small"], minlength=12)
    rate = 4500 * 6000 / 6000 / sum(1 for r in rows if r[2] == "small")
    for k in range(9):
        assert counts[k] / counts.sum() == pytest.approx(math.exp(-rate) * rate**k / math.factorial(k), abs=0.04)
    again = mixing.mix(docs, weights={"big": 1.0, "small": 3.0}).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("long")).limit(3)).columns.count("copy_no") == 1


# nearest neighbours

@pytest.mark.parametrize("block", [20, 100_000])
def test_knn_as_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    x = (centres[rng.integers(0, 5, 300)] + rng.normal(size=(300, 8)) * 0.2).astype(np.float32)
    x[10] = x[11] = x[12]
    x /= np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.5, 2, (300, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (450, [1.0] * 7 + [None]), (500, [1.0] * 7 + [float("nan")]), (550, []), (600, [1.0] * 3), (None, [1.0] * 8), (50, x[0].tolist())]
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id long, embedding array<float>, id int, cell string")
    got = sorted(map(tuple, knn.top_k(df, df.where("vec_id % 50 = 0"), 5, block_rows=block, pivots=6).collect()))
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all()]
    want = []
    for q, v in ok:
        if q % 50 == 0 and q != 50:
            best = sorted((-int(v @ w), i) for i, w in ok if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert [g for g in got if g[0] != 50] == sorted(want)
    assert knn.top_k(df.limit(0), df.limit(0)).count() == 0


# sharding

def test_compaction(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=200_000, fanout=3)
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("path"), F.lit(None).cast("int").alias("n")).repartition(6)
    store.append(rows, F.pmod("id", F.lit(4)))
    store.append(rows.where("id < 10"))
    store.append(rows.limit(0))
    before = store.manifest().count()
    v = store.version()
    store.compact()
    assert store.version() > v and store.manifest().count() < before
    assert store.manifest().agg(F.sum("rows")).first()[0] == 4010 == store.read().count()
    assert store.read().exceptAll(rows.unionAll(rows.where("id < 10"))).count() == 0
    assert store.read(v).count() == 4010  # an older version stays readable until vacuum()
    with pytest.raises(sharding.Conflict):
        store._commit(store.manifest(), store.version())
    live = {r["path"] for r in store.manifest().collect()}
    assert store.vacuum() > 0 and store.read().count() == 4010 and all(os.path.exists(p.removeprefix("file:").replace("///", "/")) for p in live)
