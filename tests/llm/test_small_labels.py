"""Few labelled rows still give a model."""

import math
import random

import pytest

from lectern.llm import quality_rules, toxicity


def test_chance_as_counted():
    for toxic, clean in ((1, 1), (3, 9), (11, 76), (9, 4)):
        for df in range(1, toxic + clean + 1):
            for t in range(max(0, df - clean), min(df, toxic) + 1):
                want = sum(math.comb(toxic, i) * math.comb(clean, df - i) for i in range(t, min(df, toxic) + 1)) / math.comb(toxic + clean, df)
                assert toxicity.chance(t, df, toxic, clean) == pytest.approx(want, rel=1e-6)


def test_screening_keeps_chance_out():
    spread = {1: 7000, 2: 3000, 4: 900, 5: 100}
    tested = [("five", 0, 5), ("four", 0, 4), ("once", 0, 1)]
    assert toxicity.telling(tested, spread, 11, 76) == ["five"]  # 1 000 features can reach the chance of four, 1 in 7 000
    assert toxicity.telling(tested, {1: 7000, 4: 40, 5: 10}, 11, 76) == ["five", "four"]
    assert toxicity.telling([], spread, 11, 76) == []


def test_toxicity_of_eleven_toxic_rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(87):
        words = [f"w{rng.randrange(3000)}" for _ in range(40)]
        if i < 11:
            words[:2] = ["scum", "moron"] if i % 2 else ["loser", "Disgusting!"]
        rows.append((i, " ".join(words), int(i < 11)))
    more = [(100, "w1 w2 you scum and moron"), (101, "w1 w2 w3 w4"), (102, None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert model is not None
    assert {r["doc_id"] for r in toxicity.score(docs, model).where("toxic").collect()} == {*range(11), 100}


def test_pools_of_small_strata():
    assert quality_rules.pools({"en": 2013, "fr": 490, "de": 488, "es": 311}, 0.01, 0.045) == {"es": 0, "de": 0, "fr": 1, "en": 2}
    assert quality_rules.pools({"en": 900, "fr": 600}, 0.01, 0.045) == {"fr": 0, "en": 1}
    assert quality_rules.pools({"en": 200, "fr": 100, "": 20}, 0.01, 0.045) == dict.fromkeys(["en", "fr", ""], 0)
    assert quality_rules.pools({"en": 20}, 0.01, 0.045) == {"en": 0} and quality_rules.pools({}, 0.01, 0.045) == {}


@pytest.mark.parametrize("shout", [False, True])
def test_quality_of_small_strata(spark, shout):
    """Junk is found where no rule alone has labels enough, and where good rows score high on another rule."""
    sizes = {"en": 6000} if shout else {"en": 500, "fr": 60, "de": 400}
    clean, junk = [], []
    for lang, n in sizes.items():
        clean += [(len(clean) + i, " ".join(f"w{i}x{j}".upper() if shout else f"w{i}x{j}" for j in range(30)), lang) for i in range(n)]
        junk += [(100_000 + len(junk) + i, " ".join(f"w{i}x{j}**" for j in range(30)), lang) for i in range(30)]
    new = [(200_000 + i, junk[0][1], lang) for i, lang in enumerate(sizes)] + [(300_000, junk[0][1], "unlabelled")]
    docs = spark.createDataFrame(clean + junk + new, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1) for r in clean] + [(r[0], 0) for r in junk], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert all(got[r[0]] for r in clean) and not any(got[r[0]] for r in junk + new[:-1]) and got[300_000]
