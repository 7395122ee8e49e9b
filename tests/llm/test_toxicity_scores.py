"""Scores by plain recomputation from the fitted weights, and the fit by its own likelihood."""

import math
import random

import numpy as np
import pytest

from lectern.llm import toxicity as T


def plain(text, index, weights, thresholds):
    present = set()
    for word in (text or "").encode().split():
        w = word.strip(T.EDGE).decode("utf-8", "replace").lower()
        for f in [w] + [w[:k] + "-" for k in (3, 4, 5, 6) if len(w) >= k]:
            if w and f in index:
                present.add(index[f])
    z = sum(weights[i] for i in present) / math.sqrt(len(present)) if present else 0.0
    above = [1 / (1 + math.exp(t - z)) for t in thresholds]
    each = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
    return above[0], sum(above), max(range(len(each)), key=each.__getitem__)


def rows(seed=5, n=600):
    rng = random.Random(seed)
    clean = [f"plain{k}" for k in range(200)]
    rude = ["Vile", "vilest,", "NASTY!", "(scum)", "garstig", "ordure", "vil"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(clean) for _ in range(rng.randrange(3, 40))] + [rng.choice(rude) for _ in range(toxic * rng.randrange(1, 9))]
        rng.shuffle(words)
        docs.append((i, rng.choice([" ", "\n"]).join(words)))
        labels.append((i, int(toxic)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "vile " * 20_000), (n + 3, "plain1\x00vile \U0001f600"), (0, docs[0][1])], labels


def test_scores_as_recomputed(spark):
    docs, labels = rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, p_toxic int")
    model = T.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = sorted(map(tuple, T.score(df, model).collect()))
    want = sorted((i, *plain(t, model.index, model.weights, model.thresholds)) for i, t in docs)
    for (i, p, severity, grade, toxic), (j, *expected) in zip(got, want, strict=True):
        assert (i, grade, toxic) == (j, expected[2], expected[0] >= 0.5) and (p, severity) == pytest.approx(expected[:2], abs=1e-12)
    left = sorted(r[0] for r in T.reject(df, model).select("doc_id").collect())
    assert left == sorted(i for i, t in docs if plain(t, model.index, model.weights, model.thresholds)[0] < 0.5)
    assert all(not toxic for i, *_, toxic in got if i < 600 and i % 4) and all(toxic for i, *_, toxic in got if i < 600 and i % 4 == 0)


def test_thresholds_share_weights_and_fit_the_likelihood():
    rng = np.random.default_rng(2)
    x = [sorted(set(rng.integers(0, 12, rng.integers(1, 5)).tolist())) for _ in range(500)]
    true = np.linspace(-3, 3, 12)
    z = np.array([true[r].sum() / len(r) ** 0.5 for r in x])
    grades = (z[:, None] + rng.logistic(size=(500, 1)) > np.array([-1.0, 0.5, 2.0])).sum(1)
    weights, theta = T.fit(x, grades, 12)
    assert (np.diff(theta) > 0).all()

    def loss(w, t):
        s = np.array([w[r].sum() / len(r) ** 0.5 for r in x])
        up = 1 / (1 + np.exp(s[:, None] - np.array([-np.inf, *t, np.inf])))
        return -np.log(up[np.arange(500), grades + 1] - up[np.arange(500), grades]).mean() + 0.5e-6 * (w @ w)

    best = loss(weights, theta)
    for k in range(12):
        for d in (-0.05, 0.05):
            assert loss(weights + d * (np.arange(12) == k), theta) >= best - 1e-6
    for k in range(3):
        for d in (-0.02, 0.02):
            assert loss(weights, theta + d * (np.arange(3) == k)) >= best - 1e-6
