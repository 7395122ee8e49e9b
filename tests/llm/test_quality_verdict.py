"""Verdicts by plain recomputation, and the rate of false rejections by simulation."""

import math
import random

import numpy as np

from lectern.llm import quality_rules as Q

ALPHA, DELTA = 0.05, 0.1


def upper_bound_within(lost, n, limit, level):
    """P(X <= lost) <= level for X binomial(n, limit): the exact upper bound is within the limit."""
    return sum(math.comb(n, i) * limit**i * (1 - limit) ** (n - i) for i in range(lost + 1)) <= level


def cutoff(good, bad, limit, level):
    certified = []
    for c in range(Q.BINS - 1, -1, -1):
        if not good or not upper_bound_within(sum(x > c for x in good), len(good), limit, level):
            break
        certified.append(c)
    caught = {c: sum(x > c for x in bad) for c in certified}
    most = max(caught.values(), default=0)
    return next((c for c in certified if caught[c] >= 0.95 * most), None) if most else None


def scores(text):
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    seen = {}
    for k in range(n - 7):
        seen.setdefault(tuple(words[k:k + 8]), []).append(k)
    repeated = {j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    raw = (sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated), sum(w.isupper() for w in words))
    base = n < 20 or 100 * len(repeated) > 30 * n
    over = (n, len(lines), n, n)
    return base, [min(x * 1000 // max(d, 1) // Q.STEP, Q.BINS) for x, d in zip(raw, over)]


def verdicts(rows, labels):
    measured = {i: (lang, *scores(t)) for i, t, lang in rows}
    y = {}
    for i, q in labels:
        if q in (0, 1):
            y[i] = min(q, y.get(i, 1))
    own = {i: m for i, m in measured.items() if i in y and not m[1]}
    langs = {m[0] for m in own.values()}
    pool = Q.pools({s: sum(y[i] for i, m in own.items() if m[0] == s) for s in langs}, ALPHA, Q.UNION * DELTA)
    n, cuts = max(pool.values(), default=0) + 1, {}
    for p in set(pool.values()):
        mine = [(y[i], m[2]) for i, m in own.items() if pool[m[0]] == p]
        pick = lambda f, limit, level: cutoff([f(x) for g, x in mine if g], [f(x) for g, x in mine if not g], limit, level)  # noqa: B023, E731
        caught = lambda f, c: 0 if c is None else sum(f(x) > c for g, x in mine if not g)  # noqa: B023, E731
        one = pick(max, ALPHA, Q.UNION * DELTA / n)
        each = [pick(lambda x, r=r: x[r], ALPHA / 4, (1 - Q.UNION) * DELTA / (4 * n)) for r in range(4)]
        better = caught(max, one) >= max(caught(lambda x, r=r: x[r], c) for r, c in enumerate(each))
        cuts[p] = [one] * 4 if better else each
    return {i: not base and all(c is None or x <= c for c, x in zip(cuts.get(pool.get(lang), [None] * 4), xs)) for i, (lang, base, xs) in measured.items()}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(500)]
    rows, labels = [], []
    for i in range(900):
        lang = rng.choice(["en", "en", "en", "fr", "xx", None, ""])
        bad = rng.random() < 0.2
        t = [rng.choice(words) for _ in range(rng.randrange(15, 60))]
        kind = rng.randrange(3) if bad else 3
        t += ["#*$%"] * 12 if kind == 0 else [w.upper() for w in t[:30]] if kind == 1 else t[:9] + t[:9] if kind == 2 else ["#"] * rng.randrange(2)
        text = " ".join(t)
        rows.append((i, text + ("\n" + text[:40]) * rng.randrange(3) if kind == 2 else text, lang))
        if rng.random() < 0.8:
            labels.append((i, int(not bad)))
    return rows, labels + [(3, 0), (3, 1), (7, 5), (8, None)]


def test_verdicts_as_recomputed(spark):
    for seed in (1, 2):
        rows, labels = corpus(seed)
        got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"), ALPHA, DELTA).collect()
        want = verdicts(rows, labels)
        assert {r["doc_id"]: r["kept"] for r in got} == want
        base = {r["doc_id"]: r["base_failed"] for r in got}
        assert sum(not want[i] and not base[i] for i in want) > 20  # the method rejects more than the base rule
        assert {r["stratum"] for r in got} == {"en", "fr", "xx", None, ""}  # null and empty are strata of their own


def test_share_of_runs_that_lose_too_much():
    """Good rows' scores are drawn from a known distribution: the true loss of the chosen cutoff exceeds alpha in at most a share delta of runs."""
    rng = np.random.default_rng(3)
    p = np.exp(-np.arange(Q.BINS + 1) / 9)
    p /= p.sum()
    beyond = 1 - np.cumsum(p)
    runs = worse = found = 0
    for _ in range(400):
        n = int(rng.integers(80, 600))
        good = np.bincount(rng.choice(Q.BINS + 1, n, p=p), minlength=Q.BINS + 1)
        bad = np.bincount(rng.integers(0, Q.BINS + 1, 60), minlength=Q.BINS + 1)
        c = Q.choose_cutoff(good, bad, ALPHA, DELTA, 1.0)  # the strictest of the certified ones
        runs, found = runs + 1, found + (c is not None)
        worse += c is not None and beyond[c] > ALPHA
    assert found > 300 and worse / runs <= DELTA
