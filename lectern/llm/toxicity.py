"""Severity of toxic language by cumulative-link (proportional odds) ordinal regression.

Features are sparse: the distinct lower-cased words of a text, stripped of punctuation at both ends, and their
prefixes of 3 to 6 characters, of which screening keeps those that go with toxicity beyond chance: by Fisher's exact test, at a
threshold where at most FALSE_SHARE of the features kept can be due to chance, whatever the number of labelled rows. The
model is P(grade > k) = sigmoid(w.x - t_k), x being the features present, scaled to unit length: one weight vector for all thresholds t_1 < t_2 < ...
Labels only say toxic or not, so grades 1 to 3 of toxic rows are the thirds of their number of
distinct words with a screened feature; grade 0 is not toxic.

Fitting uses a bounded sample, ``sample`` labelled documents in the order of a hash of their id; at most ``max_features``
features, the best by G2, are tested and kept. Screening counts, scores and verdicts are made on the executors; the driver holds the sample's few
screened features a document. Every document is scored over its whole text.

Rules: null or empty text has no features and is not rejected; a document labelled more than once has its
highest label; without toxic labels, nothing is rejected; repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import binary, released, small_batches, words_of

SAMPLE, MAX_FEATURES, FALSE_SHARE = 20_000, 4_096, 0.05
GRADES = 3
EDGE = b".,!?;:'\"()[]{}*$%&#|<>-_=+/\\"


def features_of(word: bytes) -> tuple[str, ...]:
    """A word's features: itself and its prefixes, marked by a trailing hyphen."""
    w = word.strip(EDGE).decode("utf-8", "replace").lower()
    return (w, *[w[:k] + "-" for k in range(3, 7) if len(w) >= k]) if w else ()


def chance(t: int, df: int, toxic: int, clean: int) -> float:
    """P(at least t of df rows are toxic) if the df rows are drawn at random from toxic + clean ones; t above the mean."""
    ways = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    if df - t > clean:
        t = df - clean
    term = math.exp(ways(toxic, t) + ways(clean, df - t) - ways(toxic + clean, df))
    total, most = 0.0, min(df, toxic)
    while t <= most and term > total * 1e-17:
        total += term
        term *= (toxic - t) * (df - t) / ((t + 1) * (clean - df + t + 1))
        t += 1
    return min(1.0, total)


def telling(tested: list[tuple[str, int, int]], spread: dict[int, int], toxic: int, clean: int, share: float = FALSE_SHARE) -> list[str]:
    """Of features (name, clean rows, toxic rows) those under the widest threshold p at which chance gives at most ``share`` of what is kept.

    ``spread`` has how many features stand in so many rows. Chance puts at most p of the features that can reach p at all under it: one of
    too few rows can't.
    """
    ranked = sorted((chance(t, c + t, toxic, clean), f) for f, c, t in tested)
    reach = sorted((chance(min(df, toxic), df, toxic, clean), n) for df, n in spread.items())
    keep = i = able = 0
    for k, (p, _) in enumerate(ranked, 1):
        while i < len(reach) and reach[i][0] <= p * (1 + 1e-9):
            able += reach[i][1]
            i += 1
        if p * able <= share * k:
            keep = k
    return [f for _, f in ranked[:keep]]


class Lookup(dict):
    """word -> indexes of its kept features; remembers a bounded number of words."""

    def __init__(self, index: dict[str, int], limit: int = 200_000):
        super().__init__()
        self.index, self.limit = index, limit

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
        return got

    def of(self, text: bytes | None) -> tuple[list[int], int]:
        """Indexes present in a text, ascending, and the number of distinct words that carry any."""
        hits = [x for x in map(self.__getitem__, set(words_of(text))) if x]
        return sorted({i for x in hits for i in x}), len(hits)


def fit(rows: list[list[int]], grades: np.ndarray, n_features: int, l2: float = 1e-6, rounds: int = 1_000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds, by full-batch Adam on the penalized likelihood."""
    k = int(grades.max())
    base = np.array([np.log(max(1e-4, (grades <= g).mean()) / max(1e-4, (grades > g).mean())) for g in range(k)])
    alike = Counter(zip(map(tuple, rows), grades.tolist()))  # equal rows count together
    rows, grades = [r for r, _ in alike], np.array([g for _, g in alike])
    share = np.array(list(alike.values())) / sum(alike.values())
    lens = np.array([len(r) for r in rows])
    full = np.flatnonzero(lens)  # rows with features
    idx = np.concatenate([np.array(r, np.int32) for r in rows if r] or [np.zeros(0, np.int32)])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
    value = np.repeat(1 / np.sqrt(np.maximum(lens, 1)), lens)
    at = np.concatenate([[0], np.cumsum(lens[full])])[:-1]
    # the same entries by feature, so that both products are sums over runs
    order = np.argsort(idx, kind="stable")
    owner_of, value_of, (met, first) = owner[order], value[order], np.unique(idx[order], return_index=True)
    score = np.zeros(len(rows))
    w = np.zeros(n_features)
    free = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 0.05))])  # first threshold, log gaps
    m, v = np.zeros(n_features + k), np.zeros(n_features + k)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, rounds + 1):
        gaps = np.exp(free[1:])
        theta = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        if len(idx):
            score[full] = np.add.reduceat(w[idx] * value, at)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        up, low = sig(edge[grades + 1] - score), sig(edge[grades] - score)
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        g_score = (du - dl) * share  # of the mean negative log-likelihood
        g_theta = np.zeros(k)
        np.add.at(g_theta, grades[grades < k], -(du * share)[grades < k])
        np.add.at(g_theta, grades[grades > 0] - 1, (dl * share)[grades > 0])
        g_w = l2 * w
        if len(idx):
            g_w[met] += np.add.reduceat(g_score[owner_of] * value_of, first)
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w -= step[:n_features]
        free = free - step[n_features:]
    return w, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])


class Model:
    def __init__(self, index: dict[str, int], weights: np.ndarray, thresholds: np.ndarray):
        self.index, self.weights, self.thresholds = index, weights, thresholds

    def above(self, present: list[int]) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        z = self.weights[present].sum() / len(present) ** 0.5 if present else 0.0
        return 1 / (1 + np.exp(np.clip(self.thresholds - z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE, max_features: int = MAX_FEATURES) -> Model | None:
    """A model, or None where the sample holds no toxic row, no clean row or no telling feature."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = (labels.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{label_col}` as int) y").where("id is not null and y in (0, 1)")
            .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample))
    picked = spark.createDataFrame([tuple(r) for r in rows.collect()], "id long, y int")  # at most `sample` rows
    texts = docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text").join(F.broadcast(picked), "id")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[str, ...]] = {}
        both = Counter(), Counter()
        size = [0, 0]
        for batch in batches:
            for text, y in zip(binary(batch, "text"), batch.column(2).to_pylist(), strict=True):
                size[y] += 1
                fs: set[str] = set()
                for w in set(words_of(text)):
                    if (got := seen.get(w)) is None:
                        got = seen[w] = features_of(w)
                    fs.update(got)
                both[y].update(fs)
        both[0][""], both[1][""] = size  # the row of the sizes
        names = list(both[0].keys() | both[1].keys())
        for k in range(0, len(names), 50_000):
            some = names[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([both[0][n] for n in some], pa.int64()), pa.array([both[1][n] for n in some], pa.int64())], ["f", "c", "t"])

    counted = texts.mapInArrow(released(tally), "f string, c long, t long").groupBy("f").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).persist()  # of the sample
    try:
        sizes = counted.where("f = ''").first()
        if not sizes or not sizes["c"] or not sizes["t"]:
            return None
        c, t = sizes["c"], sizes["t"]
        term = lambda o, e: F.when(F.expr(f"{o} > 0"), F.expr(f"{o} * ln(({o}) / ({e}))")).otherwise(0.0)
        n, df = c + t, "(c + t)"
        g2 = 2 * (term("t", f"{t} * {df} / {n}") + term("c", f"{c} * {df} / {n}")
                  + term(f"({t} - t)", f"{t} * ({n} - {df}) / {n}") + term(f"({c} - c)", f"{c} * ({n} - {df}) / {n}"))
        words = counted.where("f <> ''")
        spread = {r[0]: r[1] for r in words.groupBy(F.expr(df)).count().collect()}  # at most `sample` rows
        tested = words.where(F.expr(f"t / {t} > c / {c}")).orderBy(g2.desc(), "f").limit(max_features).select("f", "c", "t").collect()
    finally:
        counted.unpersist()
    kept = telling([tuple(r) for r in tested], spread, t, c)
    if not kept:
        return None
    index = {f: i for i, f in enumerate(sorted(kept))}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(index)
        for batch in batches:
            got = [look.of(x) for x in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.int64())], ["y", "x", "hits"])

    data = texts.mapInArrow(released(sparse), "y int, x array<int>, hits long").collect()  # of the sample
    data.sort(key=lambda r: (r["y"], r["hits"], r["x"]))  # the same sums on every run
    y, hits = np.array([r["y"] for r in data]), np.array([r["hits"] for r in data])
    marks = np.quantile(hits[y == 1], [i / GRADES for i in range(1, GRADES)])
    grades = np.where(y == 1, 1 + (hits[:, None] > marks[None, :]).sum(1), 0)
    _, grades = np.unique(grades, return_inverse=True)  # thirds may coincide
    weights, thresholds = fit([r["x"] for r in data], grades, len(index))
    return Model(index, weights, thresholds)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """Per row: id, p_toxic, expected_severity, grade (most likely), toxic (p_toxic >= reject_at). No shuffle."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("p_toxic", pa.float64()), ("expected_severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model.index if model else {})
        for batch in batches:
            out = []
            for text in binary(batch, "text"):
                p = model.above(look.of(text)[0]) if model else np.zeros(1)
                each = np.concatenate([[1.0], p]) - np.concatenate([p, [0.0]])
                out.append((float(p[0]), float(p.sum()), int(each.argmax()), bool(p[0] >= reject_at)))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text")
    out = rows.mapInArrow(released(run), "id long, p_toxic double, expected_severity double, grade int, toxic boolean")
    return out.withColumnRenamed("id", id_col)


def reject(docs: DataFrame, model: Model | None, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """``docs`` with all columns, without rows found toxic. No shuffle."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model.index)
        for batch in batches:
            yield batch.filter(pa.array([bool(model.above(look.of(t)[0])[0] < reject_at) for t in binary(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
