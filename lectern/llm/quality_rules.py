"""Quality rules whose cutoffs are certified on labelled holdouts.

measure() counts, in one narrow pass over whole texts, what the rules need. certify() then picks cutoffs on labelled rows of
good quality that pass the base rule, by the exact (Clopper-Pearson) binomial bound. Strata with too few of these for any cutoff are pooled,
with the next larger one if need be; each pool gets the better of two certificates:
- one cutoff for all rules, whose scores have one unit: the share that any rule rejects is at most ``alpha`` with confidence
  ``1 - UNION * delta / pools``;
- a cutoff for each rule: it rejects at most ``alpha / rules`` with confidence ``1 - (1 - UNION) * delta / (pools * rules)``. This serves where
  a rule on which good rows score high holds up the others.
In each sequence cutoffs are tested from the laxest on and testing stops at the first that fails, so the whole sequence costs one test; over
sequences the correction is Bonferroni's. With probability 1 - delta no pool loses more than alpha of its good rows.

Rules: a null or empty text has no words and fails the base rule; a null stratum is a stratum of its own; a row
labelled several times counts once, as good only if every label says so; labels other than 0 and 1 are
ignored; where even one pool of all strata has too few labels nothing is certified, and then, as in strata without any label,
only the base rule rejects.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WordHash, binary, cut, released, rolling, small_batches, words_of

SYMBOLS = b"#*$%&|<>"
#: Rule -> score in whole thousandths; higher is worse.
RULES = {
    "symbols": "n_symbols * 1000 div greatest(n_words, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "capitals": "n_upper_words * 1000 div greatest(n_words, 1)",
}
STEP, BINS = 10, 200  # cutoffs are multiples of 10 thousandths; the last bin holds all scores beyond
WINDOW = 8
#: Strata whose cutoffs go to every executor; with more, documents are shuffled by stratum.
BROADCAST_STRATA = 100_000
UNION = 0.9  # share of delta for the rules' common cutoff


def repeated_words(words: list[bytes], hashes: WordHash | None = None) -> int:
    """Words inside windows of 8 words that stand twice or more in the list, first ones included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = rolling((hashes or WordHash()).array(words), WINDOW, 0x9E3779B97F4A7C15)
    if len(np.unique(h)) == n:  # equal windows have equal hashes
        return 0
    ids: dict[bytes, int] = defaultdict(count().__next__)
    x = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    for size in (1, 2, 4):  # exact ranks of windows of 2, 4 and 8 words
        _, x = np.unique(x[:-size] * len(words) + x[size:], return_inverse=True)
    twice = np.bincount(x)[x] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts(text: bytes | None, hashes: WordHash) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper_words."""
    if not text:
        return (0,) * 7
    words = words_of(text)
    chars = len(text.decode("utf-8", "replace")) - (len(text) - sum(map(len, words)))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), lines, dup,
            repeated_words(words, hashes), sum(map(bytes.isupper, words)))


NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per row: id, stratum, the seven counts, base_failed. No shuffle."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("stratum", pa.string()), *[(n, pa.int64()) for n in NAMES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash(200_000)
        for batch in batches:
            got = [counts(t, hashes) for t in binary(batch, "text")]
            cols = list(zip(*got, strict=True)) if got else [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.string()), *[pa.array(c, pa.int64()) for c in cols]], schema=schema)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{stratum_col}` as string) stratum",
                           f"cast(`{text_col}` as string) text")
    out = rows.mapInArrow(released(run), "id long, stratum string, " + ", ".join(f"{n} long" for n in NAMES))
    return out.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), X binomial; summed from the largest term down."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    if k > n * p:
        return 1.0 - _upper(k + 1, n, p)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(1.0, total)


def _upper(k: int, n: int, p: float) -> float:
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i <= n and term > total * 1e-17:
        total += term
        term *= (n - i) * p / ((i + 1) * (1 - p))
        i += 1
    return min(1.0, total)


def choose_cutoff(good: np.ndarray, bad: np.ndarray, limit: float, level: float, share: float = 0.95) -> int | None:
    """The cutoff bin c (rows in bins above c are rejected), or None.

    Certified are the cutoffs, from the laxest on, whose bound on the share of good rows rejected stays within
    ``limit`` at ``level``. Of these it takes the laxest that still rejects ``share`` of the bad rows that any of them rejects.
    """
    n = int(good.sum())
    if not n:
        return None
    lost = np.concatenate([np.cumsum(good[::-1])[::-1][1:], [0]])  # good rows above each bin
    caught = np.concatenate([np.cumsum(bad[::-1])[::-1][1:], [0]])
    certified = []
    for c in range(len(good) - 2, -1, -1):
        if binomial_cdf(int(lost[c]), n, limit) > level:  # equivalent to: the exact upper bound is above the limit
            break
        certified.append(c)
    most = max((int(caught[c]) for c in certified), default=0)
    if not most:
        return None
    return next(c for c in certified if caught[c] >= share * most)


def pools(good: dict[str | None, int], alpha: float, delta: float) -> dict[str | None, int]:
    """Stratum -> number of its pool: as many pools as have good rows enough for a cutoff that loses none. Goes by sizes only, never by scores."""
    by_size = sorted(good, key=lambda s: (good[s], s is not None, s))
    for most in range(len(by_size), 0, -1):
        need = math.log(delta / most) / math.log1p(-alpha)
        k = sum(n < need for n in good.values())
        while k < len(by_size) and 0 < k and sum(good[s] for s in by_size[:k]) < need:
            k += 1
        if not k or sum(good[s] for s in by_size[:k]) >= need:
            return {s: max(0, i - max(k - 1, 0)) for i, s in enumerate(by_size)}
    return dict.fromkeys(by_size, 0)


def certify(measured: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05,
            id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row per stratum (as ``of``): a cutoff bin for each rule (null: none certified). All labelled rows count; the driver holds a number a stratum."""
    labelled = (labels.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{label_col}` as int) y").where("y in (0, 1) and id is not null")
                .groupBy("id").agg(F.min("y").alias("y")))
    rows = measured.where("not base_failed").join(labelled, "id")
    scored = rows.selectExpr("stratum", "y", *[f"least(({e}) div {STEP}, {BINS}) {k}" for k, e in RULES.items()])
    stacked = scored.selectExpr("stratum", "y", f"stack({len(RULES) + 1}, '', greatest({', '.join(RULES)}), " + ", ".join(f"'{k}', {k}" for k in RULES) + ") as (rule, bin)")
    bins = cut(stacked.groupBy("stratum", "rule", "bin").agg(
        F.sum("y").alias("good"), F.sum(F.lit(1) - F.col("y")).alias("bad")))
    found = pools({r[0]: r[1] for r in bins.where("rule = ''").groupBy("stratum").agg(F.sum("good")).collect()}, alpha, UNION * delta)  # a row a stratum
    pool = F.broadcast(measured.sparkSession.createDataFrame([*found.items()], "of string, pool int"))
    n, rules = max(found.values(), default=0) + 1, list(RULES)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts, caught = {}, {}
        for rule in ["", *rules]:
            mine = pdf[pdf["rule"] == rule]
            good, bad = (np.bincount(mine["bin"], mine[y], BINS + 1).astype(np.int64) for y in ("good", "bad"))
            c = choose_cutoff(good, bad, *((alpha / len(rules), (1 - UNION) * delta / (n * len(rules))) if rule else (alpha, UNION * delta / n)))
            cuts[rule], caught[rule] = c, 0 if c is None else int(bad[c + 1:].sum())
        if caught[""] >= max(caught[r] for r in rules):
            cuts = dict.fromkeys(cuts, cuts[""])
        return pd.DataFrame([{"pool": pdf["pool"].iloc[0]} | {"cut_" + r: cuts[r] for r in rules}]).astype({"cut_" + r: "Int64" for r in rules})

    each = bins.join(pool, F.col("stratum").eqNullSafe(F.col("of"))).groupBy("pool").applyInPandas(pick, "pool int, " + ", ".join(f"cut_{r} long" for r in rules))
    table = each.join(pool, "pool").drop("pool")
    return F.broadcast(table) if len(found) <= BROADCAST_STRATA else table


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, id_col: str = "doc_id",
          text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per document: the counts, base_failed, the rules it breaks, kept."""
    measured = cut(measure(docs, id_col, text_col, stratum_col))  # narrow rows; read twice
    cuts = certify(measured, labels, alpha, delta, id_col)
    broken = F.filter(F.array(*[
        F.when(F.expr(f"least(({e}) div {STEP}, {BINS}) > cut_{k}"), F.lit(k)) for k, e in RULES.items()]), lambda x: x.isNotNull())
    out = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("broken", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(broken))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken", "stratum", "n_lines", "n_upper_words")


#: DuckDB: counts and the base rule.
BASE_ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS p, len(l) AS n FROM w),
k AS (SELECT doc_id, p, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS t FROM e),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t) AS o FROM k WHERE p + 7 <= n),
c AS (SELECT doc_id, count(DISTINCT q) AS repeated FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM r WHERE o > 1) GROUP BY doc_id),
d AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^ \t-\r]') GROUP BY doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, length(array_to_string(l, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(repeated, 0)::BIGINT AS n_repeat_words, len(l) < 20 OR 100 * coalesce(repeated, 0) > 30 * len(l) AS base_failed
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id
"""
