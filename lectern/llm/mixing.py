"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source of n rows with target weight w gets the mean repetition rate N * w / n, N being all rows (or ``budget``).
Each row's count is the inverse of the Poisson distribution with that mean at a uniform number taken
from a hash of (seed, id): the same on every run and on every executor that repeats a lost task. Rows
are exploded by their count and dealt out to partitions by a hash of (seed, id, copy), sorted by it inside: a
global shuffle with one exchange. Rates are broadcast where their size allows; else they are joined with the rows by source and a salt,
so that a hot source isn't one task's.

Rules: without given weights a source's weight is n ** temperature; given weights are normalized
over the sources present, a source without one gets none of the rows; a null source is a source; repeated rows
of one id get the same count each; a null id hashes as the empty string; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, unused

#: Numbers in all sources' distribution functions up to which these go to every executor (8 MB); beyond, rows are joined by source.
BROADCAST_NUMBERS = 1_000_000
#: Tasks that the rows of a source go to where rates are joined by source.
SALTS = 16


def uniform(*parts: str) -> str:
    """SQL for a number in [0, 1) of 52 bits from the hash of parts, which are SQL strings."""
    return f"cast(conv(substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13), 16, 10) as bigint) / 4503599627370496D"


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5,
          budget: float | None = None) -> DataFrame:
    """One row per source: rows, mean rate, and the Poisson distribution function at 0, 1, ... until it is 1."""
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_rows"))
    if weights is None:
        sizes = sizes.withColumn("mix_weight", F.expr(f"pow(cast(mix_rows as double), {float(temperature)}D)"))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "mix_key string, mix_weight double")
        sizes = sizes.join(given, F.col("mix_source").eqNullSafe(F.col("mix_key")), "left").select(
            "mix_source", "mix_rows", F.coalesce("mix_weight", F.lit(0.0)).alias("mix_weight"))
    sizes = cut(sizes)
    rows, weight = sizes.agg(F.sum("mix_rows"), F.sum("mix_weight")).first()
    whole = float(budget if budget is not None else rows or 0)
    out = sizes.withColumn("mix_rate", F.when(F.lit(bool(weight)), F.lit(whole) * F.col("mix_weight") / F.lit(float(weight or 1)) / F.col("mix_rows")).otherwise(0.0))
    # logarithms of the terms, so that large means don't underflow
    return out.withColumn("mix_cdf", F.expr("""case when mix_rate > 0 then
        aggregate(sequence(1, cast(ceil(mix_rate + 12 * sqrt(mix_rate) + 30) as int)),
            named_struct('lp', -mix_rate, 'c', array(exp(-mix_rate))),
            (a, k) -> named_struct('lp', a.lp + ln(mix_rate / k), 'c', array_append(a.c, element_at(a.c, -1) + exp(a.lp + ln(mix_rate / k)))),
            a -> a.c) else array(1D) end"""))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None,
        temperature: float = 0.5, budget: float | None = None, seed: int = 0) -> DataFrame:
    """All columns of ``docs`` for each copy of a row, with copy_no (from 1) and shuffle_key; any columns of these names are replaced."""
    mark = unused(docs)
    named = [F.col(c).alias(f"{mark}{c}") for c in ("mix_source", "mix_cdf")]
    table = rates(docs, source_col, weights, temperature, budget).select(*named)
    numbers = table.agg(F.sum(F.size(f"{mark}mix_cdf"))).first()[0] or 0
    key = f"coalesce(cast(`{id_col}` as string), '')"
    keep = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    own, same = docs.select(*keep), F.col(source_col).eqNullSafe(F.col(f"{mark}mix_source"))
    if numbers <= BROADCAST_NUMBERS:
        joined = own.join(F.broadcast(table), same)
    else:  # a source's rows are dealt to SALTS tasks, each with a copy of its rates
        salt = f"{mark}salt"
        salted = table.withColumn(f"{salt}ed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn(salt, F.expr(f"cast(pmod(xxhash64({key}), {SALTS}) as int)")).join(salted, same & (F.col(salt) == F.col(f"{salt}ed")))
    drawn = F.expr(f"size(filter({mark}mix_cdf, c -> c <= {uniform(repr(f'mix{seed}'), key)}))")
    # through a generator: the optimizer would push the filter to the side of the rates, which doesn't have the ids
    counted = joined.select(*keep, F.explode(F.array(drawn)).alias(f"{mark}n")).where(F.col(f"{mark}n") > 0)
    copies = counted.select(*keep, F.explode(F.sequence(F.lit(1), F.col(f"{mark}n"))).alias("copy_no"))
    order = f"conv(substr(md5(concat_ws(':', {f'order{seed}'!r}, {key}, cast(copy_no as string))), 1, 15), 16, 10)"
    return copies.withColumn("shuffle_key", F.expr(f"cast({order} as bigint)")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: DuckDB: the same with the defaults, over documents.
ORACLE = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (SELECT source, (SELECT sum(n) FROM sizes)::DOUBLE * sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM sizes) / n AS rate FROM sizes),
terms AS (
  SELECT source, rate, 0 AS k, -rate AS lp, exp(-rate) AS cdf FROM rated
  UNION ALL
  SELECT source, rate, k + 1, lp + ln(rate / (k + 1)), cdf + exp(lp + ln(rate / (k + 1))) FROM terms WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (SELECT d.*, ('0x' || substr(md5('mix0:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents d),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.k + 1 AS copy_no FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.cdf <= d.u)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no,
       ('0x' || substr(md5('order0:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM counted
"""
