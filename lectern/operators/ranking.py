"""BM25 over passages: postings, corpus statistics, scores, one hit per returned range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import fold, query_terms, raw_lines, tokens, without_ending

#: The ranking function's usual parameters, and the least weight of a term that half of the passages or more hold.
K1, B, FLOOR = 1.2, 0.75, 1e-6


def postings(passages: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, tf, n_tokens). Occurrences are summed before the shuffle as well as after it."""
    own = passages.select(*keys, tokens(F.col("content")).alias("t")).select(*keys, F.size("t").alias("n_tokens"), F.explode("t").alias("term"))
    return own.groupBy(*keys, "term", "n_tokens").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def document_frequencies(passages: DataFrame) -> DataFrame:
    """(term, df) over all passages."""
    return passages.select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    value = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(value <= 0, F.lit(FLOOR)).otherwise(value)


def _equal_to(term: str) -> Column:
    return F.filter("_t", lambda x: x == F.lit(term))


def hits(passages: DataFrame, query: str) -> DataFrame:
    """Passages with a term of the query, with score (lower is better). Columns of ``passages`` stay.

    Frequencies of the few query terms are counted inside each row; statistics are one row, made by one partial aggregation, and
    cover exactly these passages. Terms that fold to the same token count once each.
    """
    wanted = [w for t in query_terms(query) if (w := fold(t))]
    if not wanted:
        return passages.withColumn("score", F.lit(0.0)).limit(0)
    # through a generator, which no filter is pushed below: else each use of the counts would cut the text into tokens again
    own = passages.withColumn("_t", tokens(F.col("content"))).select(*passages.columns, F.explode(F.array(F.struct(
        F.size("_t").alias("_len"), F.array(*[F.size(_equal_to(w)) for w in wanted]).alias("_tf")))).alias("_c"))
    counted = own.select(*passages.columns, "_c._len", "_c._tf")
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[
        F.sum((F.col("_tf")[k] > 0).cast("long")).alias(f"_df{k}") for k in range(len(wanted))])
    scored = counted.where(F.exists("_tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # of one row
    total = F.lit(0.0)
    for k in range(len(wanted)):
        tf = F.col("_tf")[k].cast("double")
        total = total - idf(F.col("_n"), F.col(f"_df{k}")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return scored.withColumn("score", total).select(*passages.columns, "score")


def distinct_ranges(found: DataFrame) -> DataFrame:
    """The best hit (score, then first line) of each returned range: the context where ``expand``, else the passage."""
    first, last = (F.when(F.col("expand"), F.col(a)).otherwise(F.col(b)) for a, b in (("context_first", "first_line"), ("context_last", "last_line")))
    ranged = found.withColumn("range_first", first).withColumn("range_last", last)
    order = Window.partitionBy("id", "range_first", "range_last").orderBy("score", "first_line")
    return ranged.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def top(found: DataFrame, limit: int, offset: int = 0, *order: str) -> DataFrame:
    """A page of hits by score, rounded so that summation order can't decide, then document and line."""
    return found.orderBy(F.round("score", 12), *(order or ("id",)), "first_line").offset(offset).limit(limit)


def with_text(page: DataFrame, documents: DataFrame) -> DataFrame:
    """A page of hits with the text of their ranges, joined late; only a document's own last line keeps its ending."""
    shown = page.join(documents.select("id", "text", "hash", "historical"), "id")
    text = F.array_join(F.slice(raw_lines(F.col("text")), F.col("range_first"), F.col("range_last") - F.col("range_first") + 1), "")
    return shown.withColumn("_text", F.when(F.col("range_last") == F.size(raw_lines(F.col("text"))), text).otherwise(without_ending(text))).drop("text")
