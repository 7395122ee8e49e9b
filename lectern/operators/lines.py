"""Lines and ranges of documents. ``documents`` has id and text at least."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, line_count, line_windows, raw_lines, without_ending

WINDOW_LINES, SUMMED = 32, 256


def lines(documents: DataFrame) -> DataFrame:
    """(id, line from 1, raw, content, byte_start, byte_end)."""
    each = documents.select("id", F.posexplode(raw_lines(F.col("text"))).alias("n", "raw"))
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("raw").cast("long")
    return each.select("id", (F.col("n") + 1).alias("line"), "raw", without_ending(F.col("raw")).alias("content"),
                       (F.sum(size).over(before) - size).alias("byte_start"), F.sum(size).over(before).alias("byte_end"))


def line_counts(documents: DataFrame) -> DataFrame:
    return documents.select("id", F.size(raw_lines(F.col("text"))).alias("lines"))


def read_range(documents: DataFrame, first: int, last: int) -> DataFrame:
    """(id, line_end, text): lines first..last of each document that has them; only a document's own last line keeps its ending."""
    own = raw_lines(F.col("text"))
    part = documents.select("id", own.alias("l")).where(F.size("l") >= max(first, 1))
    end = F.least(F.lit(last), F.size("l"))
    body = F.array_join(F.slice("l", F.lit(first), end - first + 1), "")
    return part.select("id", end.alias("line_end"), F.when(end == F.size("l"), body).otherwise(without_ending(body)).alias("text"))


def starts(sizes: Column) -> Column:
    """Sums of all elements before each one, in two levels: by blocks of SUMMED, and inside a block."""
    add = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / SUMMED)), lambda j: add(F.slice(sizes, j.cast("int") * SUMMED + 1, F.lit(SUMMED))))
    # bound by an aggregation over one element, so that each level is worked out once
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    before = lambda b: F.transform(b, lambda _, j: add(F.slice(b, F.lit(1), j)))
    inside = lambda o: F.transform(sizes, lambda _, k: F.get(o, F.floor(k / SUMMED).cast("int")) + add(F.slice(sizes, F.floor(k / SUMMED).cast("int") * SUMMED + 1, k % SUMMED)))
    return F.when(F.size(sizes) > 0, once(blocks, lambda b: once(before(b), inside)))


def passages(documents: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """Tumbling windows of ``size`` lines that hold more than white space: (id, first_line, last_line, first_byte, last_byte, content).

    A window is one match of a pattern, and carries nothing of the others, so work and memory are linear in the text; building windows shuffles nothing.
    """
    cut = documents.select("id", line_windows(F.col("text"), size).alias("w"))
    sized = cut.select("id", "w", F.transform("w", lambda x: F.octet_length(x).cast("long")).alias("z"))
    whole = F.transform("z", lambda _, k: k + 1 < F.size("z"))  # inside each element: a size taken later would carry the array along with every window
    placed = sized.select("id", F.posexplode(F.arrays_zip(F.col("w").alias("content"), starts(F.col("z")).alias("first_byte"), whole.alias("whole"))).alias("k", "x"))
    content, first = F.col("x.content"), F.col("k") * size + 1
    last = F.when(F.col("x.whole"), F.col("k") * size + size).otherwise(F.col("k") * size + line_count(content))
    return placed.where(content.rlike(rf"[^{SPACE}]")).select("id", first.alias("first_line"), last.alias("last_line"), F.col("x.first_byte").alias("first_byte"),
                                                               (F.col("x.first_byte") + F.octet_length(content)).alias("last_byte"), content.alias("content"))
