"""What the operators of this subpackage share: words, Arrow access, checkpoints, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than space and \\t..\\r; the split of bytes uses exactly those six."""
    return text.split() if text else []


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def texts(batch: pa.RecordBatch, name: str) -> list[str | None]:
    """A string column as str; bytes that are not UTF-8 become U+FFFD."""
    return [None if b is None else b.decode("utf-8", "replace") for b in binary(batch, name)]


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts can be long: keep Arrow batches at a bounded number of rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving free memory back to the system when its task ends: workers outlive tasks, and a long text leaves much of it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A temporary one only in a single process (tests): executors of a cluster could not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lectern-ckpt-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Bytes of a checkpoint that a task reads at least, so that small results don't keep as many tasks as the shuffle they come from.
PART_BYTES = 1 << 20


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of plans that are made inside go when these have run, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder and cut its lineage; the shuffles that it took leave the disk at once."""
    spark = df.sparkSession
    where = checkpoint_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    with shuffles_released(spark):
        out = df.select("*").checkpoint(eager=True)  # a plan of its own, which nothing else runs again
    rdd = out._jdf.queryExecution().logical().rdd()
    path = spark._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    parts = max(1, -(-size // PART_BYTES))
    return out.coalesce(parts) if parts < rdd.getNumPartitions() else out


def unused(df: DataFrame) -> str:
    """A beginning that no column's name has."""
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    return mark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys of a join that are looked at as heavy, at most.
HEAVY_KEYS = 65_536


def heavy_join(rows: DataFrame, table: DataFrame, key: str | list[str], count_col: str, least: int = 128, narrow: str = "true") -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and the number of rows with that key, without one task for a hot key.

    Keys with more than ``least`` rows are broadcast, and their rows aren't shuffled; where these are more than HEAVY_KEYS, it is those with more than their share of
    1 / HEAVY_KEYS of all rows, which can't be.
    ``narrow`` is a condition on rows of ``table`` that bounds the size of those that may be broadcast, where their columns don't.
    """
    keys = [key] if isinstance(key, str) else key
    heavy = f"{count_col} > {least} and coalesce({narrow}, false)"
    hot = cut(table.where(heavy))
    n = hot.count()
    if n > HEAVY_KEYS:
        heavy += f" and {count_col} > {table.agg(F.sum(count_col)).first()[0] // HEAVY_KEYS}"
        hot = hot.where(heavy)
    if not n:
        return rows.join(table, keys)
    light = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(f"not ({heavy})"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(light)


#: Edges that one task holds at once while it contracts them.
LOCAL_EDGES = 250_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, with the same components: each task replaces runs of up to LOCAL_EDGES of its edges by stars around their least nodes."""
    node = edges.dtypes[0][1]
    kind = {"bigint": pa.int64(), "binary": pa.binary()}[node]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        seen = 0

        def find(x):
            top = x
            while (up := root.get(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root[x]
            return top

        def flush() -> Iterator[pa.RecordBatch]:
            nodes = [x for x in root if find(x) != x]
            for k in range(0, len(nodes), 65_536):
                some = nodes[k:k + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([root[x] for x in some], kind)], ["u", "v"])
            root.clear()

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = root.setdefault(min(a, b), min(a, b))
            seen += batch.num_rows
            if seen >= LOCAL_EDGES:
                yield from flush()
                seen = 0
        yield from flush()

    return edges.mapInArrow(released(run), f"u {node}, v {node}")


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list (a, b: long or binary): rows (node, component = smallest node).

    Tasks first contract the edges they hold, a bounded number at a time. What is left, if more than one task's worth,
    goes through alternating large-star and small-star steps (Kiveris et al. 2014); each is a grouped minimum, so no
    component is ever gathered in one task, and rounds grow with the logarithm of the longest chain.
    Every round is checkpointed. Nodes without an edge are not returned.
    """
    cur = cut(contracted(edges.where("a is not null and b is not null and a <> b").select("a", "b")))
    parts = -(-cur.count() // LOCAL_EDGES)
    cur = cut(contracted(cur.coalesce(max(1, parts))))
    sig = None
    for _ in range(max_rounds if parts > 1 else 0):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        cur = cut(small.where("u <> v").distinct())
        got = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == sig:
            break
        sig = got
    else:
        if parts > 1:
            raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered up to a fixed number of words."""

    def __init__(self, limit: int = 200_000, seed: int = 0):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self.f, self.limit, self.seed = xxh3_64_intdigest, limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        v = self[word] = self.f(word, self.seed)
        return v

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of all k-long windows of h (uint64, modulo 2^64), by doubling. Needs len(h) >= k >= 1."""
    mask = (1 << 64) - 1
    out, have, cur, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out, have = cur, size
            else:  # windows of `size` come first, then those already gathered
                n = len(h) - have - size + 1
                out = cur[:n] * np.uint64(pow(base, have, mask + 1)) + out[size:size + n]
                have += size
        size *= 2
        if size > k:
            return out
        half = size // 2
        cur = cur[:len(cur) - half] * np.uint64(pow(base, half, mask + 1)) + cur[half:]


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """For each w-long window of x, the index of its leftmost minimum."""
    n = len(x) - w + 1
    idx, size = np.arange(len(x)), 1
    while size < w:
        step = min(size, w - size)
        left, right = idx[:len(idx) - step], idx[step:]
        idx = np.where(x[right] < x[left], right, left)
        size += step
    return idx[:n]


def arrow_rows(schema: pa.Schema, cols: list[list | np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of consecutive rows that agree in the first ``keys`` columns; the input is sorted by them."""
    held, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != held:
                if rows:
                    yield held, rows
                held, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield held, rows
