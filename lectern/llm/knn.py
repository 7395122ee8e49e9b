"""Exact top-k search by a Voronoi kNN join.

Vectors become whole numbers, floor(256 * x), and the score is their inner product. With M2 the largest squared norm of
any vector, a vector x is given one more coordinate sqrt(M2 - |x|^2) and a query a zero there, so that the largest inner products are
the smallest Euclidean distances: |q - x|^2 = |q|^2 + M2 - 2 q.x.

1. A bounded sample gives pivots; every vector and query goes to the cell of its nearest pivot (one narrow pass).
2. Cell summaries (size, radius, the k + 1 least distances to the pivot among distinct ids) are aggregated; they are pivots * 2 (k + 2) numbers. For the queries of a
   cell they give a radius theta within which k neighbours of each query are sure to be.
3. Query cells are put into groups of neighbouring cells that hold GROUP_QUERIES queries at most (a cell with more makes several groups), so that a task can hold
   a group's queries. A vector goes once to each group, not to each cell, of which some cell's lower bound |p_i p_j| - r_i - |s p_j| is within theta.
   Groups are split into blocks by a hash of the vector's id, so no task gets an unbounded group.
4. Each (group, block) is solved by integer matrix products, cell by cell, and only with the vectors that the cell's bound lets through; k best of each block meet in one last grouping.

Rules: vectors that are null, empty, or hold null or non-finite components take no part, nor do those with a component outside 64 bits once it is a whole number;
vectors of another length than the most common one take none either; scores beyond 64 bits count as the end of that range; ties go to the smaller id;
repeated ids are each a candidate but never of their own id; a query id that
stands repeatedly is asked once, with the least of its vectors; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import cut, mix64, released

PIVOT_SAMPLE, MOST_PIVOTS, BLOCK_ROWS, GROUP_QUERIES = 4_096, 1_024, 100_000, 20_000
#: Whole numbers that a long surely holds after the rounding of doubles.
WIDEST = 2.0**62


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v: array<long>) of the vectors that take part, but for their length."""
    ok = f"size(`{vec_col}`) > 0 and forall(`{vec_col}`, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity') and abs(256D * cast(x as double)) <= {WIDEST!r}D)"
    return df.where(f"`{id_col}` is not null and {ok}").selectExpr(f"cast(`{id_col}` as long) id", f"transform(`{vec_col}`, x -> cast(floor(256D * cast(x as double)) as bigint)) v")


def matrix(col: pa.Array) -> np.ndarray:
    """A list<long> column of equal lengths as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.int64)


def lifted(v: np.ndarray, m2: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(m2 - (x * x).sum(1, keepdims=True), 0))], 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Well separated rows of a sample."""
    picked, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(n, len(x)):
        k = int(near.argmax())
        if near[k] <= 0:
            break
        picked.append(k)
        near = np.minimum(near, ((x - x[k]) ** 2).sum(1))
    return x[picked]


def query_groups(between: np.ndarray, asked: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """Cell -> (its first group, number of its groups): cells with up to ``most`` queries in all share a group, each the nearest left to the one before."""
    out: dict[int, tuple[int, int]] = {}
    left, cell, group, held = set(asked), min(asked, default=0), 0, 0
    while left:
        left.discard(cell)
        if held and held + asked[cell] > most:
            group, held = group + 1, 0
        n = -(-asked[cell] // most)
        out[cell] = group, n
        held += asked[cell]
        if n > 1:
            group, held = group + n, 0
        if left:
            near = np.fromiter(left, np.int64)
            cell = int(near[between[cell, near].argmin()])
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as longs, ends of the range standing for what is beyond."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if bound < 2**53:  # every sum is exact in doubles
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          pivots: int | None = None, sample: int = PIVOT_SAMPLE, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """Per query its k best: query_id, rank (from 1), vec_id, score."""
    spark = data.sparkSession
    schema = T.StructType.fromDDL("query_id long, rank int, vec_id long, score long")
    all_data, all_queries = integers(data, id_col, vec_col), integers(queries, id_col, vec_col)
    width = all_data.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], schema)
    dim = width["n"]
    vecs, asks = all_data.where(F.size("v") == dim), all_queries.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    m2, total = vecs.agg(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + cast(x as double) * cast(x as double))")), F.count(F.lit(1))).first()
    chosen = vecs.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").collect()  # at most `sample` rows
    pivots = pivots or min(MOST_PIVOTS, max(16, int(total**0.5) // 7))
    centres = farthest_first(lifted(np.array([r["v"] for r in chosen], np.int64), m2), pivots)

    def placed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = matrix(batch.column(1))
                x = np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], 1) if query else lifted(v, m2)
                d = distances(x, centres)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "d"])
        return run

    ddl = "id long, v array<long>, cell int, d double"
    # written once: both are read by the summaries and by the join
    here, there = cut(vecs.mapInArrow(released(placed(False)), ddl)), cut(asks.mapInArrow(released(placed(True)), ddl))
    cells = {r["cell"]: r for r in _nearest(here, k + 1).collect()}  # at most `pivots` rows of 2 k + 5 numbers
    reach = {r["cell"]: r for r in there.groupBy("cell").agg(F.max("d").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    between = distances(centres, centres)
    slack = 1e-6 * (1 + np.sqrt(m2))
    least = np.full((len(centres), len(centres)), np.inf)  # [query cell, data cell]: the least distance to the own pivot that matters
    for i, q in reach.items():
        upper: dict[int, float] = {}
        for j, c in cells.items():
            for d, who in c["near"]:
                upper[who] = min(upper.get(who, np.inf), q["r"] + between[i, j] + d)
        theta = sorted(upper.values())[k] if len(upper) > k else np.inf  # k ids besides a query's own
        least[i] = np.maximum(0.0, between[i] - q["r"] - theta - slack)
    groups = query_groups(between, {i: q["n"] for i, q in reach.items()}, group_queries)
    members: dict[int, list[int]] = {}
    for i, (g, n) in groups.items():
        for x in range(g, g + n):
            members.setdefault(x, []).append(i)
    needs = {g: least[cs].min(0) for g, cs in members.items()}  # of a group: the least distance by data cell
    blocks = {g: max(1, -(-sum(c["n"] for j, c in cells.items() if c["r"] >= needs[g][j]) // block_rows)) for g in members}

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cell, d = (batch.column(c).to_numpy() for c in (0, 2, 3))
            for g, need in needs.items():
                hit = np.flatnonzero(d >= need[cell])
                if len(hit):
                    r = pa.array(hit)
                    yield pa.RecordBatch.from_arrays([*(c.take(r) for c in batch.columns), pa.array(np.full(len(hit), g, np.int32)), pa.array((mix64(ids[hit]) % np.uint64(blocks[g])).astype(np.int32))],
                                                     ["id", "v", "cell", "d", "grp", "block"])

    pairs = F.array(*[F.struct(F.lit(groups[i][0]).alias("g"), F.lit(groups[i][1]).alias("n")) if i in groups else F.struct(F.lit(0).alias("g"), F.lit(1).alias("n")) for i in range(len(centres))])
    own = F.element_at(pairs, F.col("cell") + 1)
    per_group = F.array(*[F.lit(blocks[g]) for g in range(len(members))] or [F.lit(1)])
    placed_queries = there.select("id", "v", "cell", (own["g"] + F.pmod(F.xxhash64("id", F.lit(3)), own["n"])).cast("int").alias("grp"))
    left = placed_queries.select("id", "v", "cell", "grp", F.explode(F.sequence(F.lit(0), F.element_at(per_group, F.col("grp") + 1) - 1)).alias("block"))
    right = here.mapInArrow(released(replicate), "id long, v array<long>, cell int, d double, grp int, block int")

    def solve(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not q.empty and not s.empty:
            s = s.sort_values("id", kind="stable")
            ids, b, cell, d = s["id"].to_numpy(), np.stack(s["v"]), s["cell"].to_numpy(), s["d"].to_numpy()
            for i, some in q.groupby("cell"):
                near = np.flatnonzero(d >= least[int(i)][cell])
                there, wide = ids[near], b[near]
                a, qids = np.stack(some["v"]), some["id"].to_numpy()
                for at in range(0, len(a), 64):
                    for qid, row in zip(qids[at:at + 64], products(a[at:at + 64], wide)):
                        ok = np.flatnonzero(there != qid)
                        out += [(qid, there[t], int(row[t])) for t in ok[_best(row[ok], k)]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        got = rows.groupBy("query_id", *keys).agg(F.expr(f"slice(array_sort(collect_list(struct(-1 - score as s, vec_id as vec_id))), 1, {k})").alias("b"))
        return got.select("query_id", F.posexplode("b").alias("pos", "b")).select("query_id", "pos", F.col("b.vec_id").alias("vec_id"), (F.lit(-1) - F.col("b.s")).alias("score"))

    found = left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInPandas(solve, "query_id long, vec_id long, score long")
    if max(blocks.values(), default=1) > 64:
        found = best(found.withColumn("some", F.pmod(F.xxhash64("vec_id"), F.lit(64))), "some")
    return best(found).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "vec_id", "score")


def _best(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the first."""
    if len(row) > 4 * k:
        edge = np.partition(row, len(row) - k)[len(row) - k]
        some = np.flatnonzero(row >= edge)
        return some[np.argsort(~row[some], kind="stable")[:k]]
    return np.argsort(~row, kind="stable")[:k]


def _nearest(placed: DataFrame, k: int) -> DataFrame:
    """Per cell: rows, radius, the k least (distance, id) of distinct ids; a partition passes on one row a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, float, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell, d, ids = (c.to_numpy() for c in batch.columns)
            for c in np.unique(cell).tolist():
                mine = cell == c
                n, r, near, who = held.get(c, (0, 0.0, d[:0], ids[:0]))
                near, who = np.concatenate([near, d[mine]]), np.concatenate([who, ids[mine]])
                order = np.lexsort((who, near))
                first = np.sort(np.unique(who[order], return_index=True)[1])[:k]  # the nearest of each id
                held[c] = n + int(mine.sum()), max(r, d[mine].max()), near[order][first], who[order][first]
        cs = list(held)
        kind = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int32()), pa.array([held[c][0] for c in cs], pa.int64()), pa.array([held[c][1] for c in cs], pa.float64()),
                                          pa.array([[{"d": x, "id": i} for x, i in zip(*map(np.ndarray.tolist, held[c][2:]), strict=True)] for c in cs], kind)], ["cell", "n", "r", "near"])

    parts = placed.select("cell", "d", "id").mapInArrow(released(run), "cell int, n long, r double, near array<struct<d: double, id: long>>")
    sizes = parts.select("cell", "n", "r", F.explode("near").alias("x"), F.col("near")[0].alias("head")).withColumn("lead", F.col("x") == F.col("head"))
    each = sizes.groupBy("cell", F.col("x.id").alias("id")).agg(F.min("x.d").alias("d"), F.sum(F.when(F.col("lead"), F.col("n")).otherwise(0)).alias("n"), F.max("r").alias("r"))
    return each.groupBy("cell").agg(F.sum("n").alias("n"), F.max("r").alias("r"), F.expr(f"slice(array_sort(collect_list(struct(d, id))), 1, {k})").alias("near"))


#: DuckDB: all pairs of the stated queries with all rows.
ORACLE = """
WITH ok AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
part AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, floor(256.0::DOUBLE * unnest(embedding)::DOUBLE)::BIGINT AS x FROM ok),
scored AS (SELECT q.vec_id AS query_id, s.vec_id AS vec_id, sum(q.x * s.x)::BIGINT AS score FROM part q JOIN part s ON q.i = s.i AND q.vec_id <> s.vec_id
           WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, s.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
