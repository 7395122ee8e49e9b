"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

A document's set is its distinct word shingles; documents with equal sets are one from the start, under their smallest id.
1. Each distinct set gets a signature of COORDINATES minima and is posted under every (coordinate, value) pair.
2. Posting lists are counted. Two sets that agree in ``least`` coordinates or more share one of the COORDINATES - least + 1 rarest
   pairs of each (prefix); sets with so many pairs of their own alone can have no partner. Only prefix lists are merged;
   the long lists beyond are skipped, and looked up in the signatures of pairs that the prefix lists bring together.
3. The first set of each prefix list is its head. Every member meets the heads of its lists, in groups of one head and at most about MEET members:
   collisions are counted, and a pair above the match threshold is confirmed on the full sets. This deals a set once a head, however long a list is, and
   joins most of what belongs together.
4. Lists whose members, but for the head, still fall in several components are cut into blocks by a hash; each pair of blocks is one group of bounded
   size, where members of different components are compared in the same way, each pair in the first list that both share. Only confirmed links leave a
   task, and nothing is ever tied together that isn't confirmed.
5. Components of the links are found by rounds of grouped minima.

``least`` lies five standard deviations below what a pair at the threshold agrees in on average, so that a
link is lost with a probability of about one in a hundred thousand.

Rules: words are those of the bytes after lower-casing A-Z; a text of fewer words than a shingle has the whole sequence as
its one shingle; a text without words, or null, has an empty set and is linked with nothing; rows that share an id are one document, linked through
any of their texts, with the least of their set sizes; each row without an id is a document of its own that is linked with nothing and kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WordHash, binary, components, cut, groups, heavy_join, mix64, released, rolling, small_batches, words_of

COORDINATES = 64
#: Sets in a block, and members that meet one copy of a head.
BLOCK, MEET = 128, 128
LOWER = bytes(range(256)).lower()
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def least_matches(percent: int) -> int:
    j = percent / 100
    return max(1, int(COORDINATES * j - 5 * (COORDINATES * j * (1 - j)) ** 0.5))


def shingle_set(text: bytes | None, k: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    words = words_of(text.translate(LOWER)) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    size = min(k, len(words))
    return np.unique(mix64(rolling(hashes.array(words), size, 0x9E3779B97F4A7C15) + np.uint64(size)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Upper 32 bits of the least value of each of the COORDINATES permutations."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        best = np.minimum(best, (shingles[at:at + 1024, None] * _MUL + _ADD).min(0))
    return (best >> np.uint64(32)).astype(np.uint32)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, g, text); g, a hash of the text, tells rows of one id apart."""
    return docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text").select("id", F.xxhash64("text").alias("g"), "text")


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, g, n, key, sig): set size, digest of the set (null: empty), signature as little-endian 32-bit integers."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("g", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            sets = [shingle_set(t, k, hashes) for t in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s).astype("<u4").tobytes() if len(s) else None for s in sets], pa.binary())], schema=schema)

    return _documents(docs, id_col, text_col).mapInArrow(released(run), "id long, g long, n long, key binary, sig binary")


def _tokens(reps: DataFrame) -> DataFrame:
    """(token, id, g): every coordinate-value pair of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").astype(np.int64).reshape(-1, COORDINATES)
                yield pa.RecordBatch.from_arrays([pa.array((sig + place).ravel()), *(pa.array(np.repeat(batch.column(c).to_numpy(), COORDINATES)) for c in (0, 1))], ["token", "id", "g"])

    return reps.select("id", "g", "sig").mapInArrow(released(run), "token long, id long, g long")


def prefixes(reps: DataFrame, least: int) -> DataFrame:
    """(id, g, tokens): of each set, the shared pairs among its COORDINATES - least + 1 rarest; sets without any are left out."""
    tokens = _tokens(reps)
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    mine = tokens.join(shared, "token").groupBy("id", "g").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("t"))  # 64 at most
    room = F.lit(COORDINATES - least + 1) - (F.lit(COORDINATES) - F.size("t"))  # what pairs of its own leave of the prefix
    return mine.where(room > 0).select("id", "g", F.expr("transform(t, x -> x.token)").alias("t"), room.alias("room")).select("id", "g", F.slice("t", 1, F.col("room")).alias("tokens"))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Sets:
    """Sets and signatures of texts, made anew where they are compared."""

    def __init__(self, docs: DataFrame, k: int, id_col: str, text_col: str):
        self.texts, self.k = _documents(docs, id_col, text_col), k

    def dealt(self, wants: DataFrame, fields: str) -> DataFrame:
        """(fields, id, g, shingles, sig) for each of the structs of ``fields`` that the array ``want`` of a row (id, g, want) holds."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHash()
            for batch in batches:
                sets = [shingle_set(t, k, hashes) for t in binary(batch, "text")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 3)), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary()),
                                                  pa.array([signature(x).astype("<u4").tobytes() for x in sets], pa.binary())], ["id", "g", "want", "shingles", "sig"])

        found = self.texts.join(wants, ["id", "g"]).select("id", "g", "text", "want").mapInArrow(released(run), f"id long, g long, want array<struct<{fields}>>, shingles binary, sig binary")
        return found.select(F.explode("want").alias("w"), "id", "g", "shingles", "sig").select("w.*", "id", "g", "shingles", "sig")


def met_heads(pairs: DataFrame, sets: Sets, least: int, percent: int) -> DataFrame:
    """(a, b): confirmed links among pairs (id, g, head, head_g, c); c, the length of their longest common list, says into how many groups a head's members go."""
    # a power of two, so that a head has few numbers of groups
    sized = pairs.select("id", "g", "head", "head_g", F.expr(f"cast(pow(2, greatest(0, ceil(log2(c / {MEET})))) as int)").alias("groups"))
    key = ["head", "head_g", "groups"]
    members = sized.select("id", "g", F.struct(*key, F.pmod(F.xxhash64("id", "g"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("member")).alias("w"))
    heads = sized.select(*key).distinct().select(F.col("head").alias("id"), F.col("head_g").alias("g"), *key, F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    wants = members.unionByName(heads.select("id", "g", F.struct(*key, "part", F.lit(0).alias("member")).alias("w"))).groupBy("id", "g").agg(F.collect_list("w").alias("want"))
    dealt = sets.dealt(wants, "head: long, head_g: long, groups: int, part: int, member: int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = head = sig = None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("head", "head_g", "groups", "part", "member", "id", "shingles", "sig")]
            for *group, member, i, shingles, own in zip(*columns, strict=True):
                own, shingles = np.frombuffer(own, "<u4"), np.frombuffer(shingles, "<u8")
                if not member:
                    at, head, sig = group, shingles, own
                elif group == at and i != group[0] and 100 * min(len(head), len(shingles)) >= percent * max(len(head), len(shingles)) and (own == sig).sum() >= least and alike(head, shingles, percent):
                    out.append((i, group[0]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["a", "b"])

    return dealt.repartition(*key, "part").sortWithinPartitions(*key, "part", "member").mapInArrow(released(run), "a long, b long")


def confirm_links(rows: list[tuple], token: int, same: bool, least: int, percent: int) -> list[tuple[int, int]]:
    """Links among rows (block, id, component, tokens, set, sig) of one block of a list, or between two, that join what isn't connected yet."""
    n = len(rows)
    block = np.array([r[0] for r in rows])
    sets = [np.frombuffer(r[4], "<u8") for r in rows]
    size = np.array([len(s) for s in sets])
    sig = np.stack([np.frombuffer(r[5], "<u4") for r in rows])
    root = np.array([r[2] for r in rows])
    out = []
    for i in range(n - 1):
        rest = slice(i + 1, n)
        hit = root[rest] != root[i]
        if not same:
            hit &= block[rest] != block[i]
        if not hit.any():
            continue
        hit &= ((sig[rest] == sig[i]).sum(1) >= least) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))
        for j in (np.flatnonzero(hit) + i + 1).tolist():
            if root[i] != root[j] and min({*rows[i][3]}.intersection(rows[j][3])) == token and alike(sets[i], sets[j], percent):
                out.append((rows[i][1], rows[j][1]))
                root[root == root[j]] = root[i]
    return out


def met_in_lists(lists: DataFrame, sets: Sets, least: int, percent: int) -> DataFrame:
    """(a, b): confirmed links among members (token, id, g, component, m) of lists of m members."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = lists.select("id", "g", "component", "token", blocks.alias("blocks"), F.pmod(F.xxhash64("id", "g", F.lit(7)), blocks).cast("int").alias("block"))
    each = placed.groupBy("id", "g").agg(F.collect_list(F.struct("token", "blocks", "block", "component")).alias("w"), F.sort_array(F.collect_list("token")).alias("tokens"))  # as many as a prefix has
    wants = each.select("id", "g", F.expr("transform(w, x -> struct(x.token as token, x.blocks as blocks, x.block as block, x.component as component, tokens as tokens))").alias("want"))
    full = sets.dealt(wants, "token: long, blocks: int, block: int, component: long, tokens: array<long>")
    dealt = full.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "component", "tokens", "shingles", "sig", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groups(batches, 3):
            unique = list({(r[4], r[9]): r[3:9] for r in rows}.values())
            if len(unique) > 1 and (got := confirm_links(unique, key[0], key[1] == key[2], least, percent)):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got]), pa.array([x[1] for x in got])], ["a", "b"])

    return dealt.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(released(run), "a long, b long")


def links(docs: DataFrame, reps: DataFrame, known: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): the ``known`` links and confirmed ones, enough of them to connect what is connected."""
    spark, least, sets = docs.sparkSession, least_matches(percent), Sets(docs, k, id_col, text_col)
    prefix = cut(prefixes(reps, least).join(reps.select("id", "g", "n"), ["id", "g"]))
    posted = prefix.select("id", "g", "n", F.explode("tokens").alias("token"))
    heads = cut(posted.groupBy("token").agg(F.min(F.struct("id", "g", "n")).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    members = heavy_join(posted, heads, "token", "c").where("not (id = h.id and g = h.g)").select("token", "id", "g", "n", F.col("h.id").alias("head"), F.col("h.g").alias("head_g"), F.col("h.n").alias("head_n"), "c")
    near = f"id <> head and 100 * least(n, head_n) >= {percent} * greatest(n, head_n)"
    pairs = members.where(near).groupBy("id", "g", "head", "head_g").agg(F.max("c").alias("c"))
    first = cut(met_heads(pairs, sets, least, percent).unionByName(known))
    comp = components(spark, first).select(F.col("node").alias("id"), "component")
    joined = members.where("c > 2").select("token", "id", "g").join(comp, "id", "left").select("token", "id", "g", F.coalesce("component", "id").alias("component"))
    joined = cut(joined)
    open_ = joined.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("token", "m")
    lists = cut(heavy_join(joined, open_, "token", "m"))
    if lists.isEmpty():
        return first
    return cut(first.unionByName(met_in_lists(lists, sets, least, percent)))  # before Python contracts them: one worker a task


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id, and per row without one: n_shingles, component_id (smallest id reachable, itself included), kept (it is that smallest)."""
    base = cut(signatures(docs, k, id_col, text_col))
    some = base.where("id is not null and n > 0")
    heads = cut(some.groupBy("key").agg(F.min(F.struct("id", "g", "n", "sig")).alias("r"), F.count(F.lit(1)).alias("c")))
    reps = heads.select("r.id", "r.g", "r.n", "r.sig")
    several = some.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("id")  # ids with different texts
    known = some.join(several, "id").join(heads.select("key", "r.id").withColumnRenamed("id", "b"), "key").where("id <> b").select(F.col("id").alias("a"), "b")
    comp = components(docs.sparkSession, links(docs, reps, known, k, percent, id_col, text_col)).withColumnRenamed("component", "found")
    classes = heads.select("key", F.col("r.id").alias("head"), "c").join(comp, F.col("head") == F.col("node"), "left").select("key", F.coalesce("found", "head").alias("of_set"), "c")
    own = heavy_join(some.select("id", "n", "key"), classes, "key", "c").select("id", "n", "of_set")
    rest = base.where("id is not null and n = 0").select("id", "n", F.col("id").alias("of_set"))
    out = own.unionByName(rest).groupBy("id").agg(F.min("n").alias("n_shingles"), F.min(F.least("of_set", "id")).alias("component_id"))
    nameless = base.where("id is null").select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.select("id", "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept")).unionByName(nameless).withColumnRenamed("id", id_col)


#: DuckDB: all pairs of documents with a shingle in common, on full sets.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS p, len(l) AS n FROM w),
k AS (SELECT doc_id, p, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS t FROM e),
s AS (SELECT DISTINCT doc_id, t FROM k WHERE p + 2 <= n OR p = 1),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
h AS (SELECT a, b FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
u AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
reach AS (SELECT a AS doc_id, b AS other FROM u UNION SELECT reach.doc_id, u.b FROM reach JOIN u ON u.a = reach.other),
m AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id, coalesce(m.least, w.doc_id) >= w.doc_id AS kept
FROM w LEFT JOIN z ON z.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""
