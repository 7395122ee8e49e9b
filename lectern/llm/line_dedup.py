"""Near-duplicate lines by a segment-partition edit join.

Two lines are linked if at most EDITS = 2 insertions, deletions or substitutions of characters turn one into the other. A line split
into EDITS + 1 segments has one that the other line holds unchanged, near the same place.
1. Each line of a task, once, posts its segments under (length, segment number, content), and probes the index for its own length and those
   up to EDITS below, at the few starting places that the multi-match-aware bounds of the pass join leave. Contents are polynomial hashes made of
   array operations over a whole batch. Both go through one exchange.
2. The first index posting of each key is its head. Every other posting and every probe of the key meets the head: a list gives as many pairs as it has
   lines, never their square. The lines that meet anything are fetched, and the pairs verified by a banded bit-parallel edit distance; what is confirmed forms classes.
3. Lists whose lines, but for the head, still fall in several classes are cut into blocks by a hash; each pair of blocks is one group of bounded size, where
   postings are compared with postings and probes of other classes. Nothing is ever tied together that isn't confirmed.
4. Each class is cut into blocks in the same way, and in each pair of blocks the links of its lines are counted: segments are probed again, now line by line, and
   each candidate is verified. The first line of a class (smallest document id, then line number) stays, others go.

Rules: lines end at \\n and are compared without white space at both ends; of lines of fewer than MIN_CHARS characters, where two edits would make
unlike ones alike, no edit is allowed: they take part by equality; blank lines stay; equal lines are always of one class; null and empty texts
have no lines; rows that share an id and a text are one document, rows that share only the id are documents of their own, in the order of
their texts' hashes; a row without an id loses no line, and has none listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh3_128_intdigest

from lectern.llm.common import components, cut, groups, heavy_join, mix64, released, small_batches, texts, unused

EDITS, MIN_CHARS, BLOCK = 2, 24, 128
#: Lines whose places a join sends to every executor; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
SEEN = 300_000
_BASE = 0x9E3779B97F4A7C15
_ONES = (1 << 64) - 1
_WHITE = " \t\n\r\x0b\x0c"


def long_lines(text: str | None, least: int = MIN_CHARS) -> tuple[int, list[tuple[int, str]]]:
    """Number of lines that aren't blank, and (number from 0, line without outer white space) of those of ``least`` characters or more."""
    out, n = [], 0
    for i, line in enumerate(text.split("\n") if text else ()):
        line = line.strip(_WHITE)
        n += bool(line)
        if line and len(line) >= least:
            out.append((i, line))
    return n, out


def cuts(length: int | np.ndarray, i: int) -> tuple:
    """Start and length of segment i of EDITS + 1, the last ones being the longer by one."""
    n = EDITS + 1
    base, more = length // n, length % n
    extra = i - (n - more)
    if isinstance(length, np.ndarray):
        return i * base + np.maximum(extra, 0), base + (extra >= 0)
    return i * base + max(extra, 0), base + (extra >= 0)


def shifts(i: int, less: int) -> range:
    """Starting places to probe for segment i of a line shorter by ``less``, relative to its start there."""
    return range(max(-i, less - (EDITS - i)), min(i, less + (EDITS - i)) + 1)


class SegmentHash:
    """Hashes of substrings of many lines at once: prefix sums of c * base^place, divided by base^start."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def load(self, lines: list[str]) -> None:
        flat = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(flat) + 1
        if len(self.power) < n:
            for name, b in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        self.length = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(flat * self.power[:n - 1], out=self.sums[1:])

    def keys(self, rows: np.ndarray, at: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
        a = self.start[rows] + at
        h = (self.sums[a + size] - self.sums[a]) * self.inverse[a]
        return mix64(h ^ mix64((length * (EDITS + 1) + i).astype(np.uint64))).view(np.int64)

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of every line's segments."""
        rows = np.arange(len(self.length))
        return np.tile(rows, EDITS + 1), np.concatenate([self.keys(rows, *cuts(self.length, i), self.length, i) for i in range(EDITS + 1)])

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of every substring that may be a segment of a line as long or shorter; the unmoved ones are in the index."""
        who, keys = [], []
        for less in range(EDITS + 1):
            rows = np.flatnonzero(self.length - less >= MIN_CHARS)
            length = self.length[rows] - less
            for i in range(EDITS + 1):
                at, size = cuts(length, i)
                for s in shifts(i, less):
                    if less or s:
                        ok = (at + s >= 0) & (at + s + size <= self.length[rows])
                        who.append(rows[ok])
                        keys.append(self.keys(rows[ok], (at + s)[ok], size[ok], length[ok], i))
        return np.concatenate(who), np.concatenate(keys)


def within(a: str, b: str, most: int = EDITS) -> bool:
    """Whether the edit distance is at most ``most`` (under 32): bit vectors of the diagonal band only."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    if a == b:
        return True
    low, high = 0, len(b)  # common prefix, by halving
    while low < high:
        mid = (low + high + 1) // 2
        if a.startswith(b[:mid]):
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    low, high = 0, len(b)
    while low < high:
        mid = (low + high + 1) // 2
        if a.endswith(b[len(b) - mid:]):
            low = mid
        else:
            high = mid - 1
    a, b = a[:len(a) - low], b[:len(b) - low]
    if not b or len(a) <= most:
        return max(len(a), len(b)) <= most
    match: dict[str, int] = {}
    for i, c in enumerate(a):
        match[c] = match.get(c, 0) | 1 << i
    vp, vn, dist = _ONES << 63 - most & _ONES, 0, most
    mask, at = 1 << 62, most + 1 - 64
    give_up = most + len(b) - (len(a) - most)
    for j, c in enumerate(b):
        m = match.get(c, 0)
        x = (m >> at if at >= 0 else m << -at) & _ONES
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & _ONES
        hp, hn = (vn | ~(d0 | vp)) & _ONES, d0 & vp
        if j < len(a) - most:  # down the diagonal
            dist += not d0 >> 63
        else:  # along the last row
            dist += bool(hp & mask)
            dist -= bool(hn & mask)
            mask >>= 1
        if dist > give_up:
            return False
        vp, vn = (hn | ~((d0 >> 1) | hp)) & _ONES, (d0 >> 1) & hp
        at += 1
    return dist <= most


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, g, text); g, a hash of the text, tells rows of one id apart."""
    return docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text").select("id", F.xxhash64("text").alias("g"), "text")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, g, n_lines, at: line numbers, k1, k2: halves of the lines' 128-bit hashes) per row; none listed without an id."""
    small_batches(docs.sparkSession)
    names = ["id", "g", "n_lines", "at", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at, k1, k2 = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                count, own = long_lines(text, 1)
                own = own if i is not None else []
                hs = [xxh3_128_intdigest(line.encode("utf-8", "replace")) for _, line in own]
                n.append(count)
                at.append([i for i, _ in own])
                k1.append(np.array([h & _ONES for h in hs], np.uint64).view(np.int64))
                k2.append(np.array([h >> 64 for h in hs], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(k1, pa.list_(pa.int64())), pa.array(k2, pa.list_(pa.int64()))], names)

    return _documents(docs, id_col, text_col).mapInArrow(released(run), "id long, g long, n_lines long, at array<int>, k1 array<long>, k2 array<long>")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, k1, posted): index postings (posted) and probes of each line, once a task for lines met again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hasher = SegmentHash()
        for batch in batches:
            new: dict[int, str] = {}
            for i, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                for _, line in long_lines(text)[1] if i is not None else ():
                    h = xxh3_128_intdigest(line.encode("utf-8", "replace")) & _ONES
                    if h not in seen:
                        seen.add(h)
                        new[h] = line
            if len(seen) > SEEN:
                seen.clear()
            if new:
                hasher.load(list(new.values()))
                k1 = np.fromiter(new, np.uint64, len(new)).view(np.int64)
                for posted, (rows, keys) in ((True, hasher.index()), (False, hasher.probes())):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(k1[rows]), pa.array(np.full(len(rows), posted))], ["key", "k1", "posted"])

    return _documents(docs, id_col, text_col).select("id", "text").mapInArrow(released(run), "key long, k1 long, posted boolean")


def lists(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, k1, posted, head, m): postings and probes of keys that several lines meet at, but for the head; m of them in all, whether or not of one line."""
    # read by both sides of the join below and made once: the filter is what the join would push below one side alone
    dealt = postings(docs, id_col, text_col).where("key is not null and k1 is not null").repartition("key")
    own = F.when(F.col("posted"), F.col("k1"))
    heads = dealt.groupBy("key").agg(F.min(own).alias("head"), F.count(F.lit(1)).alias("m"), F.min("k1").alias("lo"), F.max("k1").alias("hi"))
    return dealt.join(heads.where("head is not null and lo <> hi").select("key", "head", "m"), "key").where("k1 <> head")


def tied_lines(docs: DataFrame, reps: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k, line): the lines whose k1 is wanted, k being the whole hash; each is taken from its first place."""
    places = reps.join(wanted, "k1").groupBy("place.id", "place.g").agg(F.collect_list("place.at").alias("want"))  # of one document
    places = cut(places)
    if (places.agg(F.sum(F.size("want"))).first()[0] or 0) <= BROADCAST_ROWS:
        places = F.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, want in zip(texts(batch, "text"), batch.column(1).to_pylist(), strict=True):
                lines = dict(long_lines(text, 1)[1])
                out += [lines[at] for at in want]
            keys = [xxh3_128_digest(line.encode("utf-8", "replace")) for line in out]
            for n in range(0, len(out), 256):  # lines can be long
                some = keys[n:n + 256]
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(k[8:], "big", signed=True) for k in some], pa.int64()), pa.array(some, pa.binary()), pa.array(out[n:n + 256])], ["k1", "k", "line"])

    rows = _documents(docs, id_col, text_col).join(places, ["id", "g"]).select("text", "want")
    return rows.mapInArrow(released(run), "k1 long, k binary, line string").dropDuplicates(["k"])


def met_heads(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b): confirmed links among pairs (k1, head, c), c being the number of pairs with that head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([within(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    heads = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("c")).join(lines.select(F.col("k1").alias("head"), F.col("k").alias("b"), F.col("line").alias("of_b")), "head")
    full = heavy_join(pairs.join(lines.select("k1", F.col("k").alias("a"), F.col("line").alias("of_a")), "k1"), heads, "head", "c", narrow="octet_length(of_b) <= 1024")
    return full.select("a", "b", "of_a", "of_b").mapInArrow(released(run), "a binary, b binary")


def blocked(rows: DataFrame, group: str, *fields: str) -> DataFrame:
    """``rows`` with a group, its size m and a key k, once for each pair of blocks that they are in: (group, low, high, block, k, fields), dealt out and sorted by pair."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("k", F.lit(7)), F.col("blocks")).cast("int"))
    each = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = each.select(F.col(group), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "k", *fields)
    return pairs.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def compare(rows: list[tuple], same: bool) -> list[tuple[bytes, bytes]]:
    """Links among rows (block, k, class, posted, line) of one list that join what isn't joined yet: postings with all that was posted or probed there."""
    rows = sorted(rows, key=lambda r: len(r[4]))
    root = {r[2]: r[2] for r in rows}

    def find(x: bytes) -> bytes:
        while root[x] != x:
            x = root[x]
        return x

    out, low = [], 0
    for j, (block, k, klass, posted, line) in enumerate(rows):
        while len(line) - len(rows[low][4]) > EDITS:
            low += 1
        for i in range(low, j):
            other = rows[i]
            if (posted or other[3]) and (same or other[0] != block) and find(klass) != find(other[2]) and within(line, other[4]):
                out.append((k, other[1]))
                root[find(klass)] = find(other[2])
    return out


def met_in_lists(open_lists: DataFrame) -> DataFrame:
    """(a, b): confirmed links among rows (key, m, k, class, posted, line) of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groups(batches, 3):
            unique = list({(r[4], r[6]): r[3:] for r in group}.values())
            if len(unique) > 1 and (got := compare(unique, key[1] == key[2])):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.binary())], ["a", "b"])

    return blocked(open_lists, "key", "class", "posted", "line").mapInArrow(released(run), "a binary, b binary")


def verify(rows: list[tuple], same: bool) -> dict[bytes, int]:
    """Links of each line among rows (block, k, line) of one block or between two."""
    rows = sorted(rows, key=lambda r: len(r[2]))
    by_segment: dict[tuple[int, int, str], list[int]] = {}
    count: dict[bytes, int] = {}
    for j, (block, k, text) in enumerate(rows):
        n, found = len(text), set()
        for less in range(EDITS + 1):
            for i in range(EDITS + 1):
                at, size = cuts(n - less, i)
                for s in shifts(i, less):
                    if at + s >= 0:
                        found.update(by_segment.get((n - less, i, text[at + s:at + s + size]), ()))
        for i in range(EDITS + 1):
            at, size = cuts(n, i)
            by_segment.setdefault((n, i, text[at:at + size]), []).append(j)
        for i in found:
            if (same or rows[i][0] != block) and within(rows[i][2], text):
                for x in (rows[i][1], k):
                    count[x] = count.get(x, 0) + 1
    return count


def counted(members: DataFrame) -> DataFrame:
    """(k, links) of the lines (class, m, k, line) of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groups(batches, 3):
            unique = list({r[4]: r[3:] for r in group}.values())
            if len(unique) > 1 and (got := verify(unique, key[1] == key[2])):
                yield pa.RecordBatch.from_arrays([pa.array([*got], pa.binary()), pa.array([*got.values()], pa.int64())], ["k", "links"])

    return blocked(members, "class", "line").mapInArrow(released(run), "k binary, links long").groupBy("k").agg(F.sum("links").alias("links"))


def linked_lines(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, class, links): lines that are linked with any other one; the class is a line's hash."""
    spark = docs.sparkSession
    met = cut(lists(docs, id_col, text_col))
    pairs = cut(met.select("k1", "head").distinct())
    lines = cut(tied_lines(docs, reps, pairs.select("k1").union(pairs.select("head")).distinct(), id_col, text_col))
    first = cut(met_heads(pairs, lines))
    classes = components(spark, first).select(F.col("node").alias("k"), F.col("component").alias("class"))
    # a line on both sides of a list stands there once a side; heads have met all of theirs
    listed = met.where("m > 2").select("key", "k1", "posted").distinct().join(lines.select("k1", "k"), "k1").join(classes, "k", "left").withColumn("class", F.coalesce("class", "k"))
    listed = cut(listed)
    still = listed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.bool_or("posted").alias("any"), F.count(F.lit(1)).alias("m")).where("any and lo <> hi")
    more = cut(heavy_join(listed, still.select("key", "m"), "key", "m"))
    links = first
    if not more.isEmpty():
        links = cut(first.unionByName(met_in_lists(more.join(lines.select("k", "line"), "k"))))
        classes = components(spark, links).select(F.col("node").alias("k"), F.col("component").alias("class"))
    classes = cut(classes)
    sizes = classes.groupBy("class").agg(F.count(F.lit(1)).alias("m"))
    members = heavy_join(classes, sizes, "class", "m").join(lines, "k").select("class", "m", "k", "line")
    out = classes.join(counted(members), "k", "left").select("k", "class", F.coalesce("links", F.lit(0)).alias("links"))
    half = lambda at: F.conv(F.substring(F.hex("k"), at, 16), 16, -10).cast("long")
    return out.select(half(17).alias("k1"), half(1).alias("k2"), "class", "links")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, text_hash (tells rows of one id apart), n_lines (not blank), and of these lines: lines (numbers from 0), classes (place of the class's
    first line: document id and number), links (to how many other texts), removed (numbers of those that aren't the first of their class), n_links, n_removed."""
    named = cut(lines_of(docs.where(F.col(id_col).isNotNull()), id_col, text_col).dropDuplicates(["id", "g"]))
    nameless = lines_of(docs.where(F.col(id_col).isNull()), id_col, text_col)
    each = named.select("id", "g", F.explode(F.arrays_zip("at", "k1", "k2")).alias("x")).select("id", "g", F.col("x.at").alias("at"), F.col("x.k1").alias("k1"), F.col("x.k2").alias("k2"))
    reps = cut(each.groupBy("k1", "k2").agg(F.min(F.struct("id", "g", "at")).alias("place"), F.count(F.lit(1)).alias("c")))
    linked = linked_lines(docs, reps, id_col, text_col)
    known = cut(reps.join(linked, ["k1", "k2"], "left"))
    own = known.where("class is null").select("k1", "k2", "c", F.col("place").alias("first"), F.lit(0).cast("long").alias("links"))
    firsts = known.where("class is not null").groupBy("class").agg(F.min("place").alias("first"))
    table = own.unionByName(known.where("class is not null").join(firsts, "class").select("k1", "k2", "c", "first", "links"))
    per = heavy_join(each, table, ["k1", "k2"], "c").groupBy("id", "g").agg(F.array_sort(F.collect_list(F.struct("at", "first", "links"))).alias("l"))  # of one document
    gone = F.expr("transform(filter(l, x -> not (x.first.id = id and x.first.g = g and x.first.at = x.at)), x -> x.at)")
    place = "struct(x.first.id as doc, x.first.at as line)"
    listed = per.select("id", "g", F.expr("transform(l, x -> x.at)").alias("lines"), F.expr(f"transform(l, x -> {place})").alias("classes"), F.expr("transform(l, x -> x.links)").alias("links"), gone.alias("removed"))
    empty = {"lines": "array<int>", "classes": "array<struct<doc: bigint, line: int>>", "links": "array<bigint>", "removed": "array<int>"}
    rows = named.unionByName(nameless).select("id", "g", "n_lines").join(listed, ["id", "g"], "left")
    return rows.select(F.col("id").alias(id_col), F.col("g").alias("text_hash"), "n_lines", *[F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in empty.items()]).withColumns({
        "n_links": F.aggregate("links", F.lit(0).cast("long"), lambda a, x: a + x), "n_removed": F.size("removed").cast("long")})


def drop_lines(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with the lines gone that aren't the first of their class; all columns stay, and rows whose text loses nothing stay as they are.
    A column ``size_col``, if there is one, gets the new length of texts that lose lines."""
    mark = unused(docs)
    key, text, numbers = f"{mark}id", f"{mark}text", f"{mark}gone"
    gone = classes.where("n_removed > 0").select(F.col(id_col).alias(key), F.col("text_hash").alias(text), F.col("removed").alias(numbers))
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\n', -1), (x, i) -> not array_contains({numbers}, i)), '\n')")
    new = {text_col: kept, size_col: F.length(kept)}
    same = (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(text))
    return docs.join(gone, same, "left").select(*[
        F.when(F.col(numbers).isNull(), F.col(c)).otherwise(new[c].cast(docs.schema[c].dataType)).alias(c) if c in new else F.col(c) for c in docs.columns])


#: DuckDB: all pairs of lines of like length. Its distance counts bytes, so letters of the tables' languages beyond ASCII stand as single bytes.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS ln, trim(unnest(l), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM t),
p AS (SELECT doc_id, ln, x FROM e WHERE x <> ''),
d AS (SELECT x, translate(x, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', array_to_string([chr(c) FOR c IN [1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26]], '')) AS b, length(x) AS n FROM p GROUP BY x HAVING length(x) >= 24),
h AS (SELECT q.x AS a, r.x AS b FROM d q JOIN d r ON r.n BETWEEN q.n - 2 AND q.n + 2 AND q.x <> r.x AND abs(strlen(q.b) - strlen(r.b)) <= 2 WHERE levenshtein(q.b, r.b) <= 2),
reach AS (SELECT a AS x, b AS other FROM h UNION SELECT reach.x, h.b FROM reach JOIN h ON h.a = reach.other),
m AS (SELECT x, least(x, min(other)) AS class FROM reach GROUP BY x),
z AS (SELECT doc_id, ln, p.x, coalesce(class, p.x) AS class FROM p LEFT JOIN m ON m.x = p.x),
f AS (SELECT *, first_value(doc_id) OVER w AS d1, first_value(ln) OVER w AS a1 FROM z WINDOW w AS (PARTITION BY class ORDER BY doc_id, ln)),
k AS (SELECT a AS x, count(*) AS links FROM h GROUP BY a),
o AS (SELECT f.doc_id, count(*) AS n_lines, sum(coalesce(links, 0)) AS n_links, count(*) FILTER (NOT (d1 = f.doc_id AND a1 = ln)) AS n_removed,
  string_agg(ln || '=' || d1 || '/' || a1 || '+' || coalesce(links, 0), ' ' ORDER BY ln) AS line_classes FROM f LEFT JOIN k ON k.x = f.x GROUP BY f.doc_id)
SELECT t.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(line_classes, '') AS line_classes FROM t LEFT JOIN o ON o.doc_id = t.doc_id
"""
