"""Removal of repeated passages of WINDOW = 20 words, found by phrase automata.

A word goes if a window of 20 consecutive words that covers it has the same words as a window that starts earlier
(in a document of a smaller id, or earlier in the same document). Windows are judged on the input.
1. Every window names one phrase of its own: its 8 words of the least hash, leftmost among equals. Equal windows name the same phrase in the
   same place, and neighbours mostly share it, so phrases stand for windows at a seventh of their number. Phrases are counted with map-side combining.
2. Phrases that recur, and those that recur so often that one task should not see them all, are told to the scanning tasks as two bit maps, sized by the number of
   phrases that recur; the maps may err by letting through too much, never too little, and what passes wrongly fails to be confirmed below. Where more phrases
   recur than MOST_MAPPED, places of phrases are joined with the counts instead, and nothing is broadcast but the few heaviest.
3. A second pass takes an excerpt around each phrase that may recur: the words of all windows that name it. A task keeps, of equal excerpts, the
   one that starts first; the others are repeats already, by equality of their words: no automaton sees them. Excerpts are dealt out by phrase, those of very frequent phrases window by window, by the window's hash.
4. Each task, which again passes on equal excerpts as repeats while it reads them in order, compiles, for a bounded number of excerpts at a time, an Aho-Corasick automaton of the phrases
   confirmed to recur there, streams the excerpts (never whole documents) through it,
   and compares the words of the windows around each place it reports. All but the first occurrence of a window are repeats.
5. Repeats are gathered by document and cut from its words.

Equality is always that of the words themselves; hashes only deal out and filter.

Rules: words are runs of bytes other than space and \\t..\\r; a null or empty text has none; a document of under 20 words loses nothing;
rows of one id are one place in the order, so a repeated row doesn't repeat itself, and of rows with one id and different texts neither comes
before the other but each loses its own repeats; rows without an id are left as they are.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WordHash, binary, cut, heavy_join, mix64, released, rolling, sliding_argmin, small_batches, words_of

WINDOW, PHRASE = 20, 8
SPAN = WINDOW - PHRASE + 1
#: Phrases that recur for which the two bit maps are made: 16 to 32 bits each, so 32 MB a map at most.
MOST_MAPPED = 1 << 23
FREQUENT = 128
HELD, CHUNK = 60_000, 20_000  # excerpts held by a scanning task, and in one automaton's round
_BASE = 0x9E3779B97F4A7C15


def phrases(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For word hashes: of each phrase named by windows its hash, its first word, and the first and last window that name it."""
    grams = mix64(rolling(h, PHRASE, _BASE))
    at = sliding_argmin(grams, SPAN)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return grams[at[first]], at[first], first, last


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, g: hash of the text, which tells rows of one id apart)."""
    return docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text").withColumn("g", F.xxhash64("text"))


def phrase_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each phrase that recurs is named; a task combines what it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            found = [phrases(hashes.array(w))[0] for t in binary(batch, "text") if len(w := words_of(t)) >= WINDOW]
            if found:
                h, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return docs.select("text").mapInArrow(released(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")


class BitMaps:
    """Bit maps of phrases named twice or more, and of those named more than FREQUENT times; 16 to 32 bits for each phrase that recurs."""

    def __init__(self, counts: DataFrame, recurring: int):
        self.words = max(64, 1 << (recurring * 16).bit_length()) // 64
        bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
        rows = counts.select(F.expr(f"cast(shiftrightunsigned(h, 6) & {self.words - 1} as int)").alias("w"), bit.alias("b"), F.when(F.col("c") > FREQUENT, bit).otherwise(0).alias("f"))
        got = rows.groupBy("w").agg(F.bit_or("b").alias("b"), F.bit_or("f").alias("f")).toArrow()  # MOST_MAPPED rows at most
        self.recurring, self.frequent = np.zeros((2, self.words), np.uint64)
        at = got["w"].to_numpy()
        self.recurring[at], self.frequent[at] = (got[c].to_numpy().view(np.uint64) for c in ("b", "f"))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, bit = (h >> np.uint64(6)) & np.uint64(self.words - 1), h & np.uint64(63)
        return tuple((bits[at] >> bit & np.uint64(1)).astype(bool) for bits in (self.recurring, self.frequent))


EXCERPT = "route long, id long, g long, start int, phrase int, words binary, stop int"
_KINDS = [("route", pa.int64()), ("id", pa.int64()), ("g", pa.int64()), ("start", pa.int32()), ("phrase", pa.int32()), ("words", pa.binary()), ("stop", pa.int32())]


def _joined(spans: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Spans (id, g, first word, end) with those of one text that meet made one."""
    last = None
    for i, g, a, b in sorted(spans):
        if last and last[:2] == [i, g] and a <= last[3]:
            last[3] = max(b, last[3])
        else:
            if last:
                yield tuple(last)
            last = [i, g, a, b]
    if last:
        yield tuple(last)


class Excerpts:
    """Excerpts that a scanning task holds, each set of words under its first place, and the repeats among what it has seen."""

    def __init__(self) -> None:
        self.hashes = WordHash()
        self.held: dict[tuple[bytes, int], tuple[int, int, int, int]] = {}  # (words, phrase) -> (id, start, g, route)
        self.others: list[tuple] = []  # at the same place of another text with the same id
        self.repeats: list[tuple[int, int, int, int]] = []

    def add(self, i: int, g: int, words: list[bytes], hs: np.ndarray, named: Iterator[tuple[int, int, int, int, bool]]) -> None:
        """``named``: hash, first word, first and last window of a phrase that may recur, and whether very often."""
        wide = None
        for r, p, a, b, many in named:
            if many and wide is None:
                wide = mix64(rolling(hs, WINDOW, _BASE)).view(np.int64)
            for a, b in ([(s, s) for s in range(a, b + 1)] if many else [(a, b)]):
                key = b" ".join(words[a:b + WINDOW]), p - a
                route = int(wide[a]) if many else r
                got = self.held.setdefault(key, (i, a, g, route))
                if (i, a) < got[:2]:
                    self.repeats.append((got[0], got[2], got[1], got[1] + b - a + WINDOW))
                    self.held[key] = i, a, g, route
                elif (i, a) > got[:2]:
                    self.repeats.append((i, g, a, b + WINDOW))
                elif g != got[2]:
                    self.others.append((route, i, g, a, p - a, key[0], None))

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows = [(r, i, g, a, k[1], k[0], None) for k, (i, a, g, r) in self.held.items()]
        rows += self.others + [(i, i, g, a, None, None, b) for i, g, a, b in _joined(self.repeats)]
        for k in range(0, len(rows), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[k:k + 8192], strict=True), _KINDS, strict=True)], [n for n, _ in _KINDS])
        self.held.clear()
        self.others.clear()
        self.repeats.clear()


def excerpts(docs: DataFrame, maps) -> DataFrame:
    """Excerpts (words not null; stop unused) and repeats found on the way (words null; words start..stop - 1 of the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, out = maps.value, Excerpts()
        for batch in batches:
            for i, g, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), binary(batch, "text"), strict=True):
                if i is not None and len(words := words_of(text)) >= WINDOW:
                    hs = out.hashes.array(words)
                    found = phrases(hs)
                    own, often = of(found[0])
                    h, at, first, last = (x[own] for x in found)
                    out.add(i, g, words, hs, zip(h.view(np.int64).tolist(), at.tolist(), first.tolist(), last.tolist(), often[own].tolist()))
            if len(out.held) >= HELD:
                yield from out.flush()
        yield from out.flush()

    return docs.mapInArrow(released(run), EXCERPT)


def excerpts_by_join(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """The same excerpts where too many phrases recur for maps: places of phrases meet the counts in a join, and texts meet their places in another."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for i, g, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), binary(batch, "text"), strict=True):
                if i is not None and len(words := words_of(text)) >= WINDOW:
                    h, at, first, last = phrases(hashes.array(words))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), i)), pa.array(np.full(len(h), g)),
                                                      *(pa.array(x.astype(np.int32)) for x in (at, first, last))], ["h", "id", "g", "p", "a", "b"])

    named = heavy_join(docs.mapInArrow(released(places), "h long, id long, g long, p int, a int, b int").distinct(), counts, "h", "c")
    own = named.groupBy("id", "g").agg(F.collect_list(F.struct("h", "p", "a", "b", (F.col("c") > FREQUENT).alias("many"))).alias("named"))  # of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Excerpts()
        for batch in batches:
            for i, g, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch, "text"), batch.column(3).to_pylist(), strict=True):
                words = words_of(text)
                out.add(i, g, words, out.hashes.array(words), map(tuple, map(dict.values, found)))
            if len(out.held) >= HELD:
                yield from out.flush()
        yield from out.flush()

    return docs.join(own, ["id", "g"]).select("id", "g", "text", "named").mapInArrow(released(run), EXCERPT)


def locate(rows: list[tuple[int, int, int, int, str]]) -> list[tuple[int, int, int, int]]:
    """Repeats (id, g, first word, end) among excerpts (id, g, start, phrase, text); the text has a space at both ends and between words."""
    found, where = [], []
    for *_, p, text in rows:
        words = text[1:-1].split(" ")
        place = [0]
        for w in words:
            place.append(place[-1] + len(w) + 1)
        where.append(place)
        found.append(text[place[p]:place[p + PHRASE] + 1])
    confirmed = [x for x, c in Counter(found).items() if c > 1]
    if not confirmed:
        return []
    automaton = ahocorasick.Automaton()
    for x in confirmed:
        automaton.add_word(x, len(x))
    automaton.make_automaton()
    first: dict[str, tuple[int, int]] = {}
    seen: list[tuple[str, int, int, int]] = []
    for (i, g, start, _, text), place in zip(rows, where, strict=True):
        number = {x: k for k, x in enumerate(place)}
        n = len(place) - 1
        done = -1
        for end, size in automaton.iter(text):
            p = number[end - size + 1]
            for s in range(max(p - SPAN + 1, done + 1, 0), min(p, n - WINDOW) + 1):
                window = text[place[s]:place[s + WINDOW]]
                at = i, start + s
                old = first.get(window)
                if old is None or at < old:
                    first[window] = at
                seen.append((window, i, g, start + s))
                done = s
    return [(i, g, s, s + WINDOW) for window, i, g, s in seen if first[window] != (i, s)]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, g, spans: array of (a, b)): words a..b - 1 of a text that repeat earlier ones; documents without any are left out."""
    spark = docs.sparkSession
    small_batches(spark)
    own = _documents(docs, id_col, text_col)
    counts = cut(phrase_counts(own))
    recurring = counts.count()
    found = excerpts(own, spark.sparkContext.broadcast(BitMaps(counts, recurring))) if recurring <= MOST_MAPPED else excerpts_by_join(own, counts)
    names = ["id", "g", "start", "stop"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int, str]] = []
        again: list[tuple[int, int, int, int]] = []  # repeats by equality of whole excerpts
        last = None

        def result() -> Iterator[pa.RecordBatch]:
            if spans := [*_joined(again + locate(rows))]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*spans, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names)
            rows.clear()
            again.clear()

        for batch in batches:
            if (known := batch.filter(batch.column(5).is_null())).num_rows:  # repeats already: passed on
                yield pa.RecordBatch.from_arrays([known.column(k) for k in (1, 2, 3, 6)], names)
            batch = batch.filter(batch.column(5).is_valid())
            for route, i, g, start, p, words in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if last and last[:3] == (route, words, p) and last[3:] < (i, start):  # the first of equal excerpts stands before it
                    again.append((i, g, start, start + words.count(b" ") + 1))
                else:
                    if len(rows) >= CHUNK and last[0] != route:
                        yield from result()
                    rows.append((i, g, start, p, f" {words.decode('latin-1')} "))  # bytes as characters, one to one
                    last = route, words, p, i, start
                if len(again) >= HELD:
                    spans, again[:] = [*_joined(again)], []
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*spans, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names)
        yield from result()

    # rows of one route stay together, FREQUENT different excerpts at most; a route without any company is confirmed to be none
    located = found.repartition("route").sortWithinPartitions("route", "words", "phrase", "id", "start").mapInArrow(released(search), "id long, g long, start int, stop int")
    return located.groupBy("id", "g").agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("stop").alias("b"))).alias("spans"))


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, on request, kept_text: the words left, joined by one space."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]
    names = ["id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            spans = batch.column(2).to_pylist()
            for i, text, own in zip(batch.column(0).to_pylist(), binary(batch, "text"), spans, strict=True):
                words = words_of(text)
                n = len(words)
                if own:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [s["a"] for s in own], 1)
                    np.add.at(edge, [s["b"] for s in own], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                kept = b" ".join(words)
                out.append((i, n, n - len(words), hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "replace")] * with_text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = _documents(docs, id_col, text_col).join(spans, ["id", "g"], "left").select("id", "text", "spans")
    out = rows.mapInArrow(released(run), "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return out.withColumnRenamed("id", id_col)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    return remove(docs, repeats(docs, id_col, text_col), id_col, text_col, with_text)


#: DuckDB: all windows of all documents compared.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS p, len(l) AS n FROM w),
k AS (SELECT doc_id, p, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS t FROM e),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS o FROM k WHERE p + 19 <= n),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM r WHERE o > 1),
g AS (SELECT e.doc_id, count(c.p) AS gone, string_agg(x, ' ' ORDER BY e.p) FILTER (c.p IS NULL) AS kept FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""
