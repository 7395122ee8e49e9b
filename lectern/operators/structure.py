"""Outlines: headings, sections, anchors, links and declared entries of each document, from one scan and without a shuffle.

All of these lie inside one document, so they are folds over its events, made where the document is parsed; outline() gives one row a document, and the functions
beside it unfold that row. Nothing here is joined by document; only edges between documents are, in relations.py.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SLUG_DROPS, SPACE
from lectern.operators.scan import MAX_ANCHORS, Document, Found, Inline, Line, line_bounds, parse, parse_blocks

CONTEXT_BYTES = 8_192
#: The heading under which a document declares edges. Fixed value.
DECLARING = "Relationships"
FIELDS = {
    "headings": "seq int, level int, text string, byte_start long, byte_end long, line int, last_line int, next_line int",
    "sections": "seq int, line_start int, line_end int, byte_start long, byte_end long, context_end long",
    "marks": "anchor string, line_start int, line_end int, clash int",
    "links": "seq int, line int, target string",
    "entries": "line int, content string, head_bad boolean, again boolean, link string",
}
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_WHITE = re.compile(rf"[{SPACE}]")
_OUTER_WHITE = re.compile(rf"^[{SPACE}]+|[{SPACE}]+\Z")
_DROPPED = str.maketrans("", "", SLUG_DROPS)


def _arrow(fields: str) -> pa.DataType:
    return pa.list_(pa.struct([(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))]))


def byte_offsets(text: str) -> np.ndarray | range:
    """Byte offset of each character, and of the end; one encoding a text."""
    if text.isascii():
        return range(len(text) + 1)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])


def slug(heading: str) -> str:
    return _WHITE.sub("-", heading.lower().translate(_DROPPED))


def numbered(slugs: list[str]) -> list[str]:
    """Slugs made distinct by the least free number; a number taken by an earlier heading's own text is passed over."""
    used, tried, out = set(), {}, []
    for base in slugs:
        n = tried.get(base, 0)
        name = base if n == 0 else f"{base}-{n}"
        while name in used:
            n += 1
            name = f"{base}-{n}"
        tried[base] = n + 1
        used.add(name)
        out.append(name)
    return out


def one_link(line: str) -> str | None:
    """The target of a line that is one list item of plain text with exactly one link without a title."""
    if not line.startswith("- "):
        return None
    found = Found()
    parse_blocks([Line(2, line[2:], len(line))], 0, 1, found)
    if len(found.blocks) != 1 or found.blocks[0][0] != "text":
        return None
    s = found.blocks[0][1][0][0]
    events = Inline(s, {}).run(0, len(s))
    targets = [v for t, v, _ in events if t == "link"]
    return targets[0] if len(targets) == 1 and all(t in ("text", "link", "mark") for t, _, _ in events) else None


class Outline:
    """What outline() says of one text."""

    def __init__(self, text: str):
        doc: Document = parse(text)
        self.text, self.bytes = text, byte_offsets(text)
        self.starts, self.stops, self.ends = line_bounds(text)
        self.lines = len(self.ends)
        self.title, self.over = doc.title, len(doc.headings) + len(doc.anchors) > MAX_ANCHORS
        found = [] if self.over else doc.headings
        lines = [self.line(a) for _, a, _, _ in found]
        last = self.last_lines([h[0] for h in found], lines)
        self.headings = [(n, level, t, int(self.bytes[a]), int(self.bytes[b]), lines[n], last[n], lines[n + 1] if n + 1 < len(found) else None) for n, (level, a, b, t) in enumerate(found)]
        self.marks = [] if self.over else self.anchored([(name, k) for name, k in doc.anchors])
        self.links = [] if self.over else [(n, self.line(k), target) for n, (target, k) in enumerate(doc.links)]
        self.sections, self.entries = self.sectioned(), self.declared()

    def line(self, at: int) -> int:
        return min(int(np.searchsorted(self.ends, at, "right")), self.lines - 1) + 1

    def last_lines(self, levels: list[int], lines: list[int]) -> list[int]:
        """The line before the next heading of the same or a higher level, or the last line."""
        out, open_ = [self.lines] * len(levels), []
        for n, level in enumerate(levels):
            while open_ and levels[open_[-1]] >= level:
                out[open_.pop()] = lines[n] - 1
            open_.append(n)
        return out

    def sectioned(self) -> list[tuple]:
        """A preamble, unless a heading is on line 1, and one section a heading. Bytes run to the next heading of any level, lines through the last subsection."""
        size, heads = int(self.bytes[-1]), self.headings
        starts = [(-1, 1, heads[0][5] - 1 if heads else self.lines, heads[0][5] if heads else None)] if not heads or heads[0][5] > 1 else []
        starts += [(h[0], h[5], h[6], h[7]) for h in heads]
        byte = lambda line: int(self.bytes[int(self.starts[line - 1])])
        return [(n, a, b, byte(a), byte(after) if after else size, int(self.bytes[int(self.ends[b - 1])])) for n, a, b, after in starts if b >= a]

    def anchored(self, explicit: list[tuple[str, int]]) -> list[tuple]:
        """(anchor, first line, last line, line of an earlier anchor of the same name): slugs of headings, and explicit ones, each running to the end of the first
        heading that ends behind it, or else of the last one, or else of the document."""
        named = [(slug(h[2]), h) for h in self.headings]
        named = [(base, h) for base, h in named if base]
        rows = [(h[5], h[6], 0, h[0], name) for name, (_, h) in zip(numbered([b for b, _ in named]), named, strict=True)]
        stops = [h[4] for h in self.headings]
        for n, (name, k) in enumerate(explicit):
            after = bisect_right(stops, int(self.bytes[k]))
            rows.append((self.line(k), self.headings[min(after, len(stops) - 1)][6] if stops else self.lines, 1, n, name))
        seen: dict[str, int] = {}
        out = []
        for first, last, _, _, name in sorted(rows):
            out.append((name, first, last, seen.get(name)))
            seen[name] = first
        return out

    def declared(self) -> list[tuple]:
        """Lines with or inside the section that declares edges, and of further headings of that name: (line, content, misspelt heading, further heading, its one link)."""
        heads = [h for h in self.headings if h[1] == 2 and _OUTER_WHITE.sub("", h[2]) == DECLARING]
        if not heads:
            return []
        first = heads[0]
        stop = next((h[3] for h in self.headings[first[0] + 1:] if h[1] <= 2), int(self.bytes[-1]))
        second = heads[1][5] if len(heads) > 1 else None
        out = []
        for n in range(first[5], (second or self.lines) + 1):
            a, b = int(self.starts[n - 1]), int(self.stops[n - 1])
            content, at = self.text[a:b], int(self.bytes[a])
            inside = first[4] <= at < stop and _OUTER_WHITE.sub("", content) != ""
            bad = n == first[5] and content != "## " + DECLARING
            if inside or bad or n == second:
                out.append((n, content, bad, n == second, one_link(content)))
        return out


def outline(documents: DataFrame, *keep: str) -> DataFrame:
    """(id, keep, lines, title, over, headings, sections, marks, links, entries), a row a document; ``over`` is set for a document with too many anchors, which has none here."""
    names = ["id", *keep, "lines", "title", "over", *FIELDS]
    kinds = [pa.int32(), pa.string(), pa.bool_(), *map(_arrow, FIELDS.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Outline(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [[o.lines for o in found], [o.title for o in found], [o.over for o in found]]
            columns += [[[dict(zip(keys, x, strict=True)) for x in getattr(o, name)] for o in found] for name, keys in ((n, [f.split()[0] for f in fields.split(", ")]) for n, fields in FIELDS.items())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    rows = documents.select("id", *keep, "text")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    parts = ", ".join(f"{n} array<struct<{', '.join(x.replace(' ', ': ') for x in fields.split(', '))}>>" for n, fields in FIELDS.items())
    return rows.mapInArrow(run, f"{own}, lines int, title string, over boolean, {parts}")


def unfolded(outlines: DataFrame, part: str, *keep: str) -> DataFrame:
    """Rows (id, keep, fields of the part): "headings", "sections", "marks", "links" or "entries"."""
    return outlines.select("id", *keep, F.explode(part).alias("_x")).select("id", *keep, "_x.*")


def with_context(passages: DataFrame, parts: DataFrame) -> DataFrame:
    """Passages with the lines and bytes of the sections they touch, and whether these are short enough to stand for them."""
    s = parts.select("id", "seq", "line_start", "line_end", F.col("byte_start").alias("s_start"), F.col("byte_end").alias("s_end"), "context_end")
    met = passages.join(s, "id").where("s_end > first_byte and s_start < last_byte")
    keys = ["id", "first_line"]
    found = met.groupBy(*keys).agg(F.min_by(F.struct("line_start", "s_start"), "seq").alias("a"), F.max_by(F.struct("line_end", "context_end"), F.struct("line_end", "seq")).alias("b"))
    size = F.col("b.context_end") - F.col("a.s_start")
    return passages.join(found.select(*keys, F.col("a.line_start").alias("context_first"), F.col("b.line_end").alias("context_last"), F.col("a.s_start").alias("context_byte"),
                                      F.col("b.context_end").alias("context_end"), (size <= CONTEXT_BYTES).alias("expand")), keys)


def nav_label(document: Column, source: Column, target: Column) -> Column:
    return F.when((source == document) & (target == document), "self").when(source == document, "outgoing").otherwise("incoming")
