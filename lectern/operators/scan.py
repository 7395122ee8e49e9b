"""One pass over a Markdown document: headings, link destinations, explicit anchors.

Block and inline structure is beyond regular expressions, so this is Python; structure.outline() runs it once a document. Blocks are found by recursion over lines whose container prefixes are taken off; each line keeps the byte offset
of what is left of it. Known limit: emphasis is only taken off heading texts.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np

MAX_ANCHORS = 32_768
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*)|$)")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(?=\S)|[ \t]*$)")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
TAG = re.compile(r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*|!--(?:>|->|[\s\S]*?-->)|\?[\s\S]*?\?|![A-Za-z][^>]*|!\[CDATA\[[\s\S]*?\]\])(?:>|(?<=-->)|(?<=->))")
AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
CELL = re.compile(r"(?:[^|\\]|\\.|\\$)*")
NOTE = re.compile(r" {0,3}\[\^([^\[\]\s]+)\]:[ \t]*")
NOTE_MARK = re.compile(r"\[\^([^\[\]\s]+)\]")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Elements that begin a block of markup wherever they stand. Fixed values of the format's definition.
BLOCK_TAGS = ("address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
              "frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section "
              "summary table tbody td tfoot th thead title tr track ul").split()
#: Openings of markup blocks and what ends each; None: a blank line.
MARKUP = [(re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
          (re.compile(r" {0,3}<!--"), re.compile("-->")), (re.compile(r" {0,3}<\?"), re.compile(r"\?>")), (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
          (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")), (re.compile(r" {0,3}</?(?:" + "|".join(BLOCK_TAGS) + r")(?:\s|/?>|$)", re.I), None)]
LONE_TAG = re.compile(r" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")
#: Elements whose content isn't markup; "plaintext" never ends. Fixed values.
RAW_TEXT = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext")
ANCHOR = re.compile(r"<a id=\"([^\s\"<>&]+)\">")
ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


def line_bounds(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end without ending, and end of each line, in characters; an empty text is one line."""
    code = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    feed = code == 10
    closes = feed.copy()
    if len(code):
        closes |= (code == 13) & ~np.append(feed[1:], False)
    ends = np.flatnonzero(closes) + 1
    if not len(ends) or ends[-1] < len(code):
        ends = np.append(ends, len(code))
    starts = np.concatenate([[0], ends[:-1]])
    last = code[ends - 1] if len(code) else np.zeros(1, np.uint8)
    stops = ends - ((last == 10) | (last == 13))
    if len(code):
        stops = stops - ((last == 10) & (ends - starts > 1) & (code[np.maximum(ends - 2, 0)] == 13))
    return starts, stops, ends


def front_matter(text: str) -> tuple[int, int, int] | None:
    """Start and end of the YAML header between its fences, and the start of the body; None without a closed header."""
    lead = 1 if text.startswith("\ufeff") else 0
    after = None
    for m in re.compile(r"([^\r\n]*)(?:\r\n|\r|\n|\Z)").finditer(text, lead):  # lines, as far as needed
        if m[1].rstrip(" \t") == "---":
            if after is not None:
                return after, m.start(), m.end()
            after = m.end()
        elif after is None:
            return None
    return None


@dataclass
class Line:
    at: int  # character offset of the first character left
    text: str
    end: int  # offset of the next line


@dataclass
class Found:
    """What a document holds, at character offsets of the body."""

    blocks: list[tuple] = field(default_factory=list)  # inline content waiting for all definitions
    definitions: dict[str, str] = field(default_factory=dict)
    notes: set[str] = field(default_factory=set)  # labels of footnotes


def width(s: str) -> int:
    n = 0
    for c in s:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def starts_block(s: str) -> bool:
    """Whether a line can interrupt a paragraph."""
    item = ITEM.match(s)
    return bool(ATX.match(s) or FENCE.match(s) or QUOTE.match(s) or RULE.match(s) or any(m.match(s) for m, _ in MARKUP)
                or item and item[3] and (not item[2][0].isdigit() or item[2][:-1] == "1"))


def parse_blocks(rows: list[Line], quotes: int, lists: int, out: Found) -> None:
    i = 0
    while i < len(rows):
        row = rows[i]
        s = row.text
        if not s.strip(" \t"):
            i += 1
        elif width(s) >= 4:
            while i < len(rows) and (not rows[i].text.strip(" \t") or width(rows[i].text) >= 4):
                i += 1
        elif m := FENCE.match(s):
            close = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            i += 1
            while i < len(rows) and not close.match(rows[i].text):
                i += 1
            i += 1
        elif m := ATX.match(s):
            lead = len(s) - len(s.lstrip(" "))
            body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", (m[2] or "").rstrip(" \t"))
            inside = [(body, row.at + (m.start(2) if m[2] is not None else len(s)))]
            out.blocks.append(("heading", len(m[1]), row.at + lead, row.end, inside, quotes, lists))
            i += 1
        elif RULE.match(s):
            i += 1
        elif QUOTE.match(s):
            inner: list[Line] = []
            while i < len(rows):
                r = rows[i]
                if q := QUOTE.match(r.text):
                    inner.append(Line(r.at + q.end(), r.text[q.end():], r.end))
                elif r.text.strip(" \t") and inner and inner[-1].text.strip(" \t") and not starts_block(r.text) and not starts_block(inner[-1].text):
                    inner.append(r)
                else:
                    break
                i += 1
            parse_blocks(inner, quotes + 1, lists, out)
        elif m := ITEM.match(s):
            pad = len(m[3]) if m[3] else 1
            need = len(m[1]) + len(m[2]) + (pad if pad <= 4 else 1)
            inner = [Line(row.at + min(need, len(s)), s[min(need, len(s)):], row.end)]
            i += 1
            while i < len(rows):
                r = rows[i]
                if not r.text.strip(" \t"):
                    if len(inner) == 1 and not inner[0].text.strip():
                        break
                    inner.append(Line(r.at, "", r.end))
                elif width(r.text) >= need:
                    k = len(r.text) - len(r.text.lstrip(" \t")) if "\t" in r.text[:need] else need
                    inner.append(Line(r.at + k, r.text[k:], r.end))
                elif inner[-1].text.strip() and not starts_block(r.text) and not ITEM.match(r.text):
                    inner.append(r)
                else:
                    break
                i += 1
            parse_blocks(inner, quotes, lists + 1, out)
        elif (hit := next((e for m, e in MARKUP if m.match(s)), False)) is not False or LONE_TAG.match(s):
            first = i
            ending = hit if hit is not False else None
            while i < len(rows) and (ending is not None or rows[i].text.strip(" \t")):
                i += 1
                if ending is not None and ending.search(rows[i - 1].text):
                    break
            out.blocks.append(("html", rows[first:i], quotes))
        elif m := NOTE.match(s):
            out.notes.add(label_key(m[1]))
            inner = [Line(row.at + m.end(), s[m.end():], row.end)]
            i += 1
            while i < len(rows):
                r = rows[i]
                if width(r.text) >= 4 or not r.text.strip(" \t"):
                    k = min(4, len(r.text) - len(r.text.lstrip(" ")))
                    inner.append(Line(r.at + k, r.text[k:], r.end))
                elif inner[-1].text.strip(" \t") and not starts_block(r.text) and not NOTE.match(r.text):
                    inner.append(r)
                else:
                    break
                i += 1
            parse_blocks(inner, quotes, lists + 1, out)
        elif i + 1 < len(rows) and "|" in s + rows[i + 1].text and DELIMITERS.match(rows[i + 1].text) and len(cells(row)) == len(cells(rows[i + 1])):
            columns = len(cells(row))
            first = i
            while i < len(rows) and rows[i].text.strip(" \t") and (i < first + 2 or not starts_block(rows[i].text)):
                if i != first + 1:
                    out.blocks += [("text", [cell], quotes) for cell in cells(rows[i])[:columns]]
                i += 1
        else:
            i = parse_paragraph(rows, i, quotes, lists, out)


def cells(row: Line) -> list[tuple[str, int]]:
    """Cells of a table's row with their offsets; a bar after a backslash is text, and its backslash goes."""
    s = row.text.rstrip(" \t")
    lead = len(s) - len(s.lstrip(" \t"))
    lead += s[lead:lead + 1] == "|"
    found = []
    while lead < len(s) or not found:
        m = CELL.match(s, lead)
        own = m[0].strip(" \t")
        found.append((own.replace("\\|", "|"), row.at + lead + len(m[0]) - len(m[0].lstrip(" \t"))))
        lead = m.end() + 1
    return found


def parse_paragraph(rows: list[Line], i: int, quotes: int, lists: int, out: Found) -> int:
    first = i
    while i < len(rows) and not NOTE.match(rows[i].text) and (m := DEFINITION.match(rows[i].text)):
        dest = m[2][1:-1] if m[2].startswith("<") else m[2]
        out.definitions.setdefault(label_key(m[1]), unescape(dest))
        i += 1
    if i > first and (i >= len(rows) or not rows[i].text.strip(" \t") or starts_block(rows[i].text)):
        return i
    first = i
    i += 1
    while i < len(rows) and rows[i].text.strip(" \t"):
        if m := SETEXT.match(rows[i].text):
            lead = len(rows[first].text) - len(rows[first].text.lstrip(" "))
            out.blocks.append(("heading", 1 if m[1][0] == "=" else 2, rows[first].at + lead, rows[i].end, content(rows[first:i]), quotes, lists))
            return i + 1
        if starts_block(rows[i].text):
            break
        i += 1
    out.blocks.append(("text", content(rows[first:i]), quotes))
    return i


def content(rows: list[Line]) -> list[tuple[str, int]]:
    parts = []
    for r in rows:
        s = r.text.lstrip(" \t")
        parts.append((s, r.at + len(r.text) - len(s)))
    return [(p[0].rstrip(" \t") if k == len(parts) - 1 else p[0], p[1]) for k, p in enumerate(parts)]


def label_key(label: str) -> str:
    return " ".join(label.split()).casefold()


def unescape(s: str) -> str:
    return ENTITY.sub(lambda m: html.unescape(m[0]), ESCAPED.sub(r"\1", s))


def closing(s: str, i: int) -> int:
    """Place of the bracket that closes the one at i; -1 if there is none."""
    depth, k = 0, i
    while k < len(s):
        c = s[k]
        if c == "\\":
            k += 1
        elif c == "`":
            run = len(s) - k - len(s[k:].lstrip("`"))
            m = re.search(rf"(?<!`)`{{{run}}}(?!`)", s[k + run:])
            k += run - 1 + (m.end() if m else 0)
        elif c == "<" and (m := AUTO.match(s, k) or TAG.match(s, k)):
            k = m.end() - 1
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return k
        k += 1
    return -1


def destination(s: str, i: int) -> tuple[str, str, int] | None:
    """(target, title, end) of an inline target in parentheses at i."""
    m = re.compile(r"\(\s*").match(s, i)
    k = m.end()
    if s[k:k + 1] == "<":
        m = re.compile(r"<((?:[^<>\n\\]|\\.)*)>").match(s, k)
        if not m:
            return None
        dest, k = m[1], m.end()
    else:
        depth, a = 0, k
        while k < len(s) and not s[k].isspace() and ord(s[k]) >= 32:
            if s[k] == "\\" and k + 1 < len(s):
                k += 1
            elif s[k] == "(":
                depth += 1
            elif s[k] == ")":
                if not depth:
                    break
                depth -= 1
            k += 1
        if depth:
            return None
        dest = s[a:k]
    m = re.compile(r"(?:\s+(\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'|\((?:[^()\\]|\\[\s\S])*\)))?\s*\)").match(s, k)
    return (unescape(dest), unescape((m[1] or "  ")[1:-1]).strip(" ") if m[1] else "", m.end()) if m else None


class Inline:
    """Events of one run of inline content: ("text" | "code" | "html" | "break" | "link" | "mark" | "note", value, offset in the run)."""

    def __init__(self, s: str, definitions: dict[str, str], notes: set[str] = frozenset()):
        self.s, self.definitions, self.notes = s, definitions, notes
        self.events: list[tuple[str, str, int]] = []

    def run(self, a: int, b: int) -> list[tuple[str, str, int]]:
        s, k, plain = self.s, a, a
        out: list[tuple[str, str, int]] = []

        def flush(to: int) -> None:
            if to > plain:
                out.append(("text", s[plain:to], plain))

        while k < b:
            c = s[k]
            got: list[tuple[str, str, int]] | None = None
            end = k + 1
            if c == "\\" and k + 1 < b and s[k + 1] == "\n":
                got, end = [("break", "", k)], k + 2
            elif c == "\\" and (m := ESCAPED.match(s, k)):
                got, end = [("text", m[1], k)], k + 2
            elif c == "\n":
                cut = len(s[plain:k].rstrip(" ")) + plain
                if cut > plain:
                    out.append(("text", s[plain:cut], plain))
                plain, got = k, [("break", "", k)]
            elif c == "&" and (m := ENTITY.match(s, k)) and html.unescape(m[0]) != m[0]:
                got, end = [("text", html.unescape(m[0]), k)], m.end()
            elif c == "`":
                n = len(s[k:b]) - len(s[k:b].lstrip("`"))
                m = re.search(rf"(?<!`)`{{{n}}}(?!`)", s[k + n:b])
                if m:
                    code = s[k + n:k + n + m.start()].replace("\n", " ")
                    code = code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip(" ") else code
                    got, end = [("code", code, k)], k + n + m.end()
                else:
                    k += n
                    continue
            elif c == "<" and (m := AUTO.match(s, k)):
                got, end = [("link", m[1] if ":" in m[1] else "mailto:" + m[1], k), ("text", m[1], k + 1)], m.end()
            elif c == "<" and (m := TAG.match(s, k)):
                got, end = [("html", m[0], k)], m.end()
            elif c == "[" and (m := NOTE_MARK.match(s, k, b)) and label_key(m[1]) in self.notes:
                got, end = [("note", m[1], k)], m.end()
            elif c == "[" or c == "!" and s[k + 1:k + 2] == "[":
                open_at = k + (c == "!")
                linked = self.link(open_at, b)
                if linked:
                    dest, title, close, end = linked
                    inner = self.run(open_at + 1, close)
                    if c == "!":
                        got = [e for e in inner if e[0] != "link"]
                    elif not any(e[0] == "link" for e in inner):
                        got = [("link", dest, k), *([("title", title, k)] if title else []), *inner]
            elif c in "*_~":
                n = len(s[k:b]) - len(s[k:b].lstrip(c))
                got, end = [("mark", s[k:k + n], k)], k + n
            if got is None:
                k += 1
                continue
            flush(k)
            out += got
            k = plain = end
        flush(b)
        return out

    def link(self, i: int, b: int) -> tuple[str, str, int, int] | None:
        close = closing(self.s[:b], i)
        if close < 0:
            return None
        if self.s[close + 1:close + 2] == "(" and (d := destination(self.s[:b], close + 1)):
            return d[0], d[1], close, d[2]
        label, end = self.s[i + 1:close], close + 1
        if m := re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(self.s, close + 1, b):
            label, end = m[1] or label, m.end()
        dest = self.definitions.get(label_key(label))
        return None if dest is None or not label.strip() else (dest, "", close, end)


def settle_marks(s: str, events: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """Emphasis marks that pair off vanish; others become text."""
    left = [len(v) if t == "mark" else 0 for t, v, _ in events]
    stack: list[int] = []
    for k, (t, v, at) in enumerate(events):
        if t != "mark":
            continue
        before, after = s[at - 1:at] or " ", s[at + len(v):at + len(v) + 1] or " "
        punct = lambda c: not c.isalnum() and not c.isspace()
        opens = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
        closes = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
        if v[0] == "_":
            opens, closes = opens and (not closes or punct(before)), closes and (not opens or punct(after))
        if closes:
            while left[k]:
                o = next((j for j in reversed(stack) if events[j][1][0] == v[0] and left[j]), None)
                if o is None:
                    break
                n = min(left[o], left[k], 2)
                left[o] -= n
                left[k] -= n
                while stack and stack[-1] > o:
                    stack.pop()
        if opens and left[k]:
            stack.append(k)
    return [("text", v[:left[k]], at) if t == "mark" else (t, v, at) for k, (t, v, at) in enumerate(events) if t != "mark" or left[k]]


_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
_CONTENT = "|".join(e for e in RAW_TEXT if e != "plaintext")
#: What markup consists of: comments, elements of raw text with their content, other tags; a tag without an end takes all that follows.
MARKUP_PIECE = re.compile(rf"<!--(?:.*?-->|(?P<comment>.*))|<(?P<element>{_CONTENT})(?=[\s>]){_ATTRIBUTES}(?:.*?</(?P=element)(?=[\s>/]){_ATTRIBUTES}|(?P<open>.*))"
                          rf"|(?P<endless><plaintext(?=[\s>]){_ATTRIBUTES}.*)|(?P<tag><{_ATTRIBUTES})|<.*", re.I | re.S)
#: How a piece ends that an earlier run of markup left open.
CLOSING = {"!--": re.compile("-->"), "plaintext": re.compile("(?!)")} | {e: re.compile(rf"</{e}(?=[\s>/]){_ATTRIBUTES}", re.I) for e in RAW_TEXT if e != "plaintext"}


def explicit_anchors(markup: str, unclosed: str | None) -> tuple[list[tuple[str, int]], str | None]:
    """Anchors in a run of markup, and what it leaves open: a comment, an element of raw text, or nothing."""
    start = 0
    if unclosed:
        closed = CLOSING[unclosed].search(markup)
        if not closed:
            return [], unclosed
        start = closed.end()
    pieces = list(MARKUP_PIECE.finditer(markup, start))
    names = [(a[1], m.start()) for m in pieces if m["tag"] and (a := ANCHOR.fullmatch(m["tag"]))]
    last = pieces[-1] if pieces else None
    if last is None or last["comment"] is last["open"] is last["endless"] is None:
        return names, None
    return names, "!--" if last["comment"] is not None else "plaintext" if last["endless"] else last["element"].lower()


@dataclass
class Document:
    title: str | None
    headings: list[tuple[int, int, int, str]]  # level, start, end, text
    anchors: list[tuple[str, int]]
    links: list[tuple[str, int]]


def parse(text: str) -> Document:
    """Structure of a whole document; offsets are characters of ``text``."""
    front = front_matter(text)
    base = front[2] if front else 0
    found = Found()
    starts, stops, ends = line_bounds(text[base:] if base else text)
    empty = starts == stops
    kept = np.flatnonzero(~empty | ~np.append(False, empty[:-1]))  # of empty lines one behind another, the first says it all
    parse_blocks([Line(base + a, text[base + a:base + b], base + c) for a, b, c in zip(starts[kept].tolist(), stops[kept].tolist(), ends[kept].tolist(), strict=True)], 0, 0, found)
    doc = Document(None, [], [], [])
    runs: list[tuple[str, int, int]] = []  # markup outside quotes
    for block in found.blocks:
        if block[0] == "html":
            rows, quotes = block[1], block[2]
            doc_runs = [(text[r.at:r.end], r.at) for r in rows]
            if not quotes and doc_runs:
                runs.append(("".join(x for x, _ in doc_runs) if rows[-1].end - rows[0].at == sum(len(x) for x, _ in doc_runs) else text[rows[0].at:rows[-1].end], rows[0].at, rows[-1].end))
            continue
        parts, quotes = (block[4], block[5]) if block[0] == "heading" else (block[1], block[2])
        s = "\n".join(p for p, _ in parts)
        starts, at = [], 0
        for p, o in parts:
            starts.append((at, o))
            at += len(p) + 1
        heads = [a for a, _ in starts]

        def place(k: int) -> int:
            a, o = starts[bisect_right(heads, k) - 1]  # noqa: B023
            return o + k - a

        events = settle_marks(s, Inline(s, found.definitions, found.notes).run(0, len(s)))
        for t, v, k in events:
            if t == "link":
                doc.links.append((v, place(k)))
            elif t == "html" and not quotes:
                runs.append((v, place(k), place(k) + len(v)))
        if block[0] == "heading":
            _, level, start, end, _, quotes, lists = block
            if not quotes and not lists:
                doc.headings.append((level, start, end, "".join(" " if t == "break" else v for t, v, _ in events if t in ("text", "code", "break"))))
                if doc.title is None:
                    doc.title = "".join("\n" if t == "break" else v for t, v, _ in events if t in ("text", "code", "html", "break"))
    merged: list[list] = []
    for value, a, b in sorted(runs, key=lambda r: r[1]):
        if merged and not text[merged[-1][1]:a].strip():
            merged[-1][1] = b
        else:
            merged.append([a, b])
    state = None
    for a, b in merged:
        got, state = explicit_anchors(text[a:b], state)
        doc.anchors += [(name, a + k) for name, k in got]
    return doc
