"""Token counts of fields or sections, from one encoding of each whole document.

A document is encoded once, so tokens are those a model would see. A byte-level token stands for known bytes, and the tokens of a
text are its bytes one after another, so lengths of tokens give their spans. The spans are joined with those of the sections by binary search over
the sections' ends. A token that lies in one section counts there; one that crosses a boundary is allotted by ``rule``:

- ``start``: to the section of its first byte;  ``end``: of its last byte;
- ``majority``: to the section that holds most of its bytes, the earlier of equals;
- ``fraction``: to each in proportion to its bytes (counts are then not whole).

Under each rule the counts of a document add up to its tokens. Sections are lines, each with the \\n that ends it, or given columns:
the document is then their texts joined by ``separator``, which belongs to the column before it; a null column is an empty section.

Texts with a run of LONG_RUN characters of white space, or of others, are encoded by the rank queue of the operator for byte-level BPE, as the library's time grows
with the square of a run, and very long white space exhausts its stack; both give the same ids.

Rules: a null or empty document has one section, number 0, without tokens; bytes that are not UTF-8 count as U+FFFD; strings of special tokens are
ordinary text; repeated rows are counted each. Whole texts are encoded, whatever their length; no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.bpe import codec, load_ranks
from lectern.llm.common import released, small_batches, texts

LONG_RUN = 2_000
RULES = ("start", "end", "majority", "fraction")


def allot(sizes: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, from token sizes and section ends in bytes; the last section ends with the last token."""
    stop = np.cumsum(sizes)
    start = stop - sizes
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
    if rule == "start":
        return np.bincount(a, minlength=len(ends)).astype(float)
    if rule == "end":
        return np.bincount(b, minlength=len(ends)).astype(float)
    inside = a == b
    out = np.bincount(a[inside], minlength=len(ends)).astype(float)
    for t in np.flatnonzero(~inside).tolist():  # tokens that cross a boundary
        cuts = np.concatenate([[start[t]], ends[a[t]:b[t]], [stop[t]]])
        share = np.diff(cuts)
        if rule == "majority":
            out[a[t] + int(share.argmax())] += 1
        else:
            out[a[t]:b[t] + 1] += share / sizes[t]
    return out


class Encoder:
    """Ids of texts, and the bytes of each id's token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = load_ranks(path)
        self.path, self.pattern = path, pattern
        self.usual = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.white = re.compile(rf"\s{{{LONG_RUN}}}").search
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for tok, r in ranks.items():
            self.size[r] = len(tok)

    def ids(self, text: str) -> np.ndarray:
        if self.white(text) or max(map(len, text.split()), default=0) >= LONG_RUN:
            return np.frombuffer(codec(self.path, self.pattern).encode(text), "<u4")
        return np.array(self.usual(text), np.int64)


def line_ends(data: bytes) -> np.ndarray:
    """Ends in bytes of lines with their \\n; no empty line after a last \\n."""
    at = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return at if len(at) and at[-1] == len(data) else np.append(at, len(data))


def attribute(docs: DataFrame, path: str, pattern: str, rule: str = "majority", id_col: str = "doc_id", fields: list[str] | None = None,
              text_col: str = "text", separator: str = "\n") -> DataFrame:
    """Rows (id, section from 0, first_char, end_char, n_tokens double) for the lines of ``text_col``, or for ``fields`` in their order."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    columns = fields or [text_col]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
    names = ["id", "section", "first_char", "end_char", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            parts = [[x or "" for x in texts(batch, f"c{k}")] for k in range(len(columns))]
            whole = [separator.join(own) for own in zip(*parts, strict=True)] if fields else parts[0]
            out: list[list] = [[] for _ in kinds]
            for n, (i, text) in enumerate(zip(batch.column(0).to_pylist(), whole, strict=True)):
                if fields:
                    own = [p[n] for p in parts]
                    glued = [x + separator for x in own[:-1]] + own[-1:]
                    ends, chars = np.cumsum([len(x.encode("utf-8", "replace")) for x in glued]), np.cumsum([len(x) for x in glued])
                else:
                    data = text.encode("utf-8", "replace")
                    ends = line_ends(data)
                    wide = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80  # first bytes of characters
                    chars = np.concatenate([[0], np.cumsum(wide)])[ends]
                got = allot(encoder.size[encoder.ids(text)], ends, rule)
                out[0] += [i] * len(ends)
                out[1] += range(len(ends))
                out[2] += [0, *chars[:-1].tolist()]
                out[3] += chars.tolist()
                out[4] += got.tolist()
            for k in range(0, len(out[0]), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c[k:k + 8192], t) for c, t in zip(out, kinds, strict=True)], names)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) id", *[f"cast(`{c}` as string) c{k}" for k, c in enumerate(columns)])
    return rows.mapInArrow(released(run), "id long, section int, first_char long, end_char long, n_tokens double").withColumnRenamed("id", id_col)
