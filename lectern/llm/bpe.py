"""Byte-level BPE encoding and decoding with a rank queue over a hierarchical bitmap.

Pre-tokens stand one after another in a doubly linked list of token ids, with a barrier between
any two. Every adjacent pair that the vocabulary can merge stands in the bucket of its merge
rank as a list position. A two-level bitmap tells which buckets hold anything: one summary
integer, and one integer of 256 bits for each block of 256 ranks. Find-first-set
gives the next rank; a position whose pair is no longer of that rank is stale and skipped. As
pre-tokens don't influence each other, one queue serves all new pre-tokens of a buffer of
documents, and a bucket is merged as arrays. Work is O(n log n) in the bytes, however long a
pre-token is, where the usual scan for the lowest pair costs O(n^2).

Rules: a null text has no ids; text is split by the vocabulary's pattern, each match is
encoded separately, special tokens do not exist, bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import released, small_batches, texts

#: Characters of text whose new pre-tokens share one queue.
BUFFER_CHARS = 1_000_000
#: Units whose ids a worker remembers from one buffer to the next.
KNOWN_UNITS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of list positions by merge rank, under a two-level bitmap."""

    def __init__(self) -> None:
        self.top, self.blocks = 0, {}
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []  # not yet dealt out to buckets
        self.lowest = 1 << 62  # lowest rank that waits

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks):
            self.waiting.append((ranks, positions))
            self.lowest = min(self.lowest, int(ranks.min()))

    def put(self, rank: int, positions: np.ndarray) -> None:
        if (bucket := self.buckets.get(rank)) is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        block = rank >> 8
        self.blocks[block] = self.blocks.get(block, 0) | 1 << (rank & 255)
        self.top |= 1 << block

    def deal(self) -> None:
        ranks = np.concatenate([r for r, _ in self.waiting])
        positions = np.concatenate([p for _, p in self.waiting])
        self.waiting, self.lowest = [], 1 << 62
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        at = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *at.tolist()]
        for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
            self.put(rank, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank with its positions, some perhaps stale."""
        while True:
            if self.top:
                block = (self.top & -self.top).bit_length() - 1
                bits = self.blocks[block]
                rank = block << 8 | (bits & -bits).bit_length() - 1
                if rank < self.lowest:
                    break
            elif not self.waiting:
                return None
            self.deal()
        if bits := bits & (bits - 1):
            self.blocks[block] = bits
        else:
            del self.blocks[block]
            self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        #: White space beside white space or at either end: there the short cut of plan() doesn't hold.
        self.uneven = regex.compile(r"\s\s|\A\s|\s\Z").search
        self.vocab = {v: k for k, v in ranks.items()}
        self.packed = {k: v.to_bytes(4, "little") for k, v in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.barrier = max(ranks.values()) + 1
        keys, values = [], []
        for tok, r in ranks.items():
            for i in range(1, len(tok)):
                a, b = ranks.get(tok[:i]), ranks.get(tok[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        #: Tokens that take part in a merge of a lower rank than their own.
        lower = np.zeros(self.barrier, bool)
        for part in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            lower[part[self.values < part]] = True
        self.lower = lower.tolist()
        self.twin = self._pair_of_equals(ranks)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _pair_of_equals(ranks: dict[bytes, int]) -> set[int]:
        return {r for t, r in ranks.items() if len(t) > 1 and len(t) % 2 == 0 and t[:len(t) // 2] == t[len(t) // 2:]}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, -1 where the vocabulary has none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers. In a piece the lowest rank goes first, leftmost first among equals."""
        if not pieces:
            return []
        flat = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
        ids = self.first[flat]
        ids[0] = self.barrier
        ids[ends] = self.barrier
        n = len(ids)
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, -1, np.int64)
        rank[:-1] = self.ranks_of(ids[:-1], ids[1:])
        queue = RankQueue()
        at = np.flatnonzero(rank >= 0)
        queue.add(rank[at], at)
        while (popped := queue.pop()) is not None:
            r, i = popped
            i = i[rank[i] == r]
            if not len(i):
                continue
            if len(i) > 1 and self.lower[r]:  # a merge may call for a lower rank next: one merge a piece
                i = np.sort(i)
                later = self._wait(r, i, np.searchsorted(ends, i), ids, nxt, prev)
                if later.any():
                    queue.put(r, i[later])
                    i = i[~later]
            if len(i) > 1 and r in self.twin:  # of overlapping pairs every other one merges, from the left
                i = np.sort(i)
                chain = np.flatnonzero(np.concatenate([[True], i[1:] != nxt[i[:-1]]]))
                i = i[(np.arange(len(i)) - np.repeat(chain, np.diff([*chain, len(i)]))) % 2 == 0]
            j = nxt[i]
            after, before = nxt[j], prev[i]
            ids[i], ids[j] = r, -1
            rank[j] = -1
            nxt[i], prev[after] = after, i
            # where merged tokens touch, both sides name the same pair; it is then entered twice, once as stale
            at = np.concatenate([i, before])
            got = self.ranks_of(ids[at], ids[nxt[at]])
            rank[at] = got
            ok = got >= 0
            queue.add(got[ok], at[ok])
        alive = ids >= 0
        alive[0] = False
        alive[ends] = False
        buf = ids[alive].astype("<u4").tobytes()
        cuts = (np.cumsum(alive)[ends] * 4).tolist()
        return [buf[a:b] for a, b in zip([0, *cuts], cuts)]

    def _wait(self, r: int, i: np.ndarray, piece: np.ndarray, ids: np.ndarray, nxt: np.ndarray, prev: np.ndarray) -> np.ndarray:
        """Which of the positions can't merge in this round, as a merge before them in their piece calls for a lower rank."""
        again = np.concatenate([[False], piece[1:] == piece[:-1]])
        later = np.zeros(len(i), bool)
        if not again.any():
            return later
        sharing = np.flatnonzero(again | np.concatenate([again[1:], [False]]))
        k = i[sharing]
        token = np.full(len(k), r)
        low = np.zeros(len(k), bool)
        for q in (self.ranks_of(ids[prev[k]], token), self.ranks_of(token, ids[nxt[nxt[k]]]), self.ranks_of(token, token)):
            low |= (q >= 0) & (q < r)
        if low.any():
            later[sharing] = np.isin(piece[sharing], piece[sharing[low]])
            later &= again
        return later

    def plan(self, text: str) -> tuple[str, list[str]]:
        """Units of a text whose ids don't depend on their surroundings, and the text before the first.

        Where no white space stands beside white space, a match never crosses the start of a space or
        newline: " x" and "\\nx" are units, written without the space and with the newline.
        """
        first, *units = text.replace("\n", " \n").split(" ")
        return first, units

    def pieces(self, unit: str) -> list[str]:
        if unit.isalpha():
            return [" " + unit]
        return self.find(unit if unit[0] == "\n" else " " + unit)

    def encode_all(self, docs: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        known, packed = self.known, self.packed
        if len(known) > KNOWN_UNITS:
            known.clear()
        used: set[str] = set()
        need: set[str] = set()
        whole = [bool(text and self.uneven(text)) for text in docs]
        for text, at_once in zip(docs, whole, strict=True):
            if at_once:
                need.update(self.find(text))
            elif text:
                first, units = self.plan(text)
                need.update(self.find(first))
                used.update(units)
        parts = {u: self.pieces(u) for u in used.difference(known)}
        del used
        for ps in parts.values():
            need.update(ps)
        ids: dict[str, bytes] = {}
        rest, data = [], []
        for x in need:
            if (got := packed.get(d := x.encode("utf-8", "replace"))) is None:
                rest.append(x)
                data.append(d)
            else:
                ids[x] = got
        del need
        ids.update(zip(rest, self.merge_all(data), strict=True))
        for u, ps in parts.items():
            known[u] = ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps])
        del parts, rest, data
        out = []
        for text, at_once in zip(docs, whole, strict=True):
            if not text:
                out.append(b"")
            elif at_once:
                out.append(b"".join(map(ids.__getitem__, self.find(text))))
            else:
                first, units = self.plan(text)
                out.append(b"".join([*map(ids.__getitem__, self.find(first)), *map(known.__getitem__, units)]))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_LOADED: dict[tuple[str, str], Bpe] = {}


def codec(path: str, pattern: str) -> Bpe:
    """One codec for each worker and vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids (array<int>). Narrow: no shuffle.

    An empty or null text gives zero tokens and the hashes of nothing. Repeated rows stay repeated;
    other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        sha = hashlib.sha256
        keys: list[int | None] = []
        held: list[str | None] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            packed = bpe.encode_all(held)
            step = 256
            for k in range(0, len(keys), step):
                some = packed[k:k + step]
                cols = [pa.array(keys[k:k + step], pa.int64()), pa.array([len(p) // 4 for p in some], pa.int64()),
                        pa.array([sha(p).hexdigest() for p in some], pa.string()),
                        pa.array([sha(bpe.decode(p)).hexdigest() for p in some], pa.string())]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(p, "<i4") for p in some], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            keys += batch.column(0).to_pylist()
            held += (got := texts(batch, "text"))
            size += sum(len(t or "") for t in got)
            if size >= BUFFER_CHARS:
                yield from flush()
                keys, held, size = [], [], 0
        if keys:
            yield from flush()

    ddl = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    rows = docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text").mapInArrow(released(run), ddl)
    return rows.withColumnRenamed("id", id_col)
