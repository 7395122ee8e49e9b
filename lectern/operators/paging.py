"""Pages bounded in bytes, and the cursors that continue them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.errors import QueryError, compact

DEFAULT_BYTES, MOST_BYTES = 16_384, 65_536


def count_argument(name: str, value: int | None, default: int, most: int) -> int:
    value = default if value is None else value
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise QueryError("INVALID_ARGUMENT", f"{name} must be a whole number from 1 to {most}")
    return value


def fitting(records: DataFrame, order: list[Column], record: Column, envelope: int, max_bytes: int) -> DataFrame:
    """Records of the longest prefix whose JSON, with commas and an envelope of ``envelope`` bytes, fits: a running sum over a bounded page."""
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.octet_length(record) + 1).over(so_far) - 1 + envelope
    return records.withColumn("used_bytes", used).where(F.col("used_bytes") <= max_bytes)


class Cursor:
    """``version.key.offset``; the key binds it to a snapshot and to the options of the query."""

    def __init__(self, version: str, key: str):
        self.prefix = f"{version}.{key}."

    @classmethod
    def of(cls, version: str, options: list) -> Cursor:
        return cls(version, hashlib.sha256(compact(options).encode()).hexdigest())

    def offset(self, given: str | None) -> int:
        if given is None:
            return 0
        digits = given[len(self.prefix):] if given.startswith(self.prefix) else ""
        if not (digits.isascii() and digits.isdigit()):
            raise QueryError("INVALID_CURSOR", "Continuation belongs to a different snapshot or query options")
        return int(digits)

    def after(self, end: int, total: int) -> str | None:
        return f"{self.prefix}{end}" if end < total else None


def inside(offset: int, total: int) -> None:
    if 0 < offset and offset >= total:
        raise QueryError("INVALID_CURSOR", "Continuation is outside this result")


def page(records: Iterable[Any], max_bytes: int, render: Callable[[list], dict], too_big: Callable[[Any], QueryError]) -> dict:
    """The response with the longest prefix of records that fits as a whole.

    It ends before the first record that doesn't fit, though the last record might, by making the continuation null.
    """
    kept: list[Any] = []
    best = render(kept)
    for r in records:
        trial = render([*kept, r])
        if len(compact(trial).encode()) > max_bytes:
            if not kept:
                raise too_big(r)
            break
        kept, best = [*kept, r], trial
    if len(compact(best).encode()) > max_bytes:
        raise QueryError("OUTPUT_LIMIT", "Response metadata exceeds --max-bytes")
    return best
