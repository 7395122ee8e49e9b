"""Errors that a caller can tell apart by their code."""

from __future__ import annotations

import json
from typing import Any

#: Serialized bytes that a report gives a message and its details.
MESSAGE_BYTES, DETAILS_BYTES = 256, 384


def compact(value: Any) -> str:
    """JSON in insertion order, without spaces; only what JSON must escape is escaped."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class QueryError(Exception):
    def __init__(self, code: str, message: str, details: Any = None):
        super().__init__(message)
        self.code, self.message, self.details = code, message, details

    def report(self) -> dict:
        """A bounded account: the message is cut at a character, details that are too long are left out."""
        room, keep = MESSAGE_BYTES - 2, 0
        for c in self.message:
            room -= len(compact(c).encode()) - 2
            if room < 0:
                break
            keep += 1
        out: dict[str, Any] = {"code": self.code}
        if self.details is not None:
            out["details"] = {"omitted": True} if len(compact(self.details).encode()) > DETAILS_BYTES else self.details
        return {"error": out | {"message": self.message[:keep], "messageTruncated": keep < len(self.message)}}
