"""Five commands over a project's documents, with bounded, continuable JSON pages.

A command composes lazy operators; what reaches the driver is a page of records, the warnings and counts.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.errors import QueryError
from lectern.functions.text import query_terms, raw_lines
from lectern.operators import checks, identity, lines, metadata, paging, ranking, relations, scan, structure
from lectern.sources import files

SAFE, QUERY_BYTES, PASSAGES, REFERENCES, FINDINGS, RETAINED = (1 << 53) - 1, 4_096, 32_768, 32_768, 2_048, 65_536

def _target_details(row: Any) -> dict:
    clash = row["clashing"]
    if clash is not None and row["error"]["code"] == "AMBIGUOUS_ANCHOR":
        return {"anchor": clash["anchor"], "cause": "the same anchor ID names more than one target section", "firstLine": clash["clash"], "line": clash["line_start"]}
    return {"document": row["to_id"], "line": 1, "version": row["to_version"]}


class Project:
    def __init__(self, documents: DataFrame, warnings: list[dict], selection: str, held: tuple[DataFrame, ...] = ()):
        """``documents``: id, text, hash, historical, title, status, links; ``held``: frames that close() releases."""
        spark = documents.sparkSession
        order = Window.orderBy(F.collate("id", "UNICODE"), "id")  # of 2 048 documents at most
        self.documents = documents.withColumn("ord", F.row_number().over(order)).persist()
        self.ids = [r["id"] for r in self.documents.select("id").orderBy("ord").collect()]
        self.warnings, self.spark, self.held = warnings, spark, held
        self.snapshot = identity.snapshot(self.documents, selection).first()["snapshot"]
        self.outlines = structure.outline(self.documents, "hash", "historical").persist()

    def close(self) -> None:
        """Release what is held on the executors."""
        self.outlines.unpersist()
        self.documents.unpersist()
        for held in self.held:
            held.unpersist()

    def __enter__(self) -> Project:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _outlines(self, documents: DataFrame) -> DataFrame:
        return self.outlines.join(documents.select("id"), "id")

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: str = "lectern.json") -> Project:
        root = files.root_folder(root)
        rules = files.selection(root, config)
        found, warnings = files.walk(root, rules)
        places = files.collated(spark, [p for p, _, _ in found])
        kept, more = files.within_budget(sorted(found, key=lambda f: (f[1], places[f[0]])))
        documents, broken, text = files.load(spark, root, kept)
        warnings += [*more, *((r["path"], r["message"]) for r in broken.collect())]
        return cls(documents, [{"path": p, "message": m} for p, m in warnings], rules.identity(), (text,))

    # -- shared parts of responses

    @property
    def status(self) -> str:
        return "partial" if self.warnings else "ready"

    def _head(self, command: str) -> dict:
        return {"command": command, "modelCalls": 0, "origin": "current-worktree", "snapshot": self.snapshot}

    def _coverage(self) -> str:
        return "partial" if self.warnings else "selected-sources"

    def _known(self, sources: list[str], message: str) -> list[str]:
        wanted = sorted(set(sources), key=lambda s: s.encode())
        if missing := next((s for s in wanted if s not in set(self.ids)), None):
            raise QueryError("SOURCE_NOT_FOUND", message, {"document": missing})
        return wanted

    def _no_limit(self, documents: DataFrame) -> None:
        if not self._outlines(documents).where("over").isEmpty():
            raise QueryError("ANCHOR_LIMIT", f"At most {scan.MAX_ANCHORS} headings and explicit anchors are supported per document")

    # -- commands

    def sources(self, limit: int | None = None, max_bytes: int | None = None, cursor: str | None = None) -> dict:
        limit = min(paging.count_argument("limit", limit, 20, SAFE), files.DOCUMENTS)
        most = paging.count_argument("max-bytes", max_bytes, paging.DEFAULT_BYTES, paging.MOST_BYTES)
        at = paging.Cursor("s1", self.snapshot)
        start, total = at.offset(cursor), len(self.ids)
        paging.inside(start, total)
        rows = self.documents.orderBy("ord").offset(start).limit(limit).select("hash", "historical", "id", "links", F.col("id").alias("path"), "status", "title").collect()
        warnings = [{"message": w["message"], "path": w["path"]} for w in self.warnings]
        return paging.page([r.asDict() for r in rows], most, lambda p: {
            "command": "sources", "continuation": at.after(start + len(p), total), "documents": p, "origin": "current-worktree", "snapshot": self.snapshot,
            "totalDocuments": total, "warnings": warnings}, lambda r: QueryError("OUTPUT_LIMIT", "The next complete source record exceeds --max-bytes"))

    def read(self, document: str, first: int | None = None, last: int | None = None, max_bytes: int | None = None) -> dict:
        first, last = (None if x is None else paging.count_argument(n, x, 1, SAFE) for n, x in (("from", first), ("to", last)))
        most = paging.count_argument("max-bytes", max_bytes, paging.DEFAULT_BYTES, paging.MOST_BYTES)
        if document not in self.ids:
            raise QueryError("SOURCE_NOT_FOUND", f"Markdown source was not selected: {document}", {"id": document})
        own = self.documents.where(F.col("id") == document)
        count = own.select(F.size(raw_lines(F.col("text"))).alias("n")).first()["n"]
        a, b = first or 1, last or count
        if a > b or b > count:
            raise QueryError("INVALID_RANGE", f"Line range {a}-{b} is outside the source", {"id": document, "lineCount": count})
        wanted = lines.lines(own).where(F.col("line").between(a, b))
        zero = wanted.agg(F.min("byte_start")).first()[0]
        stop = F.when(F.col("line") == count, F.col("byte_end")).otherwise(F.col("byte_start") + F.octet_length("content")) - zero
        sized = wanted.withColumn("stop", stop)
        over = sized.where(F.col("stop") > most).agg(F.min("line").alias("line"), F.min_by("stop", "line").alias("need")).first()
        if over["line"] == a:
            raise QueryError("OUTPUT_LIMIT", "The first requested line exceeds --max-bytes", {"line": a, "maxBytes": most, "requiredBytes": over["need"]})
        end = b if over["line"] is None else over["line"] - 1
        text = lines.read_range(own, a, end).first()["text"]
        meta = own.select("hash", "historical", "id", "links", F.col("id").alias("path"), "status", "title").first().asDict()
        more = None if end >= count else {"from": end + 1, "maxBytes": most, "reason": "max-bytes" if end < b else "range", "to": count}
        return {"command": "read", "continuation": more, "lineEnd": end, "lineStart": a, "origin": "current-worktree", "snapshot": self.snapshot, "source": meta, "text": text,
                "truncated": more is not None, "warnings": [{"message": w["message"], "path": w["path"]} for w in self.warnings]}

    def search(self, query: str, sources: list[str] = (), historical: bool = False, limit: int | None = None, max_bytes: int | None = None, cursor: str | None = None) -> dict:
        if not query.strip() or len(query.encode()) > QUERY_BYTES:
            raise QueryError("INVALID_ARGUMENT", f"A query is text of up to {QUERY_BYTES} bytes")
        limit = paging.count_argument("limit", limit, 6, 64)
        most = paging.count_argument("max-bytes", max_bytes, paging.DEFAULT_BYTES, paging.MOST_BYTES)
        asked = sorted(set(sources), key=lambda s: s.encode())
        at = paging.Cursor.of("q2", ["context-v1", self.snapshot, query, asked, historical, limit, most])
        start = at.offset(cursor)
        self._known(asked, "Search requires selected source IDs")
        scope = checks.searched(self.documents, asked, historical)
        rows, total = [], 0
        if query_terms(query):
            self._no_limit(scope)
            cut = lines.passages(scope)
            if cut.count() > PASSAGES:
                raise QueryError("SEARCH_LIMIT", f"At most {PASSAGES} source passages can be indexed; narrow selected sources", {"limit": PASSAGES})
            parts = structure.unfolded(self._outlines(scope), "sections")
            best = ranking.distinct_ranges(structure.with_context(ranking.hits(cut, query), parts)).join(scope.select("id", "ord"), "id").persist()
            total = best.count()
            page = ranking.top(best, limit, start, "ord")
            rows = ranking.with_text(page, scope).orderBy(F.round("score", 12), "ord", "first_line").collect()  # 64 at most
            best.unpersist()
        paging.inside(start, total)
        found = [{"document": r["id"], "version": r["hash"], "historical": r["historical"], "lineStart": r["range_first"], "lineEnd": r["range_last"], "text": r["_text"],
                  "context": {"lineStart": r["context_first"], "lineEnd": r["context_last"], "complete": (r["range_first"], r["range_last"]) == (r["context_first"], r["context_last"])}} for r in rows]
        return paging.page(found, most, lambda p: self._head("search") | {
            "query": query, "sources": asked, "historical": historical, "status": self.status, "coverage": self._coverage(),
            "scope": "lexical source passages; a match does not establish semantic applicability or exhaust relevant context",
            "matches": p, "totalMatches": total, "warnings": self.warnings, "continuation": at.after(start + len(p), total)},
            lambda m: QueryError("OUTPUT_LIMIT", "The next complete passage exceeds --max-bytes; read its cited range or increase the limit", {
                "document": m["document"], "from": m["lineStart"], "to": m["lineEnd"], "context": {"from": m["context"]["lineStart"], "to": m["context"]["lineEnd"]}}))

    def _edges(self, declaring: DataFrame) -> DataFrame:
        declared = relations.declarations(structure.unfolded(self._outlines(declaring), "entries"))
        return relations.edges(declared, relations.targets(self.outlines)).join(self.documents.select("id", "ord", "hash", "historical"), "id")

    @staticmethod
    def _fault(row: Any) -> QueryError:
        f = row["fault"]
        if f["message"] in checks.AT_TARGET:
            details = {"document": row["id"], "line": row["line"], "target": row["target"], "targetDetails": _target_details(row)}
        else:
            details = {"document": row["id"], "line": row["line"], "version": row["hash"]} | ({"cause": f["cause"]} if f["cause"] else {})
        return QueryError(f["code"], f["message"], details)

    def relations(self, document: str, direction: str = "both", limit: int | None = None, max_bytes: int | None = None, cursor: str | None = None) -> dict:
        if "#" in document:
            raise QueryError("INVALID_ARGUMENT", "Use a document id without a fragment")
        if direction not in ("outgoing", "incoming", "both"):
            raise QueryError("INVALID_ARGUMENT", "--direction must be outgoing, incoming or both")
        limit = paging.count_argument("limit", limit, 20, 2_048)
        most = paging.count_argument("max-bytes", max_bytes, paging.DEFAULT_BYTES, paging.MOST_BYTES)
        if document not in self.ids:
            raise QueryError("SOURCE_NOT_FOUND", "Relations require a selected document ID")
        declaring = checks.declaring(self.documents, document, direction)
        self._no_limit(declaring)
        rows = self._edges(declaring).persist()
        ahead = Window.orderBy("ord", "line").rowsBetween(Window.unboundedPreceding, 0)
        numbered = rows.withColumn("n", F.count(F.lit(1)).over(ahead))
        bad = numbered.where((F.col("fault").isNotNull()) | (F.col("n") > relations.DECLARATIONS)).orderBy("ord", "line").first()
        if bad:
            rows.unpersist()
            if bad["n"] > relations.DECLARATIONS:
                raise QueryError("RELATION_LIMIT", f"At most {relations.DECLARATIONS} authored declarations are supported per query",
                                 {"document": bad["id"], "line": bad["line"], "limit": relations.DECLARATIONS})
            raise self._fault(bad)
        at = paging.Cursor.of("r1", [self.snapshot, document, direction, limit, most])
        start = at.offset(cursor)
        near = relations.around(rows, document, direction).persist()
        total = near.count()
        paging.inside(start, total)
        page = near.orderBy("id", "line", "to_id", F.col("to_anchor").asc_nulls_first()).offset(start).limit(limit).collect()
        rows.unpersist()
        near.unpersist()
        found = [{"kind": r["kind"], "literal": r["literal"],
                  "from": {"document": r["id"], "anchor": None, "version": r["hash"], "historical": r["historical"], "lineStart": r["line"], "lineEnd": r["line"]},
                  "to": {"document": r["to_id"], "anchor": r["to_anchor"], "version": r["to_version"], "historical": r["to_historical"], "lineStart": r["to_first"], "lineEnd": r["to_last"]},
                  "reason": r["reason"], "navigation": r["navigation"]} for r in page]
        return paging.page(found, most, lambda p: self._head("relations") | {
            "document": document, "direction": direction, "scope": "document; declared direction is preserved; incoming considers ordinary sources and the queried source",
            "status": self.status, "coverage": self._coverage(), "relations": p, "totalRelations": total, "warnings": self.warnings, "continuation": at.after(start + len(p), total)},
            lambda _: QueryError("OUTPUT_LIMIT", "The next complete relation exceeds --max-bytes; increase it within 65536"))

    def check(self, sources: list[str] = (), historical: bool = False, limit: int | None = None, max_bytes: int | None = None, cursor: str | None = None) -> dict:
        limit = paging.count_argument("limit", limit, 20, 2_048)
        most = paging.count_argument("max-bytes", max_bytes, paging.DEFAULT_BYTES, paging.MOST_BYTES)
        asked = sorted(set(sources), key=lambda s: s.encode())
        at = paging.Cursor.of("v2", [self.snapshot, asked, historical, limit, most])
        start = at.offset(cursor)
        self._known(asked, "Validation requires selected source IDs")
        scope = checks.checked(self.documents, asked, historical)
        bodies = checks.bodies(scope, asked, historical)
        counted = scope.agg(F.count(F.lit(1)), F.count_if(metadata.is_documentation(F.col("id")))).first()
        checked_bodies = bodies.count()
        near, known = self._outlines(bodies), relations.targets(self.outlines)
        refs = checks.references(near, checks.retained(checks.local_links(near), known, self.documents, RETAINED)).persist()
        if refs.count() > REFERENCES:
            raise QueryError("CHECK_LIMIT", f"At most {REFERENCES} local Markdown references can be validated; narrow source selection")
        found = checks.findings(scope, near, self._edges(bodies), refs).join(self.documents.select("id", F.col("ord").alias("doc_ord"), "hash"), "id").persist()
        total = found.count()
        if total > FINDINGS:
            raise QueryError("CHECK_LIMIT", f"Validation exceeds {FINDINGS} findings; narrow source selection")
        paging.inside(start, total)
        rows = found.orderBy("doc_ord", "phase", "ord").offset(start).limit(limit).collect()
        found.unpersist()
        refs.unpersist()
        records = [{"document": r["id"], "version": r["hash"]} | json.loads(r["finding"]) for r in rows]
        status = "failed" if total else self.status
        return paging.page(records, most, lambda p: self._head("check") | {
            "status": status, "coverage": self._coverage(), "sources": asked, "historical": historical, "checkedDocuments": counted[0], "checkedMetadataDocuments": counted[1],
            "checkedReferenceDocuments": checked_bodies, "totalFindings": total, "warnings": self.warnings,
            "scope": "outer metadata under docs, authored relation syntax and selected local Markdown references; historical bodies require explicit selection; no semantic certification",
            "findings": p, "continuation": at.after(start + len(p), total)}, lambda _: QueryError("OUTPUT_LIMIT", "The next complete validation finding exceeds --max-bytes"))
