"""Typed edges that documents declare, resolved to documents and line ranges.

A document declares edges under one heading "## Relationships", one list item each:

    - Depends on [label](path.md#anchor): reason

Nothing is dropped silently: each declaration, good or bad, is a row, and a bad one names its first fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import folder, has_scheme, is_markdown, normalized, percent_decoded, trimmed
from lectern.operators.scan import MAX_ANCHORS
from lectern.operators.structure import nav_label, outline, unfolded

#: Edge kinds and how documents write them. Fixed values.
KINDS = {"depends-on": "Depends on", "exception-to": "Exception to", "supersedes": "Supersedes", "implements": "Implements", "extends": "Extends"}
DECLARATIONS = 2_048
TOO_MANY = f"At most {MAX_ANCHORS} headings and explicit anchors are supported per document"
RETAINED = "A query can retain at most 65536 target anchors; narrow source selection"
BAD = "Invalid entry in the Relationships section"


def declarations(entries: DataFrame) -> DataFrame:
    """Entries of outlines (see structure.unfolded) as (their columns, kind, literal, target, reason, cause): cause is null for a well-formed declaration."""
    line = F.col("content")
    literal = "|".join(KINDS.values())
    keep = [c for c in entries.columns if c not in ("content", "head_bad", "again", "link")]
    parts = entries.withColumn("literal", F.regexp_extract(line, rf"^- ({literal}) ", 1)).withColumn("rest", F.regexp_extract(line, rf"^- (?:{literal}) (.*)$", 1))
    rest = F.col("rest")
    parts = parts.withColumn("label", F.regexp_extract(rest, r"^\[(.*?)\]\(", 1)).withColumn("after", F.regexp_extract(rest, r"^\[.*?\]\((.*)$", 1))
    parts = parts.withColumn("target", F.regexp_extract("after", r"^([^)]*)\)", 1)).withColumn("tail", F.regexp_extract("after", r"^[^)]*\)(.*)$", 1))
    parts = parts.withColumn("reason", F.regexp_extract("tail", r"^: (.*)$", 1))
    shape = (F.when(F.col("head_bad"), "expected exact '## Relationships' heading")
             .when(F.col("again"), "document has more than one H2 Relationships section")
             .when(~line.startswith("- "), "expected one unindented unordered bullet line")
             .when(F.col("literal") == "", "unknown or malformed relationship literal")
             .when(~rest.startswith("["), "expected a plain Markdown link after the literal")
             .when(~rest.contains("]("), "malformed Markdown link")
             .when((F.col("label") == "") | F.col("label").rlike(r"[\[\]]"), "link label must be non-empty plain text")
             .when(~F.col("after").contains(")"), "malformed Markdown link destination")
             .when(~F.col("tail").startswith(": "), "expected ': ' followed by a reason")
             .when(trimmed(F.col("reason")) == "", "relationship reason must be non-empty"))
    parsed = parts.withColumn("shape", shape)
    target = F.col("target")
    path, anchor = F.regexp_extract(target, r"^[^#]*", 0), F.regexp_extract(target, r"#(.*)$", 1)
    fine = ((path != "") | target.contains("#")) & (~target.contains("#") | ((anchor != "") & ~anchor.contains("#"))) & ~path.rlike(r"[?\\]") & ~path.startswith("/") & \
        ~target.rlike(r"\s") & ((path == "") | is_markdown(path)) & ~has_scheme(target)
    cause = F.coalesce("shape", F.when(F.col("link").isNull(), "entry must be one unordered list item with exactly one plain inline link")
                       .when(F.col("link") != target, "entry must contain only its one parsed link")
                       .when(~fine, "target must be a relative Markdown source with an optional non-empty fragment"))
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (v, k)]), F.when(F.col("literal") != "", F.col("literal")))
    return parsed.select(*keep, kind.alias("kind"), "literal", "target", "reason", cause.alias("cause"))


def target_path(source: Column, target: Column) -> Column:
    """The document path that a target's part before # names, seen from ``source``; null if it can't be one."""
    path = F.regexp_extract(target, r"^[^#]*", 0)
    decoded = percent_decoded(path)
    return F.when(path == "", source).when(~decoded.rlike(r"^/|\\"), normalized(F.concat(folder(source), decoded)))


def targets(outlines: DataFrame) -> DataFrame:
    """What edges need of the documents that they point at, from outlines that keep hash and historical: (to_path, to_version, to_historical, to_lines, clashing, to_over, marks)."""
    clash = F.array_min(F.transform(F.filter("marks", lambda m: m["clash"].isNotNull()), lambda m: F.struct(m["line_start"], m["anchor"], m["clash"])))
    return outlines.select(F.col("id").alias("to_path"), F.col("hash").alias("to_version"), F.col("historical").alias("to_historical"), F.col("lines").alias("to_lines"), clash.alias("clashing"), F.col("over").alias("to_over"), "marks")


def aimed(wanted: DataFrame) -> DataFrame:
    """Rows (id, target, ...) with to_path and to_anchor, the parts of their target."""
    target = F.col("target")
    return wanted.withColumn("to_path", target_path(F.col("id"), target)).withColumn("to_anchor", percent_decoded(F.when(target.contains("#"), F.regexp_extract(target, r"#(.*)$", 1))))


def resolved(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Aimed rows with to_id, to_first, to_last and error (code, message); equi-joins on the path, and on path and anchor."""
    target = F.col("target")
    path = F.regexp_extract(target, r"^[^#]*", 0)
    spans = known.select("to_path", F.explode("marks").alias("m")).where("m.clash is null").select(
        F.col("to_path").alias("s_path"), F.col("m.anchor").alias("s_anchor"), F.col("m.line_start").alias("a_first"), F.col("m.line_end").alias("a_last"))
    full = (rows.join(known.drop("marks").withColumn("to_id", F.col("to_path")), "to_path", "left")
            .join(spans, (F.col("to_id") == F.col("s_path")) & (F.col("to_anchor") == F.col("s_anchor")), "left"))
    says = lambda code, message: F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))
    asked = target.contains("#")
    error = (F.when(percent_decoded(path).isNull(), says("INVALID_RELATION", "Invalid target percent encoding"))
             .when(percent_decoded(path).rlike(r"^/|\\"), says("INVALID_RELATION", "Relations require a relative Markdown target"))
             .when(F.col("to_path").isNull(), says("INVALID_RELATION", "Relation target escapes the project"))
             .when(F.col("to_id").isNull(), says("INVALID_RELATION", "Relation target is not a selected Markdown source"))
             .when(asked & F.col("to_anchor").isNull(), says("INVALID_RELATION", "Invalid anchor encoding"))
             .when(asked & F.col("to_over"), says("ANCHOR_LIMIT", TOO_MANY))
             .when(asked & F.col("to_lines").isNull(), says("ANCHOR_LIMIT", RETAINED))
             .when(asked & F.col("clashing").isNotNull(), says("AMBIGUOUS_ANCHOR", "Document contains a duplicate anchor"))
             .when(asked & F.col("a_first").isNull(), says("INVALID_RELATION", "Relation anchor does not exist")))
    return full.select(*[c for c in rows.columns if c != "to_path"], "to_id", "to_version", "to_historical", F.when(asked, F.col("a_first")).otherwise(1).alias("to_first"),
                       F.when(asked, F.col("a_last")).otherwise(F.col("to_lines")).alias("to_last"), "clashing", error.alias("error"))


def edges(declared: DataFrame, known: DataFrame) -> DataFrame:
    """Resolved declarations, each with its first fault as fault (code, message, cause); a second declaration of the same edge is a fault."""
    rows = resolved(aimed(declared), known)
    same = Window.partitionBy("id", "literal", "to_id", "to_anchor", "reason").orderBy("line")
    again = (F.row_number().over(same) > 1) & F.col("cause").isNull() & F.col("error").isNull()
    fault = lambda code, message, cause: F.struct(code.alias("code"), message.alias("message"), cause.alias("cause"))
    none = F.lit(None).cast("string")
    return rows.withColumn("fault", F.when(F.col("cause").isNotNull(), fault(F.lit("INVALID_RELATION"), F.lit(BAD), F.col("cause")))
                           .when(F.col("error").isNotNull(), fault(F.col("error.code"), F.col("error.message"), none))
                           .when(again, fault(F.lit("INVALID_RELATION"), F.lit("Duplicate authored relationship declaration"), none)))


def around(rows: DataFrame, document: str, direction: str = "both") -> DataFrame:
    """Edges of one document with their navigation label; ``direction`` is outgoing, incoming or both."""
    d = F.lit(document)
    out, into = F.col("id") == d, F.col("to_id") == d
    keep = {"outgoing": out, "incoming": into, "both": out | into}[direction]
    return rows.where(keep).withColumn("navigation", nav_label(d, F.col("id"), F.col("to_id")))


def relations_of(documents: DataFrame, document: str, direction: str = "both") -> DataFrame:
    """The same from documents (id, text, hash, historical), without resolving any edge that doesn't touch the document.

    What points at it is told by the path alone, before anything is joined; then only its own outline is joined. What it points at is looked up in the outlines of
    just those documents.
    """
    own = F.col("id") == document
    declared = lambda rows: declarations(unfolded(outline(rows), "entries"))
    parts = []
    if direction != "outgoing":
        near = aimed(declared(documents)).where(F.col("to_path") == document)
        parts.append(edges(near.drop("to_path", "to_anchor"), targets(outline(documents.where(own), "hash", "historical"))))
    if direction != "incoming":
        mine = declared(documents.where(own))
        if direction == "both":  # its edges to itself are among those that point at it
            mine = mine.where(~F.coalesce(target_path(F.col("id"), F.col("target")) == document, F.lit(False)))
        there = F.broadcast(aimed(mine).select(F.col("to_path").alias("id")).distinct())  # of one document, DECLARATIONS at most
        parts.append(edges(mine, targets(outline(documents.join(there, "id", "left_semi"), "hash", "historical"))))
    return around(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), document, direction)
