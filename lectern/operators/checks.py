"""Scopes of commands, and the findings of a check as rows: headers, declared edges, local references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import has_scheme, is_markdown, percent_decoded
from lectern.operators import metadata, relations
from lectern.operators.structure import unfolded

#: Faults that lie in the document an edge points at, not in the one that declares it.
AT_TARGET = ("Invalid anchor encoding", "Document contains a duplicate anchor", "Relation anchor does not exist")


def searched(documents: DataFrame, asked: list[str] = (), historical: bool = False) -> DataFrame:
    """What a search covers: the documents asked for, or all, or those that aren't historical."""
    return documents.where(F.col("id").isin(asked)) if asked else documents if historical else documents.where("not historical")


def declaring(documents: DataFrame, document: str, direction: str) -> DataFrame:
    """Documents whose declarations count for relations of one: itself, and for incoming ones all that aren't historical."""
    own = F.col("id") == document
    return documents.where(own if direction == "outgoing" else own | ~F.col("historical"))


def checked(documents: DataFrame, asked: list[str] = (), historical: bool = False) -> DataFrame:
    """Documents that a check covers; without ``asked`` or ``historical``, historical ones only under docs."""
    return documents.where(F.col("id").isin(asked)) if asked else documents.where(F.lit(historical) | ~F.col("historical") | metadata.is_documentation(F.col("id")))


def bodies(scope: DataFrame, asked: list[str] = (), historical: bool = False) -> DataFrame:
    """Of these, the documents whose bodies are checked too."""
    return scope.where(F.lit(historical or bool(asked)) | ~F.col("historical"))


def first_missing(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: the first id, in the order of its bytes, that is asked for and not selected; null if there is none."""
    return asked.join(documents.select("id"), "id", "left_anti").agg(F.min("id").alias("missing"))


def is_local(raw: Column) -> Column:
    """Whether a link's destination may name a Markdown document or a place in one."""
    path = F.regexp_extract(raw, r"^[^#?]*", 0)
    return (raw != "") & ~raw.startswith("//") & ~has_scheme(raw) & ((path == "") | is_markdown(F.coalesce(percent_decoded(path), path)))


def local_links(outlines: DataFrame) -> DataFrame:
    """(id, hash, seq, line, raw, target): links to Markdown documents or places in them, without the query part; outlines keep the hash."""
    before = F.regexp_extract("raw", r"^[^#]*", 0)
    links = unfolded(outlines, "links", "hash").withColumnRenamed("target", "raw").where(is_local(F.col("raw")))
    return links.withColumn("target", F.concat(F.regexp_extract(before, r"^[^?]*", 0), F.regexp_extract("raw", r"#.*$", 0)))


def references(outlines: DataFrame, known: DataFrame) -> DataFrame:
    """The same links with what they resolve to, and error."""
    return relations.resolved(relations.aimed(local_links(outlines)), known)


def _json(*columns) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("finding")


def header_findings(scope: DataFrame) -> DataFrame:
    return metadata.findings(scope).select("id", F.lit(0).alias("phase"), "ord", _json(F.lit("INVALID_METADATA").alias("code"), "line", "column", "field", "message"))


def edge_findings(edges: DataFrame) -> DataFrame:
    """The first faulty declaration of each document."""
    first = Window.partitionBy("id").orderBy("line")
    bad = edges.where("fault is not null").withColumn("r", F.row_number().over(first)).where("r = 1")
    return bad.select("id", F.lit(1).alias("phase"), F.lit(0).alias("ord"), _json(
        F.col("fault.code").alias("code"), F.col("fault.message").alias("message"), F.struct("line", F.col("fault.cause").alias("cause")).alias("details")))


def limit_findings(outlines: DataFrame) -> DataFrame:
    """Documents with more anchors than are supported, whose declarations can't be read."""
    return outlines.where("over").select("id", F.lit(1).alias("phase"), F.lit(0).alias("ord"), _json(
        F.lit("ANCHOR_LIMIT").alias("code"), F.lit(relations.TOO_MANY).alias("message"), F.lit(None).cast("string").alias("details")))


def retained(refs: DataFrame, known: DataFrame, order: DataFrame, most: int) -> DataFrame:
    """``known`` without the lines of documents whose anchors no longer fit into what one check retains: those referred to by anchor are counted in the order in
    which they are first met, and one that doesn't fit is passed over. The driver holds a number for each such document."""
    place = F.struct("ord", "line", "seq")
    met = relations.aimed(refs).where("to_anchor is not null").join(order.select("id", "ord"), "id").groupBy("to_path").agg(F.min(place).alias("first"))
    sizes = met.join(known.where("not to_over").select("to_path", F.size("marks").alias("n")), "to_path").orderBy("first").select("to_path", "n").collect()
    left, refused = most, []
    for path, n in sizes:
        if n > left:
            refused.append(path)
        else:
            left -= n
    return known.withColumn("to_lines", F.when(~F.col("to_path").isin(refused), F.col("to_lines"))) if refused else known


def reference_findings(refs: DataFrame) -> DataFrame:
    code = F.when(F.col("error.code") == "INVALID_RELATION", "INVALID_REFERENCE").otherwise(F.col("error.code"))
    there = F.col("error.message").isin(*AT_TARGET)
    clash = F.struct(F.col("clashing.anchor").alias("anchor"), F.lit("the same anchor ID names more than one target section").alias("cause"), F.col("clashing.clash").alias("firstLine"),
                     F.col("clashing.line_start").alias("line"))
    place = F.struct(F.when(there, F.col("to_id")).otherwise(F.col("id")).alias("document"), F.when(there, 1).otherwise(F.col("line")).alias("line"),
                     F.when(there, F.col("to_version")).otherwise(F.col("hash")).alias("version"))
    details = F.when(F.col("error.code") == "AMBIGUOUS_ANCHOR", F.to_json(clash)).otherwise(F.to_json(place))
    return refs.where("error is not null").select("id", F.lit(2).alias("phase"), F.col("seq").alias("ord"), _json(
        "line", F.col("raw").alias("target"), code.alias("code"), F.col("error.message").alias("message"), F.parse_json(details).alias("details")))


def findings(scope: DataFrame, outlines: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, phase, ord, finding as JSON), to be shown by document, phase and ord; outlines are those of the bodies."""
    return header_findings(scope).unionByName(edge_findings(edges)).unionByName(limit_findings(outlines)).unionByName(reference_findings(refs))
