"""Queries on documents with faults, on scopes, and on the small functions and reports. The oracles state what must come out of each kind of document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import checks, metadata, ranking, relations, reports, structure
from lectern.operators.identity import version
from lectern.plans import queries as prose
from lectern.sources import files

#: Kinds of documents, by the remainder of a supplier's key; %d stands for the key.
KINDS = (
    '# A\n\n## A\n\n## a-1\n\n<a id="a"></a>\n',
    "---\nstatus: draft\ntitle: T\n---\n# T\n",
    "# E\n\n## Relationships\n\n- Depends on [A](f-%d.md#e): one\n- Depends on [A](f-%d.md#e): one\n- Extends [B](../../x.md): out\n- Implements [C](c.txt): bad\n- Nothing [D](f-%d.md): bad\n- Supersedes [E](f-%d.md) no\n",
    '<script>\n<a id="no"></a>\n</script>\n\n<!--\n<a id="no2"></a>\n-->\n\n<a id="yes"></a>\n\nText [x](f-%d.md#yes) [y](f-%d.md#no) [z](//h/a.md) [w](http://h/a.md) [t](a.txt)\n',
    '---\ntitle: 0x10\nstatus: !!str draft\ncreated_at: "2024-01-05"\ntags: [a, b]\n---\n# Four\n',
    "# T\n\n## Relationships\n\n## Relationships\n",
)


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each supplier, of one of the kinds; those of the last kind are historical, those of the fourth not under docs."""
    k = F.col("s_suppkey")
    text = F.get(F.array(*map(F.lit, KINDS)), F.pmod(k, F.lit(len(KINDS))).cast("int"))
    folder = F.when(F.pmod(k, F.lit(len(KINDS))) == 3, "notes").otherwise("docs")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.format_string("%s/f-%d.md", folder, k).alias("id"), F.replace(text, F.lit("%d"), k.cast("string")).alias("text"),
                                                                   (F.pmod(k, F.lit(len(KINDS))) == 5).alias("historical"))
    return rows.withColumn("hash", version(F.col("text")))


def _outlines(docs: DataFrame) -> DataFrame:
    return structure.outline(docs, "hash", "historical")


def _edges(docs: DataFrame, known: DataFrame) -> DataFrame:
    return relations.edges(relations.declarations(structure.unfolded(structure.outline(docs), "entries")), known)


def fault_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs that collide, anchors of one name, anchors inside raw text and comments."""
    return structure.unfolded(structure.outline(faulty(spark, sf_dir)), "marks")


def fault_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = faulty(spark, sf_dir)
    return _edges(docs, relations.targets(_outlines(docs))).select("id", "line", F.col("fault.code").alias("code"), F.col("fault.message").alias("message"), F.col("fault.cause").alias("cause"))


def fault_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.findings(faulty(spark, sf_dir)).select("id", "ord", "line", "field", "message")


def fault_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.described(faulty(spark, sf_dir)).select("id", "title", "status")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = faulty(spark, sf_dir)
    known = relations.targets(_outlines(docs))
    scope = checks.checked(docs)
    bodies = checks.bodies(scope)
    near = _outlines(bodies)
    return checks.findings(scope, near, _edges(bodies, known), checks.references(near, known))


def fault_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three phases of a check, in the order of a report."""
    found = _findings(spark, sf_dir)
    order = Window.partitionBy("id").orderBy("phase", "ord")
    of = lambda path: F.get_json_object("finding", path)
    return found.select("id", F.row_number().over(order).alias("place"), "phase", of("$.code").alias("code"), of("$.message").alias("message"), F.coalesce(of("$.line"), of("$.details.line")).cast("int").alias("line"))


def check_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check counts: findings, documents, bodies and the status that follows."""
    docs = faulty(spark, sf_dir)
    scope = checks.checked(docs)
    counts = scope.agg(F.count(F.lit(1)).alias("documents"), F.count_if(metadata.is_documentation(F.col("id"))).alias("headers"), F.count_if(~F.col("historical")).alias("bodies"))
    return _findings(spark, sf_dir).agg(F.count(F.lit(1)).alias("findings")).crossJoin(F.broadcast(counts)).select(  # one row with one row
        "findings", "documents", "headers", "bodies", reports.check_status(F.col("findings"), F.lit(False)).alias("status"), reports.check_status(F.lit(0), F.col("findings") > 0).alias("passed_over"))


def declaring_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents' declarations count, by direction, for a document that is historical."""
    docs = faulty(spark, sf_dir)
    return docs.sparkSession.createDataFrame([], "direction string, documents long").unionByName(
        checks.declaring(docs, "docs/f-5.md", "outgoing").agg(F.lit("outgoing").alias("direction"), F.count(F.lit(1)).alias("documents"))).unionByName(
        checks.declaring(docs, "docs/f-5.md", "incoming").agg(F.lit("incoming").alias("direction"), F.count(F.lit(1)).alias("documents")))


def sources_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of all parts' keys that has no document of that name."""
    asked = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.format_string("docs/f-%d.md", "p_partkey").alias("id"))
    return checks.first_missing(asked, faulty(spark, sf_dir))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.format_string("docs/%08d.md", "doc_id").alias("id"), "text", (F.pmod("doc_id", F.lit(3)) == 0).alias("historical"), version(F.col("text")).alias("hash"))


def search_scope_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and hits of documents that aren't historical only."""
    found = ranking.hits(prose.lines.passages(checks.searched(_dated(spark, sf_dir))), prose.QUERY)
    return found.select("id", "first_line", F.round("score", 6).alias("score"))


def search_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents asked for, one of them historical."""
    found = ranking.hits(prose.lines.passages(checks.searched(_dated(spark, sf_dir), ["docs/00000003.md", "docs/00000004.md"])), prose.QUERY)
    return found.select("id", "first_line", F.round("score", 6).alias("score"))


def search_without_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of punctuation has no terms and finds nothing."""
    return ranking.hits(prose.lines.passages(_dated(spark, sf_dir)), "!? -- _").agg(F.count(F.lit(1)).alias("hits"))


def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of five matches with their texts."""
    docs = _dated(spark, sf_dir)
    page = ranking.top(ranking.hits(prose.lines.passages(docs), prose.QUERY).withColumns({"range_first": F.col("first_line"), "range_last": F.col("last_line")}), 5, 5)
    return ranking.with_text(page, docs).select("id", "range_first", "range_last", F.col("_text").alias("text"))


def listing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in mixed case and with accents: collation and code units differ."""
    name = F.replace("n_name", F.lit(" "), F.lit(""))
    k = F.col("n_nationkey")
    path = F.when(k % 3 == 0, F.lower(name)).when(k % 3 == 1, F.initcap(name)).otherwise(F.translate(F.lower(name), "aeiou", "áéíóú"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(path, F.lit(".md")).alias("path"))
    at = lambda key: F.row_number().over(Window.orderBy(key))
    return rows.select("path", at(F.collate("path", "UNICODE")).alias("listed"), at(X.code_units(F.col("path"))).alias("by_units"))


RULES = files.Selection(["**/*.md", "vendor/**"], ["**/draft-*.md", "tmp/**"], ["old/**", "**/[0-9][0-9][0-9]1.md"])


def selected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of order keys, as selection rules classify them."""
    k = F.col("o_orderkey")
    folder = F.get(F.array(*map(F.lit, ("", "old/", "tmp/x/", "docs/a/", "vendor/v/", "docs/draft-"))), F.pmod(k, F.lit(6)).cast("int"))
    path = F.concat(folder, F.lpad(F.pmod(k, F.lit(10_000)).cast("string"), 4, "0"), F.when(k % 11 == 0, ".txt").otherwise(".md"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", path.alias("path"))
    return rows.select("o_orderkey", "path", files.classified(F.col("path"), RULES).alias("historical"))


def script_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space as a browser trims it, and as the property has it: they differ in U+0085 and the byte order mark."""
    padded = F.concat(F.lit("\u0085﻿  "), F.col("n_name"), F.lit("\t ﻿\u0085"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", padded.alias("t"))
    return rows.select("n_nationkey", F.length(X.script_trimmed(F.col("t"))).alias("script"), F.length(X.trimmed(F.col("t"))).alias("property"))


def newest_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest release of each part's brand, among tags made of part keys."""
    k = F.col("p_partkey")
    tag = F.when(k % 9 == 0, F.concat(F.lit("v"), k.cast("string"), F.lit(".x.1"))).when(k % 10 == 0, F.concat(k.cast("string"), F.lit(".0.0"))).otherwise(
        F.concat(F.lit("v"), (k % 13).cast("string"), F.lit("."), (k % 17).cast("string"), F.lit("."), k.cast("string")))
    return reports.newest_release(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("brand"), tag.alias("tag")), "brand")


def civil_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days before and after the epoch as dates."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", X.civil_date(F.col("o_orderkey") * 3 - 20_000).alias("date"))


def documents_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.by_state(fault_titles(spark, sf_dir))
    return found.select("status", "documents", F.array_join("ids", " ").alias("ids"))


def help_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.commands(spark)


QUERIES = {f.__name__: f for f in (fault_marks, fault_edges, fault_headers, fault_titles, fault_findings, check_status, declaring_scope, sources_missing, search_scope_current, search_asked, search_without_terms,
                                   search_matches, listing_order, selected_paths, script_trims, newest_releases, civil_dates, documents_by_state, help_table)}

_F = "f AS (SELECT CASE WHEN s_suppkey % 6 = 3 THEN 'notes' ELSE 'docs' END || '/f-' || s_suppkey || '.md' AS id, s_suppkey AS k, s_suppkey % 6 AS v FROM supplier)"
_NO_HEADER = "Documentation under docs requires a closed outer YAML metadata header"
_MISSING = "Required metadata field is missing"
_HEADERS = f"""h(v, ord, line, field, message) AS (VALUES (0, -2, 1, NULL, '{_NO_HEADER}'), (2, -2, 1, NULL, '{_NO_HEADER}'), (5, -2, 1, NULL, '{_NO_HEADER}'),
    (1, 2, 3, 'title', 'Metadata fields must follow the standard field order'), (1, 1002, 2, 'created_at', '{_MISSING}'), (1, 1003, 2, 'tags', '{_MISSING}'), (4, 1, 2, 'title', 'Metadata field must be text'))"""
_EDGES = f"""e(v, line, code, message, cause) AS (VALUES (2, 5, NULL, NULL, NULL), (2, 6, 'INVALID_RELATION', 'Duplicate authored relationship declaration', NULL),
    (2, 7, 'INVALID_RELATION', 'Relation target escapes the project', NULL), (2, 8, 'INVALID_RELATION', '{relations.BAD}', 'target must be a relative Markdown source with an optional non-empty fragment'),
    (2, 9, 'INVALID_RELATION', '{relations.BAD}', 'unknown or malformed relationship literal'), (2, 10, 'INVALID_RELATION', '{relations.BAD}', 'expected '': '' followed by a reason'),
    (5, 5, 'INVALID_RELATION', '{relations.BAD}', 'document has more than one H2 Relationships section'))"""
_FOUND = f"""WITH {_F}, {_HEADERS}, c AS (SELECT id, 0 AS phase, ord, 'INVALID_METADATA' AS code, message, line FROM f JOIN h USING (v)
    UNION ALL SELECT id, 1, 0, 'INVALID_RELATION', 'Duplicate authored relationship declaration', 6 FROM f WHERE v = 2
    UNION ALL SELECT id, 2, 2, 'INVALID_REFERENCE', 'Relation target escapes the project', 7 FROM f WHERE v = 2
    UNION ALL SELECT id, 2, 1, 'INVALID_REFERENCE', 'Relation anchor does not exist', 11 FROM f WHERE v = 3)"""
_SCORED = prose._scores  # noqa: SLF001
ORACLE = {
    "fault_marks": f"""WITH {_F}, m(v, anchor, line_start, line_end, clash) AS (VALUES (0, 'a', 1, 7, NULL), (0, 'a-1', 3, 4, NULL), (0, 'a-1-1', 5, 7, NULL), (0, 'a', 7, 7, 1), (1, 't', 5, 5, NULL),
        (2, 'e', 1, 10, NULL), (2, 'relationships', 3, 10, NULL), (3, 'yes', 9, 11, NULL), (4, 'four', 7, 7, NULL), (5, 't', 1, 5, NULL), (5, 'relationships', 3, 4, NULL), (5, 'relationships-1', 5, 5, NULL))
        SELECT id, anchor, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end, clash::INTEGER AS clash FROM f JOIN m USING (v)""",
    "fault_edges": f"WITH {_F}, {_EDGES} SELECT id, line::INTEGER AS line, code, message, cause FROM f JOIN e USING (v)",
    "fault_headers": f"WITH {_F}, {_HEADERS} SELECT id, ord::INTEGER AS ord, line::INTEGER AS line, field, message FROM f JOIN h USING (v)",
    "fault_titles": f"""WITH {_F}, t(v, title, status) AS (VALUES (0, 'A', NULL), (1, 'T', 'draft'), (2, 'E', NULL), (3, NULL, NULL), (4, 'Four', 'draft'), (5, 'T', NULL))
        SELECT id, coalesce(title, 'f-' || k || '.md') AS title, status FROM f JOIN t USING (v)""",
    "fault_findings": f"{_FOUND} SELECT id, row_number() OVER (PARTITION BY id ORDER BY phase, ord)::INTEGER AS place, phase::INTEGER AS phase, code, message, line::INTEGER AS line FROM c",
    "check_status": f"{_FOUND} SELECT (SELECT count(*) FROM c) AS findings, (SELECT count(*) FROM f) AS documents, (SELECT count(*) FROM f WHERE v <> 3) AS headers, (SELECT count(*) FROM f WHERE v <> 5) AS bodies, 'failed' AS status, 'partial' AS passed_over",
    "declaring_scope": f"WITH {_F} SELECT 'outgoing' AS direction, count(*) AS documents FROM f WHERE k = 5 UNION ALL SELECT 'incoming', count(*) FROM f WHERE k = 5 OR v <> 5",
    "sources_missing": f"WITH {_F} SELECT min('docs/f-' || p_partkey || '.md') AS missing FROM part WHERE 'docs/f-' || p_partkey || '.md' NOT IN (SELECT id FROM f)",
    "search_scope_current": f"WITH {_SCORED('WHERE substr(id, 6, 8)::INTEGER % 3 <> 0')} SELECT id, first_line, round(score, 6) AS score FROM h",
    "search_asked": "WITH " + _SCORED("WHERE id IN ('docs/00000003.md', 'docs/00000004.md')") + " SELECT id, first_line, round(score, 6) AS score FROM h",
    "search_without_terms": "SELECT 0::BIGINT AS hits",
    "search_matches": f"""WITH {_SCORED('')}, b AS (SELECT id, first_line, last_line FROM h ORDER BY round(score, 12), id, first_line LIMIT 5 OFFSET 5)
        SELECT b.id, b.first_line AS range_first, b.last_line AS range_last, CASE WHEN b.last_line = len(a.l) THEN p.content ELSE regexp_replace(p.content, '(\r\n|\r|\n)$', '') END AS text
        FROM b JOIN p ON p.id = b.id AND p.first_line = b.first_line JOIN a ON a.id = b.id""",
    "listing_order": """WITH p AS (SELECT replace(n_name, ' ', '') AS n, n_nationkey AS k FROM nation), q AS (SELECT n, CASE k % 3 WHEN 0 THEN lower(n) WHEN 1 THEN upper(n[1]) || lower(n[2:]) ELSE translate(lower(n), 'aeiou', 'áéíóú') END || '.md' AS path FROM p)
        SELECT path, row_number() OVER (ORDER BY lower(n))::INTEGER AS listed, row_number() OVER (ORDER BY path)::INTEGER AS by_units FROM q""",
    "selected_paths": """WITH p AS (SELECT o_orderkey, ['', 'old/', 'tmp/x/', 'docs/a/', 'vendor/v/', 'docs/draft-'][o_orderkey % 6 + 1] || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || CASE WHEN o_orderkey % 11 = 0 THEN '.txt' ELSE '.md' END AS path FROM orders)
        SELECT o_orderkey, path, CASE WHEN path LIKE '%.txt' OR path LIKE 'tmp/%' OR path LIKE '%/draft-%' THEN NULL ELSE path LIKE 'old/%' OR regexp_matches(path, '(^|/)[0-9]{3}1[.]md$') END AS historical FROM p""",
    "script_trims": "SELECT n_nationkey, (length(n_name) + 8)::INTEGER AS script, (length(n_name) + 6)::INTEGER AS property FROM nation",
    "newest_releases": """WITH t AS (SELECT p_brand AS brand, p_partkey AS k FROM part), r AS (SELECT *, k % 13 AS a, k % 17 AS b FROM t WHERE k % 9 <> 0 AND k % 10 <> 0)
        SELECT brand, arg_max(a || '.' || b || '.' || k, a * 1000000000000 + b * 10000000000 + k) AS newest FROM r GROUP BY brand""",
    "civil_dates": "SELECT o_orderkey, strftime(DATE '1970-01-01' + (o_orderkey * 3 - 20000)::INTEGER, '%Y-%m-%d') AS date FROM orders",
    "documents_by_state": f"""WITH {_F}, t(v, status) AS (VALUES (0, NULL), (1, 'draft'), (2, NULL), (3, NULL), (4, 'draft'), (5, NULL))
        SELECT status, count(*) AS documents, string_agg(id, ' ' ORDER BY id) AS ids FROM f JOIN t USING (v) GROUP BY status""",
    "help_table": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in reports.COMMANDS.items()) + ") t(command, summary)",
}
