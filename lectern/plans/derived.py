"""Markdown composed of the star schema, and queries on its structure. The oracles compute what must come out from the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import lines, metadata, relations, structure
from lectern.operators.identity import version
from lectern.sources import files


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region, nation and customer. Nations and customers point at what they lie in and at themselves; every seventh declares an edge to a document that doesn't exist."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    slug = lambda name: F.lower(F.translate(name, " #", "-"))
    region = read("region").select(F.format_string("docs/region-%d.md", "r_regionkey").alias("id"), F.format_string("# %s\n\nAbout.\n\n## The Nations of It\n\nText.\n", "r_name").alias("text"))
    regions, nations = (F.broadcast(read(n)) for n in ("region", "nation"))  # a row a country at most
    nation = read("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.lit("Region").alias("label"), F.format_string("region-%d.md", "n_regionkey").alias("up"), slug("r_name").alias("anchor"))
    customer = read("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.lit("Nation").alias("label"), F.format_string("nation-%d.md", "c_nationkey").alias("up"), slug("n_name").alias("anchor"))
    edge = F.format_string("- Depends on [%s](%s#%s): lies in it\n", "label", "up", "anchor")
    self_edge = F.lit("- Extends [Facts](#facts): of itself\n")
    lost = F.when(F.col("k") % 7 == 0, F.format_string("- Implements [Lost](lost-%d.md): not there\n", "k")).otherwise("")
    head = F.format_string("---\ntitle: %s\nstatus: %s\ncreated_at: 2024-02-%02d\ntags: [%s, %s]\n---\n", "name",
                           F.when(F.col("k") % 5 == 0, "unknown").otherwise("accepted"), F.col("k") % 25 + 8, "kind", F.when(F.col("k") % 4 == 0, "Nation").otherwise("place"))
    body = F.concat(F.format_string("# %s\n\n## Facts\n\n<a id=\"mark\"></a>\n\n### Size\n\nSee [up](%s).\n\n## Relationships\n\n", "name", "up"), edge, self_edge, lost)
    inner = nation.unionByName(customer).select(F.format_string("docs/%s-%d.md", "kind", "k").alias("id"), F.concat(head, body).alias("text"))
    return region.unionByName(inner).withColumn("hash", version(F.col("text"))).withColumn("historical", F.lit(False))


def headings_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.unfolded(structure.outline(corpus(spark, sf_dir)), "sections").select("id", "line_start", "line_end")


def anchors_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.unfolded(structure.outline(corpus(spark, sf_dir)), "marks").select("id", "anchor", "line_start", "line_end")


def passage_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    found = structure.with_context(lines.passages(docs, 4), structure.unfolded(structure.outline(docs), "sections"))
    return found.select("id", "first_line", "context_first", "context_last", "expand")


def _around(spark: SparkSession, sf_dir: str, document: str, direction: str) -> DataFrame:
    rows = relations.relations_of(corpus(spark, sf_dir), document, direction).where("fault is null")
    return rows.select("id", "line", "kind", "to_id", "to_anchor", "to_first", "to_last", "reason", "navigation")


def relations_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, "docs/nation-3.md", "outgoing")


def relations_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers of a nation, and its edge to itself."""
    return _around(spark, sf_dir, "docs/nation-6.md", "incoming")


def relations_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, "docs/nation-4.md", "both")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    declared = relations.declarations(structure.unfolded(structure.outline(docs), "entries"))
    return relations.edges(declared, relations.targets(structure.outline(docs, "hash", "historical")))


def relations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound edge, resolved."""
    return _edges(spark, sf_dir).where("fault is null").select("id", "line", "kind", "to_id", "to_anchor", "to_first", "to_last", "reason")


def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).where("fault is not null").select("id", "line", "target", F.col("fault.code").alias("code"), F.col("fault.message").alias("message"))


def metadata_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.findings(corpus(spark, sf_dir)).select("id", "line", "field", "message")


def check_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(metadata.is_documentation(F.col("id"))).alias("metadata_documents"),
                    F.count_if(~F.col("historical")).alias("reference_documents"))


def describe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, status and resolved links as a listing shows them."""
    return files.described(corpus(spark, sf_dir)).select("id", "title", "status", F.array_join("links", " ").alias("links"))


def markdown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.unfolded(structure.outline(corpus(spark, sf_dir)), "links").select("id", "line", "target")


def heading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.unfolded(structure.outline(corpus(spark, sf_dir)), "headings").select("id", "seq", "level", "line", "text")


def date_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar dates, some of which don't exist, from order keys."""
    day = F.format_string("%s-%02d-%02d", F.date_format("o_orderdate", "yyyy"), F.col("o_orderkey") % 14, F.col("o_orderkey") % 33)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", day.alias("value"))
    return rows.select("o_orderkey", "value", F.coalesce(X.real_date(F.col("value")), F.lit(False)).alias("real"))


def tag_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of parts: words of the type in lower case with the brand, which has an upper-case letter for every other part."""
    brand = F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand"))
    tags = F.array_append(F.split(F.lower("p_type"), " "), F.replace(brand, F.lit("#"), F.lit("-")))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.array_append(tags, F.element_at(tags, 1))).otherwise(tags).alias("tags"))
    return rows.select("p_partkey", F.array_join("tags", " ").alias("tags"), X.kebab_tags(F.col("tags")).alias("fine"))


QUERIES = {f.__name__: f for f in (headings_sections, anchors_slugs, passage_context, relations_outgoing, relations_incoming, relations_both, relations_all, dangling_refs,
                                   metadata_findings, check_counters, describe_documents, markdown_references, heading_rows, date_checks, tag_checks)}

_N = """n AS (SELECT *, 'docs/' || kind || '-' || k || '.md' AS id, CASE WHEN k % 7 = 0 THEN 21 ELSE 20 END AS n_lines FROM (
SELECT n_nationkey::BIGINT AS k, n_name AS name, 'nation' AS kind, 'region-' || n_regionkey || '.md' AS up, r_name AS rname, 1 AS up_first, 7 AS up_last FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT c_custkey, c_name, 'customer', 'nation-' || c_nationkey || '.md', n_name, 7, CASE WHEN c_nationkey % 7 = 0 THEN 21 ELSE 20 END FROM customer JOIN nation ON c_nationkey = n_nationkey)),
r AS (SELECT 'docs/region-' || r_regionkey || '.md' AS id, r_name AS name FROM region)"""
_SECTIONS = _N + """, s(id, line_start, line_end) AS (
SELECT id, x.a, CASE WHEN x.b = 0 THEN n_lines ELSE x.b END FROM n CROSS JOIN (VALUES (1, 6), (7, 0), (9, 16), (13, 16), (17, 0)) x(a, b)
UNION ALL SELECT id, x.a, 7 FROM r CROSS JOIN (VALUES (1), (5)) x(a))"""
_EDGES = _N + """, e AS (SELECT id, 19 AS line, 'depends-on' AS kind, 'docs/' || up AS to_id, lower(rname) AS to_anchor, up_first AS to_first, up_last AS to_last, 'lies in it' AS reason FROM n
UNION ALL SELECT id, 20, 'extends', id, 'facts', 9, 16, 'of itself' FROM n)"""
_OUT = "SELECT id, line::INTEGER AS line, kind, to_id, replace(to_anchor, ' ', '-') AS to_anchor, to_first::INTEGER AS to_first, to_last::INTEGER AS to_last, reason"
_SLUG = "replace(replace(lower(name), ' ', '-'), '#', '')"
_COUNT = "(SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM customer)"
ORACLE = {
    "headings_sections": f"WITH {_SECTIONS} SELECT id, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end FROM s",
    "anchors_slugs": f"""WITH {_N} SELECT id, x.anchor, x.a::INTEGER AS line_start, (CASE WHEN x.b = 0 THEN n_lines ELSE x.b END)::INTEGER AS line_end
        FROM n CROSS JOIN (VALUES ('facts', 9, 16), ('mark', 11, 16), ('size', 13, 16), ('relationships', 17, 0)) x(anchor, a, b)
        UNION ALL SELECT id, {_SLUG}, 7, n_lines FROM n
        UNION ALL SELECT id, {_SLUG}, 1, 7 FROM r UNION ALL SELECT id, 'the-nations-of-it', 5, 7 FROM r""",
    "passage_context": f"""WITH {_SECTIONS}, byte AS (SELECT s.*, coalesce(lead(line_start) OVER (PARTITION BY id ORDER BY line_start) - 1, 99) AS own_end FROM s),
        w AS (SELECT id, n_lines, f.v AS first_line FROM (SELECT id, n_lines FROM n UNION ALL SELECT id, 7 FROM r) d CROSS JOIN (VALUES (1), (5), (9), (13), (17), (21)) f(v) WHERE f.v <= n_lines)
        SELECT w.id, w.first_line::INTEGER AS first_line, min(b.line_start)::INTEGER AS context_first, max(b.line_end)::INTEGER AS context_last, true AS expand
        FROM w JOIN byte b ON b.id = w.id AND b.line_start <= least(w.first_line + 3, n_lines) AND b.own_end >= w.first_line GROUP BY w.id, w.first_line""",
    "relations_outgoing": f"WITH {_EDGES} {_OUT}, CASE WHEN to_id = id THEN 'self' ELSE 'outgoing' END AS navigation FROM e WHERE id = 'docs/nation-3.md'",
    "relations_incoming": f"WITH {_EDGES} {_OUT}, CASE WHEN to_id = id THEN 'self' ELSE 'incoming' END AS navigation FROM e WHERE to_id = 'docs/nation-6.md'",
    "relations_both": f"WITH {_EDGES} {_OUT}, CASE WHEN to_id = id THEN 'self' WHEN id = 'docs/nation-4.md' THEN 'outgoing' ELSE 'incoming' END AS navigation FROM e WHERE id = 'docs/nation-4.md' OR to_id = 'docs/nation-4.md'",
    "relations_all": f"WITH {_EDGES} {_OUT} FROM e",
    "dangling_refs": f"WITH {_N} SELECT id, 21 AS line, 'lost-' || k || '.md' AS target, 'INVALID_RELATION' AS code, 'Relation target is not a selected Markdown source' AS message FROM n WHERE k % 7 = 0",
    "metadata_findings": f"""WITH {_N} SELECT id, 3 AS line, 'status' AS field, 'Unknown documentary status' AS message FROM n WHERE k % 5 = 0
        UNION ALL SELECT id, 4, 'created_at', 'Date must be a real calendar date in YYYY-MM-DD format' FROM n WHERE k % 25 + 8 > 29
        UNION ALL SELECT id, 5, 'tags', 'Tags must be nonempty, distinct lowercase kebab-case text keywords' FROM n WHERE k % 4 = 0
        UNION ALL SELECT id, 1, NULL, 'Documentation under docs requires a closed outer YAML metadata header' FROM r""",
    "check_counters": f"SELECT {_COUNT} AS documents, {_COUNT} AS metadata_documents, {_COUNT} AS reference_documents",
    "describe_documents": f"""WITH {_N} SELECT id, name AS title, CASE WHEN k % 5 = 0 THEN 'unknown' ELSE 'accepted' END AS status,
        'docs/' || up || CASE WHEN k % 7 = 0 THEN ' docs/lost-' || k || '.md' ELSE '' END AS links FROM n UNION ALL SELECT id, name, NULL, '' FROM r""",
    "markdown_references": f"""WITH {_N} SELECT id, 15 AS line, up AS target FROM n UNION ALL SELECT id, 19, up || '#' || replace(lower(rname), ' ', '-') FROM n
        UNION ALL SELECT id, 20, '#facts' FROM n UNION ALL SELECT id, 21, 'lost-' || k || '.md' FROM n WHERE k % 7 = 0""",
    "heading_rows": f"""WITH {_N} SELECT id, x.seq::INTEGER AS seq, x.level::INTEGER AS level, x.line::INTEGER AS line, coalesce(nullif(x.t, ''), name) AS text
        FROM n CROSS JOIN (VALUES (0, 1, 7, ''), (1, 2, 9, 'Facts'), (2, 3, 13, 'Size'), (3, 2, 17, 'Relationships')) x(seq, level, line, t)
        UNION ALL SELECT id, x.seq::INTEGER, x.level::INTEGER, x.line::INTEGER, coalesce(nullif(x.t, ''), name) FROM r CROSS JOIN (VALUES (0, 1, 1, ''), (1, 2, 5, 'The Nations of It')) x(seq, level, line, t)""",
    "date_checks": """WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS value FROM orders)
        SELECT o_orderkey, value, try_cast(value AS DATE) IS NOT NULL AS real FROM d""",
    "tag_checks": """WITH t AS (SELECT p_partkey, list_append(string_split(lower(p_type), ' '), replace(CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END, '#', '-')) AS tags FROM part),
        u AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN list_append(tags, tags[1]) ELSE tags END AS tags FROM t),
        w AS (SELECT p_partkey, tags, unnest(tags) AS x FROM u)
        SELECT p_partkey, array_to_string(any_value(tags), ' ') AS tags, bool_and(x = lower(x) AND regexp_full_match(x, '[a-z0-9]+(-[a-z0-9]+)*')) AND count(DISTINCT x) = count(*) AS fine FROM w GROUP BY p_partkey""",
}
