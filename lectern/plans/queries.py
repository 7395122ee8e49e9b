"""Registered queries for the document engine's own operators, each with DuckDB's answer where SQL can give it.

The driver's documents are plain prose, so queries on structure use Markdown that is composed of the star schema's rows, and the
oracle computes what must come out from these rows, not from the Markdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import identity, lines, paging, ranking

QUERY = "the theandsh création und que"
TERMS = ["the", "theandsh", "creation", "und", "que"]
WINDOW, CONTEXT_BYTES = lines.WINDOW_LINES, 8_192


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose table under the engine's column names."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.format_string("docs/%08d.md", "doc_id").alias("id"), "text", "source", "lang")


_DOCS = "d AS (SELECT 'docs/' || lpad(doc_id::VARCHAR, 8, '0') || '.md' AS id, text, source, lang, octet_length(encode(text)) AS n_bytes FROM documents)"
_ARRAYS = _DOCS + r""", a AS (SELECT id, source, n_bytes, CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+') END AS l FROM d)"""
_LINES = _ARRAYS + """, e AS (SELECT id, source, n_bytes, generate_subscripts(l, 1) AS line, unnest(l) AS raw FROM a)"""
_PASSAGES = _LINES + """, p AS (SELECT id, source, n_bytes, min(line)::INTEGER AS first_line, max(line)::INTEGER AS last_line, string_agg(raw, '' ORDER BY line) AS content
  FROM e GROUP BY id, source, n_bytes, (line - 1) // 32 HAVING trim(string_agg(raw, '' ORDER BY line), ' ' || chr(9) || chr(10) || chr(13)) <> '')"""
_TOKENS = _PASSAGES + r""", t AS (SELECT id, source, n_bytes, first_line, last_line, regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+') AS t FROM p)"""


def _scores(scope: str) -> str:
    """SQL for h(id, first_line, last_line, n_bytes, score) over the passages in scope."""
    return _TOKENS + f""", s AS (SELECT * FROM t {scope}), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS al FROM s),
u AS (SELECT id, first_line, last_line, n_bytes, len(t) AS dl, unnest(t) AS term FROM s),
f AS (SELECT id, first_line, last_line, n_bytes, dl, term, count(*)::DOUBLE AS tf FROM u WHERE term IN ({", ".join(repr(t) for t in TERMS)}) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM f GROUP BY term),
h AS (SELECT id, first_line, last_line, n_bytes, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score
  FROM f JOIN df USING (term) CROSS JOIN st GROUP BY id, first_line, last_line, n_bytes)"""


def sources_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.col("id").alias("path"), identity.version(F.col("text")).alias("hash"), F.lit(False).alias("historical"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines(documents(spark, sf_dir)).select("id", "line", "content", "byte_start", "byte_end")


def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.read_range(documents(spark, sf_dir), 2, 4)


def passages_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.passages(documents(spark, sf_dir)).select("id", "first_line", "last_line", "first_byte", "last_byte", "content")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.postings(lines.passages(documents(spark, sf_dir)), "id", "first_line")


def df_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.document_frequencies(lines.passages(documents(spark, sf_dir)))


def _hits(docs: DataFrame) -> DataFrame:
    """Hits with context: prose without headings is one section, its whole text."""
    sized = docs.select("id", F.size(X.raw_lines(F.col("text"))).alias("context_last"), (F.octet_length("text") <= CONTEXT_BYTES).alias("expand"))
    return ranking.hits(lines.passages(docs), QUERY).join(sized, "id").withColumn("context_first", F.lit(1))


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: six best passages of the whole table."""
    best = ranking.top(ranking.hits(lines.passages(documents(spark, sf_dir)), QUERY), 6)
    return best.select("id", "first_line", "last_line", F.round("score", 6).alias("score"))


def search_scope_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics follow the scope: one source's passages only."""
    found = ranking.hits(lines.passages(documents(spark, sf_dir).where("source = 'src1'")), QUERY)
    return found.select("id", "first_line", "last_line", F.round("score", 6).alias("score"))


def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.distinct_ranges(_hits(documents(spark, sf_dir))).agg(F.count(F.lit(1)).alias("total_matches"))


def search_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.distinct_ranges(_hits(documents(spark, sf_dir)))
    return found.select("id", "range_first", "range_last", F.round("score", 6).alias("score"))


def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", identity.version(F.col("text")).alias("hash"))
    return identity.snapshot(docs, "{}")


def links_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where links of several shapes, made from nation names, lead from two folders."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lower("n_name").alias("n"))
    shapes = {"plain": "{}.md", "up": "../x/{}.md#top", "dots": "./a/../{}.MD?raw", "escape": "../../../{}.md", "web": "https://e.org/{}.md",
              "escaped": "a%2B/{}%2emd", "other": "{}.txt", "bad": "%zz/{}.md"}
    cases = F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), F.replace(F.lit(v), F.lit("{}"), F.col("n")).alias("target")) for k, v in shapes.items()]))
    rows = nations.select("n", cases.alias("c")).select(F.concat(F.lit("docs/"), "n", F.lit("/index.md")).alias("source"), "c.shape", "c.target")
    return rows.select("source", "shape", "target", X.local_link(F.col("source"), F.col("target")).alias("resolved"))


def page_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 4 096 bytes of the source listing's first 64 records."""
    first = documents(spark, sf_dir).orderBy("id").limit(64).select("id", "source", F.sha2("text", 256).alias("hash"))
    return paging.fitting(first, [F.col("id")], F.to_json(F.struct("hash", "id", "source")), 200, 4_096).select("id", "used_bytes")


def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of lower-case paths under the collation of listings, and by code units."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit(""))), F.lit(".md")).alias("path"))
    at = lambda key: F.row_number().over(paging.Window.orderBy(key))
    return rows.select("path", at(F.collate("path", "UNICODE")).alias("listed"), at(X.code_units(F.col("path"))).alias("by_units"))


QUERIES = {f.__name__: f for f in (sources_listing, doc_lines, read_range, passages_32, tokens, df_stats, bm25_top, search_scope_source, search_total,
                                   search_dedupe, snapshot_hash, links_resolve, page_fill, path_order)}

_RANGES = _scores("") + """, x AS (SELECT h.*, CASE WHEN h.n_bytes <= 8192 THEN 1 ELSE first_line END AS range_first, CASE WHEN h.n_bytes <= 8192 THEN len(a.l) ELSE last_line END AS range_last FROM h JOIN a ON a.id = h.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id, range_first, range_last ORDER BY score, first_line) AS rn FROM x)"""
ORACLE: dict[str, str] = {
    "sources_listing": f"WITH {_DOCS} SELECT id, id AS path, sha256(text) AS hash, false AS historical FROM d",
    "doc_lines": f"""WITH {_LINES}, b AS (SELECT id, line, raw, octet_length(encode(raw)) AS n FROM e)
        SELECT id, line::INTEGER AS line, rtrim(raw, chr(13) || chr(10)) AS content,
        (sum(n) OVER (PARTITION BY id ORDER BY line) - n)::BIGINT AS byte_start, (sum(n) OVER (PARTITION BY id ORDER BY line))::BIGINT AS byte_end FROM b""",
    "read_range": f"""WITH {_ARRAYS} SELECT e.id, max(e.line)::INTEGER AS line_end,
        CASE WHEN max(e.line) = max(len(e.l)) THEN string_agg(e.raw, '' ORDER BY e.line) ELSE regexp_replace(string_agg(e.raw, '' ORDER BY e.line), '\n$', '') END AS text
        FROM (SELECT id, l, generate_subscripts(l, 1) AS line, unnest(l) AS raw FROM a) e WHERE e.line BETWEEN 2 AND 4 GROUP BY e.id""",
    "passages_32": f"""WITH {_PASSAGES}, z AS (SELECT e.id, e.line, octet_length(encode(e.raw)) AS n FROM e),
        c AS (SELECT id, line, (sum(n) OVER (PARTITION BY id ORDER BY line))::BIGINT AS stop, n FROM z)
        SELECT p.id, p.first_line, p.last_line, (s.stop - s.n)::BIGINT AS first_byte, f.stop AS last_byte, p.content FROM p JOIN c s ON s.id = p.id AND s.line = p.first_line JOIN c f ON f.id = p.id AND f.line = p.last_line""",
    "tokens": f"WITH {_TOKENS}, u AS (SELECT id, first_line, len(t)::INTEGER AS n_tokens, unnest(t) AS term FROM t) SELECT id, first_line, term, count(*)::INTEGER AS tf, n_tokens FROM u GROUP BY id, first_line, term, n_tokens",
    "df_stats": f"WITH {_TOKENS}, u AS (SELECT unnest(list_distinct(t)) AS term FROM t) SELECT term, count(*) AS df FROM u GROUP BY term",
    "bm25_top": f"WITH {_scores('')} SELECT id, first_line, last_line, round(score, 6) AS score FROM h ORDER BY round(score, 12), id, first_line LIMIT 6",
    "search_scope_source": f"WITH {_scores(chr(32).join(['WHERE source =', repr('src1')]))} SELECT id, first_line, last_line, round(score, 6) AS score FROM h",
    "search_total": f"WITH {_RANGES} SELECT count(*) AS total_matches FROM r WHERE rn = 1",
    "search_dedupe": f"WITH {_RANGES} SELECT id, range_first::INTEGER AS range_first, range_last::INTEGER AS range_last, round(score, 6) AS score FROM r WHERE rn = 1",
    "snapshot_hash": f"WITH {_DOCS} SELECT sha256(string_agg(id || chr(0) || sha256(text), chr(10) ORDER BY id) || chr(10) || 'selection' || chr(0) || '{{}}') AS snapshot FROM d",
    "links_resolve": """WITH n AS (SELECT lower(n_name) AS n FROM nation), s(shape, a, b, ra, rb) AS (VALUES ('plain', '', '.md', 'docs/', '.md'), ('up', '../x/', '.md#top', 'up', '.md'), ('dots', './a/../', '.MD?raw', 'docs/', '.MD'),
        ('escape', '../../../', '.md', NULL, ''), ('web', 'https://e.org/', '.md', NULL, ''), ('escaped', 'a%2B/', '%2emd', 'docs/', '.md'), ('other', '', '.txt', NULL, ''), ('bad', '%zz/', '.md', NULL, ''))
        SELECT 'docs/' || n || '/index.md' AS source, shape, a || n || b AS target,
        CASE shape WHEN 'plain' THEN 'docs/' || n || '/' || n || '.md' WHEN 'up' THEN 'docs/x/' || n || '.md' WHEN 'dots' THEN 'docs/' || n || '/' || n || '.MD' WHEN 'escaped' THEN 'docs/' || n || '/a+/' || n || '.md' END AS resolved FROM n CROSS JOIN s""",
    "page_fill": f"""WITH {_DOCS}, f AS (SELECT id, source, sha256(text) AS hash FROM d ORDER BY id LIMIT 64),
        u AS (SELECT id, (sum(len('{{"hash":"' || hash || '","id":"' || id || '","source":"' || source || '"}}') + 1) OVER (ORDER BY id) - 1 + 200)::BIGINT AS used_bytes FROM f) SELECT id, used_bytes FROM u WHERE used_bytes <= 4096""",
    "path_order": """WITH p AS (SELECT replace(lower(n_name), ' ', '') || '.md' AS path FROM nation)
        SELECT path, row_number() OVER (ORDER BY path)::INTEGER AS listed, row_number() OVER (ORDER BY path)::INTEGER AS by_units FROM p""",
}
