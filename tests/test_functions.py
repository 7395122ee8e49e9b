import re
import sqlite3

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.errors import QueryError
from lectern.functions import text as X
from lectern.operators import lines, metadata, ranking, scan, structure
from lectern.sources.globs import any_of


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first()["x"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\r\né", max_size=12), min_size=1, max_size=8))
def test_lines_join_to_the_text(spark, texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    rows = {}
    for r in lines.lines(docs).orderBy("id", "line").collect():
        rows.setdefault(r["id"], []).append(r)
    for i, t in enumerate(texts):
        own = rows[str(i)]
        assert "".join(r["raw"] for r in own) == t and [r["raw"] for r in own] == (re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", t) or [""])
        data = t.encode()
        assert all(data[r["byte_start"]:r["byte_end"]].decode() == r["raw"] for r in own)


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c.md", "a/c.md"), ("../x.md", None), ("a/../../x", None), ("", ""), ("a//b", "a/b")])
def test_normalized(spark, path, want):
    assert one(spark, X.normalized(F.col("p")), p=path) == want


@pytest.mark.parametrize(("text", "want"), [("a%20b", "a b"), ("a+b", "a+b"), ("%zz", None), ("%", None), ("%FF", None), ("%C3%A9", "é"), ("%EF%BF%BD", "�")])
def test_percent_decoded(spark, text, want):
    assert one(spark, X.percent_decoded(F.col("p")), p=text) == want


@pytest.mark.parametrize(("text", "want"), [("2024-02-29", True), ("2023-02-29", False), ("0000-01-01", False), ("2024-2-9", False), ("2024-02-29 ", False), ("0001-01-01", True)])
def test_real_date(spark, text, want):
    assert bool(one(spark, X.real_date(F.col("p")), p=text)) is want


@pytest.mark.parametrize("zone", ["UTC", "Pacific/Apia"])
def test_civil_date_as_the_sql(spark, zone):
    """Any year, zeros before short ones only, and in a zone that left a day out."""
    days = [*range(-719_900, 2_933_000, 997), -2_147_483_646, -4_371_953, -719_529, -719_528, -719_163, -719_162, -354_286, -354_285, -1, 0, 15_338, 2_932_896, 2_932_897, 26_979_997, 2_147_483_646]
    want = duckdb.execute("SELECT strftime(DATE '1970-01-01' + d::INTEGER, '%Y-%m-%d') FROM (SELECT unnest(?) AS d)", [days]).fetchall()
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark.createDataFrame([(i, d) for i, d in enumerate([*days, None])], "i int, d long").select("i", X.civil_date(F.col("d")).alias("x")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert [r["x"] for r in got] == [w for w, in want] + [None]


@pytest.mark.parametrize(("text", "want"), [("Hello, World!", "hello-world"), ("A  b_c-d", "a--b_c-d"), ("Café (x)", "café-x")])
def test_slug(spark, text, want):
    assert one(spark, X.slug(F.col("p")), p=text) == want


def test_query_terms():
    assert X.query_terms("Das DAS ﬁn x_y 3") == ["das", "fin", "x", "y", "3"]


@pytest.mark.parametrize(("glob", "path", "want"), [
    ("*.md", "a.md", True), ("*.md", "d/a.md", False), ("**/*.md", "a.md", True), ("**/*.md", "d/e/a.md", True), ("docs/**", "docs/a/b", True), ("docs/**", "docs", False),
    ("{a,b}/?.md", "b/x.md", True), ("[!a]x.md", "bx.md", True), ("[!a]x.md", "ax.md", False), ("!a.md", "b.md", True), ("!!a.md", "a.md", True), ("a.b", "aXb", False)])
def test_globs(glob, path, want):
    assert bool(any_of([glob]).fullmatch(path)) is want


def test_ranking_as_the_database_library(spark):
    rows = [(f"d{i}", " ".join(w for j, w in enumerate(["the", "Autonomía", "cat", "rare", "x", "the"] * 4) if (i * 7 + j) % (j % 5 + 2))) for i in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table p using fts5(id unindexed, content, tokenize=unicode61)")
    db.executemany("insert into p values (?, ?)", rows)
    want = dict(db.execute("select id, bm25(p) from p where p match '\"autonomía\" OR \"rare\" OR \"none\"'").fetchall())
    docs = spark.createDataFrame(rows, "id string, text string")
    got = {r["id"]: r["score"] for r in ranking.hits(lines.passages(docs), "autonomía RARE none").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


MARKDOWN = """# Top *one* `c`

See [a](b.md#p "t") and ![i](i.png) and [ref][r] <https://x.org>.

> # quoted
> [q](q.md)

- item [l](l.md)

  # in list

Set
ext
===

```
[no](no.md)
```

<a id="here"></a>

<!-- <a id="hid"></a> -->
<script>
<a id="s"></a>
</script>
text <a id="inl"></a> more

[r]: ref.md
"""


def test_scan():
    doc = scan.parse(MARKDOWN)
    assert [(lv, t) for lv, _, _, t in doc.headings] == [(1, "Top one c"), (1, "Set ext")]
    assert [d for d, _ in doc.links] == ["b.md#p", "ref.md", "https://x.org", "q.md", "l.md"]
    assert [a for a, _ in doc.anchors] == ["here", "inl"] and all(MARKDOWN[k:].startswith("<a id") for _, k in doc.anchors)
    assert scan.parse("").headings == [] and scan.parse("\n" * 50_000).links == []


def test_slug_numbers_pass_over_taken_names():
    assert structure.numbered(["a", "a-1", "a", "a"]) == ["a", "a-1", "a-2", "a-3"]


@pytest.mark.parametrize(("header", "want"), [
    ("title: x\nstatus: y", ("x", "y")), ("title: 0x1F", (None, None)), ("title: yes", ("yes", None)), ("title: '12'", ("12", None)), ("a: &k x\ntitle: *k", (None, None)),
    ("title: a\ntitle: b", (None, None)), ("1: a\n1.0: b", (None, None)), ("title: ' '", (None, None)), ("x: {title: in}", (None, None)), ("- a", (None, None)), ("a: [", (None, None))])
def test_lenient_headers(header, want):
    assert metadata.lenient(header) == want


@pytest.mark.parametrize(("header", "message"), [
    ("- a", "Outer metadata must be one untagged YAML mapping"), ("title: a\ntitle: b", "Metadata field is duplicated"), ("other: a", "Use only title"), ("title: {a: b}", "Metadata values must be"),
    ("tags: [[a]]", "Tags must be a flat"), ("title: *x", "Outer metadata contains invalid YAML"), ("title: [", "Outer metadata contains invalid YAML")])
def test_strict_headers(header, message):
    with pytest.raises(metadata.Fault) as e:
        metadata.strict(header)
    assert e.value.message.startswith(message)
    assert metadata.strict("title: &t x\nsource: *t")[1][4] == "x"


def test_report_is_bounded():
    out = QueryError("C", "é" * 400, {"x": "y" * 500}).report()["error"]
    assert len(out["message"].encode()) == 254 and out["messageTruncated"] and out["details"] == {"omitted": True}


TABLES = """# Top

Name | Link
:--- | ---:
`a\\|b` | [plain](one.md)
[x|y](two.md)
[bar \\| in](three.md) | `z|z` | [beyond](beyond.md)
[out](four.md) | y | [beyond](five.md)

| lone |
|---|
| [six](six.md) |
para [seven](seven.md)

no | table
[eight](eight.md)

See[^note] and [^other] and [^gone].

[^note]: Text [nine](nine.md)
    more [ten](ten.md)

    ## Inside

[^other]: [eleven](eleven.md)
~~[twelve](twelve.md)~~ end

- [ ] [task](task.md)
- [x] done
"""


def test_tables_footnotes_and_strikethrough():
    doc = scan.parse(TABLES)
    assert [d for d, _ in doc.links] == ["one.md", "three.md", "four.md", "six.md", "seven.md", "eight.md", "nine.md", "ten.md", "eleven.md", "twelve.md", "task.md"]
    assert all(TABLES[k] == "[" for _, k in doc.links)
    assert [h[3] for h in doc.headings] == ["Top"]
    assert scan.parse("# A[^1] b\n\n[^1]: x\n").title == "A b" and scan.parse("# A[^1] b\n").title == "A[^1] b"


def test_outline_of_large_documents(spark):
    many = "# h\n" * 20_000
    rows = [("blank", "\n" * 1_000_000), ("heads", many), ("long", "# " + "x" * (512 << 10) + "\n" + "line\n" * 70_000), ("over", "# h\n" * 32_769), ("null", None)]
    got = {r["id"]: r for r in structure.outline(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got["blank"]["lines"] == 1_000_000 and got["over"]["over"] and not got["over"]["marks"] and got["null"]["lines"] == 1
    assert got["heads"]["marks"][-1]["anchor"] == "h-19999" and got["long"]["sections"][0]["line_end"] == 70_001


def test_anchors_of_one_name_and_of_markup(spark):
    text = "# A\n<!-- <a id=\"no\"></a> -->\n<script>\n<a id=\"no2\"></a>\n</script>\n\n<a id=\"x\"></a>\n\n## A\n\n## a-1\n\ntext <a id=\"x\"></a>\n"
    marks = [tuple(m) for m in structure.outline(spark.createDataFrame([("d", text)], "id string, text string")).first()["marks"]]
    assert marks == [("a", 1, 13, None), ("x", 7, 10, None), ("a-1", 9, 10, None), ("a-1-1", 11, 13, None), ("x", 13, 13, 7)]


@pytest.mark.parametrize("size", [1, 3, 32])
def test_passages_as_slices_of_lines(spark, size):
    texts = ["", "a", "a\n", "\r\n\r\n\rx\n", "é\r\nb\n" * 50, "x\r" * 33 + "y", "a\n \n" * 16, "\n" * 64 + "z", "w\r\n" * 64, "q\n" * 700 + "é" * 3]
    want = []
    for i, t in enumerate(texts):
        ls = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", t)
        for k in range(0, len(ls), size):
            content = "".join(ls[k:k + size])
            if content.strip():
                at = len("".join(ls[:k]).encode())
                want.append((str(i), k + 1, min(k + size, len(ls)), at, at + len(content.encode()), content))
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], "id string, text string")
    assert sorted(map(tuple, lines.passages(docs, size).collect())) == sorted(want)


def test_passages_of_a_document_of_a_million_lines(spark):
    docs = spark.createDataFrame([("blank", "\n" * 16_000_000), ("long", "some words\n" * 1_000_000), ("short", "words\n")], "id string, text string")
    got = lines.passages(docs).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("last_byte").alias("end"), F.max("last_line").alias("last")).collect()
    assert {tuple(r) for r in got} == {("long", 31_250, 11_000_000, 1_000_000), ("short", 1, 6, 1)}
