import json

import pytest

from lectern.errors import QueryError, compact
from lectern.project import Project

A = """---
title: Alpha
status: accepted
created_at: 2024-01-01
tags: [a]
---
# A

Word authority here.

## Relationships
- Depends on [B](b.md#policy): because
"""
B = "# B\r\n\r\n## Policy\r\n\r\nText with authority and café.\r\n\r\n### Sub\r\n\r\nMore [gone](gone.md) and [web](https://e.org/x.md).\r\n"


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("p")
    for path, text in {"docs/a.md": A, "docs/b.md": B, "old/c.md": "# Old\nauthority\n", "target/x.md": "x", "bad.md": b"\xff\xfe", "notes.txt": "n"}.items():
        (root / path).parent.mkdir(exist_ok=True, parents=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())
    (root / "link.md").symlink_to(root / "docs/a.md")
    (root / "lectern.json").write_text(json.dumps({"archive": ["old/**"]}))
    return Project.open(spark, str(root))


def test_sources(project):
    out = project.sources()
    assert [d["id"] for d in out["documents"]] == ["docs/a.md", "docs/b.md", "old/c.md"]
    assert [d["title"] for d in out["documents"]] == ["Alpha", "B", "Old"] and out["documents"][0]["links"] == ["docs/b.md"]
    assert {(w["path"], w["message"]) for w in out["warnings"]} == {("bad.md", "Markdown source is not valid UTF-8"), ("link.md", "Skipped symbolic link")}


def test_pages_join_up_and_fit(project):
    whole, got, cursor = project.sources()["documents"], [], None
    while True:
        out = project.sources(limit=2, max_bytes=900, cursor=cursor)
        assert len(compact(out).encode()) <= 900
        got += out["documents"]
        cursor = out["continuation"]
        if not cursor:
            break
    assert got == whole
    for bad in ("s1.x.1", "q2", f"s1.{project.snapshot}.9"):
        with pytest.raises(QueryError) as e:
            project.sources(cursor=bad)
        assert e.value.code == "INVALID_CURSOR"


def test_read(project):
    out = project.read("docs/b.md", 3, 5)
    assert out["text"] == "## Policy\r\n\r\nText with authority and café." and out["continuation"]["reason"] == "range"
    assert project.read("docs/b.md", 9)["text"].endswith("\r\n")
    assert project.read("docs/b.md", max_bytes=12)["lineEnd"] == 2 or project.read("docs/b.md", max_bytes=12)["continuation"]["reason"] == "max-bytes"
    for args, code in ((("docs/b.md", 5, 4), "INVALID_RANGE"), (("docs/b.md", 1, 99), "INVALID_RANGE"), (("none.md",), "SOURCE_NOT_FOUND"), (("docs/b.md", 5, 5, 3), "OUTPUT_LIMIT")):
        with pytest.raises(QueryError) as e:
            project.read(*args)
        assert e.value.code == code


def test_search(project):
    out = project.search("AUTHORITY")
    assert out["totalMatches"] == 2 and {m["document"] for m in out["matches"]} == {"docs/a.md", "docs/b.md"}
    assert all(m["context"]["complete"] and m["lineStart"] == 1 for m in out["matches"])
    assert project.search("cafe")["matches"][0]["document"] == "docs/b.md"
    assert project.search("authority", historical=True)["totalMatches"] == 3
    assert project.search("authority", sources=["old/c.md"])["matches"][0]["historical"] is True
    assert project.search("!!")["totalMatches"] == 0
    for kw in ({"query": " "}, {"query": "x", "limit": 65}):
        with pytest.raises(QueryError) as e:
            project.search(**kw)
        assert e.value.code == "INVALID_ARGUMENT"


def test_relations(project):
    out = project.relations("docs/b.md", "incoming")
    edge = out["relations"][0]
    assert (edge["kind"], edge["navigation"], edge["from"]["lineStart"]) == ("depends-on", "incoming", 12)
    assert (edge["to"]["anchor"], edge["to"]["lineStart"], edge["to"]["lineEnd"]) == ("policy", 3, 9)
    assert project.relations("docs/b.md", "outgoing")["totalRelations"] == 0
    assert project.relations("docs/a.md")["relations"][0]["navigation"] == "outgoing"


def test_check(project):
    out = project.check()
    assert out["status"] == "failed" and (out["checkedDocuments"], out["checkedMetadataDocuments"], out["checkedReferenceDocuments"]) == (2, 2, 2)
    assert [(f["document"], f["code"], f["line"]) for f in out["findings"]] == [("docs/b.md", "INVALID_METADATA", 1), ("docs/b.md", "INVALID_REFERENCE", 9)]
    assert project.check(sources=["docs/a.md"])["totalFindings"] == 0


def test_faults(spark):
    from pyspark.sql import functions as F

    def over(**texts):
        rows = [(k.replace("_", "/") + ".md", v, False, k, None, []) for k, v in texts.items()]
        df = spark.createDataFrame(rows, "id string, text string, historical boolean, title string, status string, links array<string>")
        return Project(df.withColumn("hash", F.sha2("text", 256)), [], "{}")

    block = "## Relationships\n"
    for line, code, says in (
            ("* Depends on [x](b.md): y", "INVALID_RELATION", "expected one unindented unordered bullet line"), ("- Needs [x](b.md): y", "INVALID_RELATION", "unknown or malformed relationship literal"),
            ("- Extends x", "INVALID_RELATION", "expected a plain Markdown link after the literal"), ("- Extends [](b.md): y", "INVALID_RELATION", "link label must be non-empty plain text"),
            ("- Extends [x](b.md) y", "INVALID_RELATION", "expected ': ' followed by a reason"), ("- Extends [x](b.md):  ", "INVALID_RELATION", "relationship reason must be non-empty"),
            ("- Extends [x](b.md): see [y](c.md)", "INVALID_RELATION", "entry must be one unordered list item with exactly one plain inline link"),
            ("- Extends [x](/b.md): y", "INVALID_RELATION", "target must be a relative Markdown source with an optional non-empty fragment")):
        with pytest.raises(QueryError) as e:
            over(a=block + line + "\n", b="x").relations("a.md", "outgoing")
        assert (e.value.code, e.value.details["cause"], e.value.details["line"]) == (code, says, 2), line
    p = over(a=block + "- Extends [x](b.md#no): y\n", b="# t\n")
    with pytest.raises(QueryError) as e:
        p.relations("b.md", "incoming")
    assert e.value.message == "Relation anchor does not exist" and e.value.details["targetDetails"]["document"] == "b.md"
    out = p.check()["findings"]
    assert [f["code"] for f in out] == ["INVALID_RELATION", "INVALID_REFERENCE"] and out[1]["details"]["document"] == "b.md"
    p = over(a="[l](b.md#here)", b="<a id=\"here\"></a>\n\n# Here\n")
    assert [(f["code"], f["details"]["firstLine"]) for f in p.check()["findings"]] == [("AMBIGUOUS_ANCHOR", 1)]


def opened(spark, root, **files):
    for path in root.iterdir():
        path.unlink()
    for name, text in files.items():
        (root / f"{name}.md").write_text(text)
    return Project.open(spark, str(root))


def fault(call, *args, **options):
    with pytest.raises(QueryError) as e:
        call(*args, **options)
    return e.value


def test_many_lines_in_bounded_windows(spark, tmp_path):
    with opened(spark, tmp_path, blank="\n" * (16 << 20)) as p:
        assert p.search("missing")["totalMatches"] == 0 and p.check()["status"] == "ready"
    with opened(spark, tmp_path, blank="amber\n" * (32 * 32_769)) as p:
        assert fault(p.search, "amber").code == "SEARCH_LIMIT"
    with opened(spark, tmp_path, blank="# " + "x" * (512 << 10) + "\n" + "Ordinary text without a match.\n" * 70_000) as p:
        assert p.search("quasarexclusive")["totalMatches"] == 0 and p.search("ordinary", limit=64, max_bytes=65_536)["matches"]


def test_anchor_limits(spark, tmp_path):
    with opened(spark, tmp_path, heads="## Heading\n" * 32_769, source="[a](heads.md#heading)\n") as p:
        assert [(f["document"], f["code"]) for f in p.check()["findings"]] == [("heads.md", "ANCHOR_LIMIT"), ("source.md", "ANCHOR_LIMIT")]
    with opened(spark, tmp_path, target="# Policy\n" + "\n" * (1 << 20), source="[Policy](target.md?view=raw#policy)\n" * 512) as p:
        assert p.check(["source.md"])["status"] == "ready"
    with opened(spark, tmp_path, source="".join(f"[Target](t{k}.md#heading)\n" for k in range(4)), **{f"t{k}": "## Heading\n" * 20_000 for k in range(4)}) as p:
        assert [(f["line"], f["code"]) for f in p.check(["source.md"])["findings"]] == [(4, "ANCHOR_LIMIT")]


@pytest.mark.parametrize("hidden", [
    '<!-- <a id="phantom"></a> -->', '<script>\n<a id="phantom"></a>\n</script>', '<script>\n</scripture><a id="phantom"></a>\n</script>', '<style>\n<a id="phantom"></a>\n</style>',
    '<textarea><a id="phantom"></a></textarea>', "<div title='<fake> <a id=\"phantom\"></a>'></div>"])
def test_hidden_anchors(hidden):
    from lectern.operators.structure import Outline

    assert [m[0] for m in Outline(f"# B\n{hidden}\n\n<a id=\"real\"></a>\n").marks] == ["b", "real"]
    assert [m[0] for m in Outline("<script>\r\n</script\r\n>\r\n<a id=\"real\"></a>\r\n").marks] == ["real"]


def test_too_many_declarations(spark, tmp_path):
    entries = [f"- Depends on [B](b.md): scope {i}\n" for i in range(2_049)]
    with opened(spark, tmp_path, a="## Relationships\n" + "".join(entries), b="# B\n") as p:
        e = fault(p.relations, "a.md", "outgoing", limit=1)
        assert e.code == "RELATION_LIMIT" and e.details["line"] == 2_050
    with opened(spark, tmp_path, a="## Relationships\n" + "".join(entries[:1_025]), c="## Relationships\n" + "".join(entries[1_025:]), b="# B\n") as p:
        assert fault(p.relations, "b.md", "incoming", limit=1).code == "RELATION_LIMIT"
