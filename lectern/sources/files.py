"""Documents from a folder: configuration, walk, and reading.

The walk is metadata only and prunes folders before they are opened, so it runs on the driver and gives Spark explicit paths; contents
are read, validated and described on the executors.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.errors import QueryError
from lectern.functions.text import local_link
from lectern.operators.identity import version
from lectern.operators.metadata import lenient
from lectern.operators.scan import front_matter, parse
from lectern.sources.globs import PROTECTED, any_of, named_folders, special_folder

DOCUMENTS, SOURCE_BYTES, CORPUS_BYTES, CONFIG_BYTES, GLOBS = 2_048, 32 << 20, 64 << 20, 64 << 10, 64
INCLUDE = ("**/*.md", "**/*.markdown", "**/*.mdown")
FIELDS = ("exclude", "archive", "history", "include", "version", "extensions")
MARKDOWN = re.compile(r"\.(md|markdown|mdown)\Z", re.IGNORECASE | re.ASCII)


@dataclass
class Selection:
    """Globs of a collection; each use of them is one compiled pattern."""

    include: list[str]
    exclude: list[str]
    archive: list[str]

    def __post_init__(self) -> None:
        self.included, self.excluded, self.archived = map(any_of, (self.include, self.exclude, self.archive))
        self.opened = named_folders([*self.include, *self.archive])
        self.pruned = any_of([g for g in self.exclude if g.endswith("/**") and not g.startswith("!")])

    def skips(self, name: str, path: str) -> bool:
        """Whether a folder or file isn't even looked at."""
        return name in PROTECTED or special_folder(name) and not self.opened.fullmatch(path)

    def prunes(self, path: str) -> bool:
        return self.pruned.fullmatch(path + "/") is not None

    def classify(self, path: str) -> bool | None:
        """Whether a selected file is historical; None if it isn't selected."""
        if not MARKDOWN.search(path) or self.excluded.fullmatch(path):
            return None
        if self.archived.fullmatch(path):
            return True
        return False if self.included.fullmatch(path) else None

    def identity(self) -> str:
        units = lambda xs: sorted(xs, key=lambda x: x.encode("utf-16-be"))
        return json.dumps({"include": units(self.include), "exclude": units(self.exclude), "archive": units(self.archive)}, ensure_ascii=False, separators=(",", ":"))


def classified(path: Column, rules: Selection) -> Column:
    """The same for a column of paths: true, false or, if a path isn't selected, null. Java and Python read the patterns alike."""
    whole = lambda pattern: path.rlike(rf"(?s)\A(?:{pattern.pattern})\z")
    return F.when(~path.rlike(r"(?i)\.(md|markdown|mdown)\z") | whole(rules.excluded), F.lit(None)).when(whole(rules.archived), True).when(whole(rules.included), False)


def root_folder(root: str) -> str:
    if not root.strip().strip("\ufeff").strip():
        raise QueryError("INVALID_ROOT", "Project root must be a non-empty path")
    path = os.path.abspath(root)
    try:
        mode = os.lstat(path).st_mode
    except OSError as e:
        raise QueryError("INVALID_ROOT", "Project root is not readable", {"reason": str(e), "root": path}) from None
    if stat.S_ISLNK(mode):
        raise QueryError("INVALID_ROOT", "Project root must not be a symlink")
    if not stat.S_ISDIR(mode):
        raise QueryError("INVALID_ROOT", "Project root must be a directory")
    return path


def _globs(value: object, name: str, default: tuple[str, ...]) -> list[str]:
    if value is None:
        return [*default]
    if not isinstance(value, list) or len(value) > GLOBS:
        raise QueryError("INVALID_CONFIG", f"{name} must contain at most {GLOBS} relative globs")
    out = []
    for k, g in enumerate(value):
        if not isinstance(g, str) or not g.strip().strip("\ufeff").strip():
            raise QueryError("INVALID_CONFIG", f"{name}[{k}] must be a non-empty relative glob")
        g = g.replace("\\", "/")
        if g.startswith("/") or "\0" in g or ".." in g.split("/"):
            raise QueryError("INVALID_CONFIG", f"{name}[{k}] must stay inside the project root")
        try:
            any_of([g]), named_folders([g])
            out.append(g)
        except (ValueError, re.error) as e:
            raise QueryError("INVALID_CONFIG", f"{name}[{k}] is not a valid glob", {"reason": str(e)}) from None
    return out


def selection(root: str, config: str = "lectern.json") -> Selection:
    """The rules in the folder's configuration file; all Markdown without one."""
    path, bad = os.path.join(root, config), lambda m, d=None: QueryError("INVALID_CONFIG", m, d)
    try:
        mode = os.lstat(path).st_mode
    except FileNotFoundError:
        return Selection(_globs(None, "include", INCLUDE), [], [])
    if stat.S_ISLNK(mode):
        raise bad(f"{config} must not be a symlink")
    if not stat.S_ISREG(mode):
        raise bad(f"{config} must be a regular file")
    with open(path, "rb") as f:
        data = f.read(CONFIG_BYTES + 1)
    if len(data) > CONFIG_BYTES:
        raise QueryError("DOCUMENT_TOO_LARGE", f"Markdown source exceeds {CONFIG_BYTES} bytes", {"maxBytes": CONFIG_BYTES, "path": config})
    try:
        value = json.loads(data.decode("utf-8-sig"))
    except UnicodeDecodeError:
        raise QueryError("INVALID_UTF8", "Markdown source is not valid UTF-8", {"path": config}) from None
    except ValueError as e:
        raise bad(f"{config} must contain valid JSON", {"reason": str(e)}) from None
    if not isinstance(value, dict):
        raise bad(f"{config} must contain an object")
    if "collections" in value:
        raise QueryError("LEGACY_CONFIGURATION", f"{config} uses legacy collections; replace it with include and exclude globs")
    if unknown := next((k for k in value if k not in FIELDS), None):
        raise bad(f"{config} has unsupported field: {unknown}")
    if "version" in value and not (isinstance(value["version"], str) and re.fullmatch(r"\+?\d+(\.\+?\d+){2}", value["version"], re.ASCII)):
        raise bad(f"{config} version must be MAJOR.MINOR.PATCH")
    if "archive" in value and "history" in value:
        raise bad("Use archive instead of history; do not specify both fields")
    archive = "history" if "history" in value else "archive"
    return Selection(_globs(value.get("include"), "include", INCLUDE), _globs(value.get("exclude"), "exclude", ()), _globs(value.get(archive), archive, ()))


def walk(root: str, rules: Selection) -> tuple[list[tuple[str, bool, int]], list[tuple[str, str]]]:
    """(path, historical, size) of selected files, and (path, message) of what was passed over."""
    found: list[tuple[str, bool, int]] = []
    warnings: list[tuple[str, str]] = []

    def visit(folder: str, at: str) -> None:
        try:
            with os.scandir(folder) as it:
                entries = list(it)
        except OSError as e:
            warnings.append((at or ".", f"Unable to inspect directory: {e}"))
            return
        for e in sorted(entries, key=lambda e: e.name):
            path = f"{at}/{e.name}" if at else e.name
            if rules.skips(e.name, path):
                continue
            if e.is_symlink():
                warnings.append((path, "Skipped symbolic link"))
            elif e.is_dir(follow_symlinks=False):
                if not rules.prunes(path):
                    visit(e.path, path)
            elif e.is_file(follow_symlinks=False) and (old := rules.classify(path)) is not None:
                found.append((path, old, e.stat(follow_symlinks=False).st_size))

    visit(root, "")
    return found, warnings


def within_budget(files: list[tuple[str, bool, int]]) -> tuple[list[tuple[str, bool, int]], list[tuple[str, str]]]:
    """Files in reading order that fit the collection's bytes; a file that doesn't fit is passed over, later ones may still fit."""
    kept, warnings, used = [], [], 0
    for path, old, size in files[:DOCUMENTS]:
        if size > CORPUS_BYTES - used:
            warnings.append((path, "Selected Markdown exceeds the 64 MiB memory budget; narrow include paths"))
        elif size > SOURCE_BYTES:
            warnings.append((path, f"Markdown source exceeds {SOURCE_BYTES} bytes"))
        else:
            kept.append((path, old, size))
            used += size
    if len(files) > DOCUMENTS:
        warnings.append((".", f"Only the first {DOCUMENTS} Markdown sources were loaded"))
    return kept, warnings


def collated(spark: SparkSession, names: list[str]) -> dict[str, int]:
    """Places of names in the order of listings."""
    if not names:
        return {}
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(F.collate("n", "UNICODE"), "n").collect()  # names only, of all files found: the cap takes the first of them in this order
    return {r["n"]: k for k, r in enumerate(rows)}


DESCRIBED = "id string, title string, status string, links array<string>"


def described(documents: DataFrame) -> DataFrame:
    """Title, status and raw link targets of each document."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, text in zip(part["id"], part["text"], strict=True):
                front = front_matter(text)
                title, status = lenient(text[front[0]:front[1]]) if front else (None, None)
                doc = parse(text if front else text.removeprefix("\ufeff"))
                out.append((key, title or (doc.title if doc.title is not None else PurePosixPath(key).name), status, [d for d, _ in doc.links if d]))
            yield pd.DataFrame(out, columns=["id", "title", "status", "links"])

    got = documents.select("id", "text").mapInPandas(run, DESCRIBED)
    resolved = F.array_distinct(F.filter(F.transform("links", lambda x: local_link(F.col("id"), x)), lambda x: x.isNotNull()))
    return got.select("id", "title", "status", resolved.alias("links"))


def load(spark: SparkSession, root: str, files: list[tuple[str, bool, int]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, warnings, the persisted texts behind both): id, text, hash, historical, title, status, links; bytes that aren't UTF-8 give a warning instead."""
    names = spark.createDataFrame([(f"file:{root}/{p}", p, old) for p, old, _ in files], "file string, id string, historical boolean")
    if not files:
        text = names.select("id", F.lit("").alias("text"), "historical", F.lit(True).alias("ok"))
    else:
        read = spark.read.format("binaryFile").load([f"file:{root}/{p}".translate({ord(c): "\\" + c for c in "{}[]*?\\"}) for p, _, _ in files])
        plain = F.regexp_replace(F.col("path"), r"^file:/*", "/")
        text = read.select(plain.alias("at"), "content").join(F.broadcast(names.withColumn("at", F.regexp_replace("file", r"^file:/*", "/"))), "at").select(
            "id", F.col("content").cast("string").alias("text"), "historical", F.is_valid_utf8("content").alias("ok"))
    text = text.persist()
    good = text.where("ok").drop("ok")
    documents = good.join(described(good), "id").withColumn("hash", version(F.col("text")))
    return documents, text.where("not ok").select(F.col("id").alias("path"), F.lit("Markdown source is not valid UTF-8").alias("message")), text
