"""Small reports: newest releases, documents by state, the status of a check, the list of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import release

#: What each command of a project answers.
COMMANDS = {
    "sources": "Selected documents with content hashes, titles, states and links",
    "read": "Exact lines of one document",
    "search": "Best passages for a query, widened to their sections",
    "relations": "Typed edges from and to one document",
    "check": "Findings in headers, declared edges and references",
}


def newest_release(tags: DataFrame, *group: str) -> DataFrame:
    """(group, newest): of tags vMAJOR.MINOR.PATCH the highest version, without its v; other tags don't count."""
    version = F.regexp_extract("tag", r"^v(.*)$", 1)
    return tags.groupBy(*group).agg(F.max_by(version, release(version)).alias("newest"))


def by_state(documents: DataFrame) -> DataFrame:
    """(status, documents, ids): ids in order, in one row a state."""
    return documents.groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.sort_array(F.collect_list("id")).alias("ids"))


def check_status(findings: Column, partial: Column) -> Column:
    """failed with any finding; else partial where something was passed over; else ready."""
    return F.when(findings > 0, "failed").when(partial, "partial").otherwise("ready")


def commands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*COMMANDS.items()], "command string, summary string")
