"""Content identity: document hashes and the snapshot of a collection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import code_units


def version(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def snapshot(documents: DataFrame, selection: str) -> DataFrame:
    """One row: the hash over all (id, version) pairs by code units, and the selection rules.

    Pairs are sorted in parallel; the hash itself is one chain over them, so one task reads the sorted runs one after another and holds none of them.
    """
    pair = F.concat(F.col("id"), F.lit("\0"), F.col("hash"))
    listed = documents.select(pair.alias("pair")).orderBy(code_units(F.col("pair"))).coalesce(1)
    end = documents.sparkSession.range(0, 1, 1, 1).select(F.lit(None).cast("string").alias("pair"))  # so that there is a row without documents, too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, between = hashlib.sha256(), b""
        for batch in batches:
            for one in batch.column(0).to_pylist():
                if one is not None:
                    digest.update(between + one.encode())
                    between = b"\n"
        digest.update(b"\nselection\0" + selection.encode())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["snapshot"])

    return listed.unionByName(end).coalesce(1).mapInArrow(run, "snapshot string")
