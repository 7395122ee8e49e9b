"""Size-tiered compaction of immutable Parquet shards under a versioned manifest. DataFrame functions only.

append() writes arrivals as small shards and commits a manifest version that lists them beside those of the version before.
compact() sorts live shards below the target size into tiers by size (powers of ``fanout``); a tier with ``fanout`` shards or more is merged
into files of about the target size, without a shuffle: its scan is coalesced to as many tasks as files are wanted, so memory
stays constant and only data of the tier is rewritten. A version is written beside the others and becomes
visible by one rename that fails if another writer was first; readers see whole versions only, and a job
that dies leaves the last version as it was. The driver holds one line of metadata for each live shard, never rows.

Rules: rows, nulls, empty and very long texts, repeated rows and all columns, whatever their names, are kept as they are;
an empty arrival commits a version that reads as the one before; ties in size go by path. A writer that comes second gets a Conflict, and what it wrote is deleted.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("rows", T.LongType()),
                         T.StructField("since", T.LongType())])


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout

    # -- control plane: names and commits, no data

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Versions whose manifests are there, oldest first."""
        fs, p = self._fs(f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))

    def version(self) -> int:
        """The newest version committed; 0 if there is none."""
        return max([0, *self.versions()])

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{v:08d}")

    def _delete(self, *paths: str) -> None:
        for path in paths:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def _commit(self, rows: DataFrame, version: int) -> int:
        """Make rows the manifest of a version: one rename, which fails if the version is there already."""
        draft, target = f"{self.root}/drafts/{uuid.uuid4().hex}", f"{self.root}/manifest/v{version:08d}"
        rows.coalesce(1).write.parquet(draft)  # a line for each shard
        fs, folder = self._fs(f"{self.root}/manifest")
        fs.mkdirs(folder)
        jvm = self.spark._jvm
        rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs(draft)[1], self._fs(target)[1], jvm.java.lang.reflect.Array.newInstance(rename, 0))
        except Py4JJavaError as e:
            self._delete(draft)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version}") from None
            raise
        return version

    def _described(self, folder: str, schema: T.StructType, version: int) -> DataFrame:
        """Manifest lines of the files that a job has written."""
        return (self.spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"))
                .agg(F.max("_metadata.file_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
                .select("path", "bytes", "rows", F.lit(version).cast("long").alias("since")))

    # -- data plane

    def schema(self) -> T.StructType:
        fs, p = self._fs(f"{self.root}/schema.json")
        stream = fs.open(p)
        try:
            return T.StructType.fromJson(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _keep_schema(self, schema: T.StructType) -> None:
        fs, p = self._fs(f"{self.root}/schema.json")
        if not fs.exists(p):
            out = fs.create(p)
            out.write(bytearray(schema.json(), "utf-8"))
            out.close()

    def append(self, rows: DataFrame, arrival: Column | None = None) -> int:
        """Write rows as new shards, those of each arrival apart, and commit them. Returns the version."""
        v = self.version() + 1
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
        self._keep_schema(schema)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        if arrival is None:
            rows.write.parquet(folder)
        else:
            mark = "_arrival_" + uuid.uuid4().hex[:8]
            rows.withColumn(mark, arrival).write.partitionBy(mark).parquet(folder)
        try:
            return self._commit(self.manifest(v - 1).unionByName(self._described(folder, schema, v)), v)
        except Conflict:
            self._delete(folder)
            raise

    def tiers(self) -> list[tuple[int, list[str], int]]:
        """(tier, paths, bytes) of the tiers to merge: below the target size and with fanout shards at least."""
        size = F.greatest(F.col("bytes"), F.lit(1))
        small = self.manifest().where(F.col("bytes") * 2 <= self.target)
        grouped = small.groupBy(F.floor(F.log(float(self.fanout), size)).alias("tier")).agg(F.sort_array(F.collect_list("path")).alias("paths"), F.sum("bytes").alias("bytes"))
        return [(r["tier"], r["paths"], r["bytes"]) for r in grouped.where(F.size("paths") >= self.fanout).orderBy("tier").collect()]

    def compact(self, max_rounds: int = 32) -> int:
        """Merge until no tier is full; every merge is a version. Returns the newest version."""
        for _ in range(max_rounds):
            todo = self.tiers()
            if not todo:
                break
            schema = self.schema()
            for _, paths, size in todo:
                v = self.version() + 1
                folder = f"{self.root}/data/{uuid.uuid4().hex}"
                self.spark.read.schema(schema).parquet(*paths).coalesce(max(1, math.ceil(size / self.target))).write.parquet(folder)
                gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
                self._commit(self.manifest(v - 1).join(gone, "path", "left_anti").unionByName(self._described(folder, schema, v)), v)
        return self.version()

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards that only versions older than the newest ``keep`` list, and these versions' manifests. Returns the number of shards."""
        listed = self.versions()
        old = listed[:-keep] if keep else listed
        if not old:
            return 0
        lines = self.spark.read.schema(MANIFEST).parquet(*[f"{self.root}/manifest/v{v:08d}" for v in listed])
        last = F.max(F.regexp_extract(F.col("_metadata.file_path"), r"/v(\d+)/[^/]*$", 1).cast("long"))
        dead = [r["path"] for r in lines.groupBy("path").agg(last.alias("last")).where(F.col("last") <= old[-1]).select("path").collect()]
        self._delete(*dead)
        self._delete(*(f"{self.root}/manifest/v{v:08d}" for v in old))
        return len(dead)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema())
        return self.spark.read.schema(self.schema()).parquet(*paths)


#: DuckDB: what the store must give back.
ORACLE = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
