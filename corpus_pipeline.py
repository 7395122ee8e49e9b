"""The training-data pipeline: five stages over the documents of a folder, each written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, line_dedup, minhash, mixing, toxicity
from lectern.llm.common import checkpoint_dir, cut, read_table, unused


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds toxic go."""
    return toxicity.reject(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within two edits of an earlier line's class go, short ones if equal to an earlier one; documents stay."""
    return line_dedup.drop_lines(docs, line_dedup.line_classes(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in 0.8 of their five-word shingles, directly or not, the one of the smallest id stays, a row for each text that it has; rows without an id stay."""
    mark = unused(docs)
    gone = minhash.near_duplicates(docs, 5, 80).where("not kept").select(F.col("doc_id").alias(mark))
    left = docs.join(gone, F.col("doc_id") == F.col(mark), "left_anti")
    several = cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(mark)).count().where("count > 1").select(mark))
    if several.isEmpty():
        return left
    once = left.join(several, F.col("doc_id") == F.col(mark), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(several, F.col("doc_id") == F.col(mark), "left_anti").unionByName(once)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources tempered by Poisson replication, shuffled globally."""
    return mixing.mix(docs).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("minhash", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Three of the stages can't be written in SQL; tests/llm/test_pipeline.py compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``: (doc_id, n_tokens, ids_sha256, decoded_sha256, ids) for each copy that mixing makes of a document that stays.

    Each stage is written to the shared folder and read again; what it was made of is then deleted. An empty table gives no rows. Rows without an id are
    judged for toxicity, keep their lines, are near copies of nothing, and are replicated and encoded as others; null and empty texts stay, as zero tokens;
    of rows that share id and text one stays. Columns beside those of the table are carried along as far as mixing.
    """
    docs, root, last = read_table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if last:
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = f"{root}/{name}"
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
