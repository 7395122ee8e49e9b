"""One query for each operator of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, knn, line_dedup, minhash, mixing, quality_rules, sharding, substring_dedup, token_counts, toxicity
from lectern.llm.common import checkpoint_dir, read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages of 20 words leave of every document."""
    return substring_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rule and certified cutoffs for every document."""
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.attribute(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and verdict for every document."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document with the classes they fall in: line_classes has number=document/number of the class's first line+links for each line, in order."""
    found = line_dedup.line_classes(read_table(spark, sf_dir, "documents"))
    each = F.transform(F.arrays_zip("lines", "classes", F.col("links")), lambda x: F.concat(x["lines"], F.lit("="), x["classes"]["doc"], F.lit("/"), x["classes"]["line"], F.lit("+"), x["links"]))
    return found.select("doc_id", "n_lines", "n_links", "n_removed", F.array_join(each, " ").alias("line_classes"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document; 3-word shingles, similarity of 0.85 or more."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), 3, 85)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"),
                                public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document, sources tempered by the square root of their size."""
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op9_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best neighbours of every 50th vector among all."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended as eight arrivals, compacted, and read back through the manifest."""
    store = sharding.ShardStore(spark, f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes=64 << 20)
    store.append(read_table(spark, sf_dir, "documents"), F.pmod("doc_id", F.lit(8)))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base rule of the quality rules, which SQL can express; the verdict it can't."""
    return quality_rules.measure(read_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_token_counts, op4_toxicity, op5_line_dedup, op6_minhash, op7_bpe, op8_mixing, op9_voronoi_knn, op10_sharding, quality_base)}
ORACLE: dict[str, str] = {"op1_substring_dedup": substring_dedup.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op6_minhash": minhash.ORACLE, "op8_mixing": mixing.ORACLE, "op9_voronoi_knn": knn.ORACLE,
                          "op10_sharding": sharding.ORACLE, "quality_base": quality_rules.BASE_ORACLE}
