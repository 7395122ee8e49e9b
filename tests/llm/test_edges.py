"""Every operator over a table with nulls, empty and long texts, repeated rows and columns whose names it might use itself, and over no rows."""

import uuid

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, knn, line_dedup, minhash, mixing, quality_rules, sharding, substring_dedup, token_counts, toxicity
from lectern.llm.common import checkpoint_dir

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CLASHES = ("id n key sig words route spans h c t y stratum kept broken token tokens a b u v w f lid k1 k2 at line lines classes links shingles family block blocks low high "
           "node component found head mix_source mix_cdf copy_no shuffle_key _gone _gone_id p_toxic grade toxic n_words ids section").split()


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, "plain text of a document with some words in it", "en", "s", 5), (1, "plain text of a document with some words in it", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0),
            (4, long, "en", None, 1), (5, "x" * 100_000, None, "s", 1), (6, " \n\t \n", "fr", "s", 1), (7, passage, "en", "s", 1), (8, passage, "en", "s", 1), (None, "a row without an id", "en", "s", 1),
            (9, "café \u0000 \U0001f600 ﻿", "en", "s", 1), (10, "\n".join([passage] * 3), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").withColumn("id", F.lit(1)).withColumn("y", F.lit(1))


def shards(d, _):
    store = sharding.ShardStore(d.sparkSession, f"{checkpoint_dir(d.sparkSession)}/shards-{uuid.uuid4().hex}", 1 << 20, 2)
    for _ in range(3):
        store.append(d)
    store.compact()
    store.vacuum()
    return store.read()


def neighbours(d, _):
    rows = d.select(F.col("doc_id").alias("vec_id"), F.when(F.col("text") != "", F.array(F.length("text").cast("float"), F.lit(1.0))).alias("embedding"), *CLASHES)
    return knn.top_k(rows, rows.where("vec_id % 5 = 0"))


RUNS = {
    "op1": (lambda d, _: substring_dedup.dedup(d), 12), "op2": (lambda d, y: quality_rules.judge(d, y), 12), "op3": (lambda d, _: token_counts.attribute(d, PATH, P.PATTERN).select("doc_id").distinct(), 11),
    "op4": (lambda d, y: toxicity.score(d, toxicity.train(d, y)), 12), "op5": (lambda d, _: line_dedup.line_classes(d), 11), "op6": (lambda d, _: minhash.near_duplicates(d), 11),
    "op7": (lambda d, _: bpe.encode_documents(d, PATH, P.PATTERN, with_ids=True), 12), "op8": (lambda d, _: mixing.mix(d, weights={"s": 1.0}, budget=2_000), None), "op9": (neighbours, 10), "op10": (shards, 36)}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(docs, labels, name):
    run, rows = RUNS[name]
    got = run(docs, labels).collect()
    assert rows is None or len(got) == rows
    if name == "op1":
        gone = {r["doc_id"]: r["n_removed"] for r in got}
        assert gone[7] == 0 and gone[8] == 40 and gone[10] == 120 and gone[4] == 0
    if name == "op5":
        assert {r["doc_id"]: r["n_removed"] for r in got} == {None: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 1, 9: 0, 10: 3}
    if name == "op6":
        assert {r["doc_id"]: r["component_id"] for r in got}[8] == 7
    if name == "op8":
        assert {r["doc_id"] for r in got} == {None, 1, 3, 5, 6, 7, 8, 9, 10}
    if name == "op10":
        assert sorted(map(str, got)) == sorted(map(str, docs.collect() * 3))


@pytest.mark.parametrize("name", RUNS)
def test_no_rows(docs, labels, name):
    assert RUNS[name][0](docs.limit(0), labels).count() == 0


def test_stages_over_odd_rows(spark, docs, labels, tmp_path):
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        if name == "bpe":
            assert sorted(r["n_tokens"] for r in out.where("doc_id in (2, 3)").collect()) == [0, 0] and out.count() == 12
        else:
            assert out.columns == docs.columns
        if name != "mixing":
            assert out.where("doc_id is null").count() == 1 and out.where("doc_id = 1").count() == (1 if name == "minhash" else 2)
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Cluster:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = type("Conf", (), {"get": lambda self, key, default: default})(), Cluster()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


@pytest.mark.parametrize("char", [" ", "\n", "a"])
def test_a_million_of_one_character(spark, char):
    df = spark.createDataFrame([(1, char * 1_000_000)], "doc_id long, text string")
    n = bpe.encode_documents(df, PATH, P.PATTERN).first()["n_tokens"]
    assert n > 0 and token_counts.attribute(df, PATH, P.PATTERN).agg(F.sum("n_tokens")).first()[0] == n
