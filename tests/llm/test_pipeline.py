import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lectern.llm import bpe, mixing, toxicity
from tests.llm.test_line_dedup import POS_BITS
from tests.llm.test_line_dedup import brute as line_brute
from tests.llm.test_minhash import brute as near_brute


def fixture(spark, root):
    """Clean texts, toxic ones, shared lines, near and exact copies, empty and null texts."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(8)) for _ in range(n))
    shared = text(1)
    rows, toxic = [], []
    for i in range(160):
        t = text(rng.randrange(1, 6))
        if i % 5 == 0:
            toxic.append(i)
            t += " vile nasty " + " ".join(rng.choice(["vile", "nasty", "foul"]) for _ in range(3))
        elif i % 7 == 0:
            t = rng.choice(rows)[1].replace("vile", "mild").replace("nasty", "mild").replace("foul", "mild") if rows else t
        elif i % 3 == 0:
            t += "\n" + shared + ("x" if i % 2 else "")
        rows.append((i, t, "en", "big" if i % 3 else "small", len(t)))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(3):  # unlike lines, like shingles
        copy = [*base[:30 * i], "somethingelse", *base[30 * i + 1:]]
        rows.append((600 + i, " ".join(copy), "en", "big", len(" ".join(copy))))
    rows += [(500, None, None, None, None), (501, "", "en", "small", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return rows, toxic


def test_run_as_brute_force(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows, toxic = fixture(spark, root)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    judged = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{root}/labels.parquet"))).where("toxic").collect()}
    assert judged == set(toxic)
    left = {r[0]: r for r in rows if r[0] not in judged}
    classes = line_brute([(i, r[1]) for i, r in left.items()])
    for i, r in left.items():
        gone = {k & (1 << POS_BITS) - 1 for k, (c, _) in classes.items() if k >> POS_BITS == i and c != k}
        if gone:
            t = "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in gone)
            left[i] = (i, t, *r[2:4], len(t))
    near = near_brute([(i, r[1]) for i, r in left.items()], 5, 80)
    left = [r for i, r in left.items() if near[i][2]]
    assert 0 < len(left) < sum(r[0] not in judged for r in rows)
    copies = mixing.mix(spark.createDataFrame(left, docs.schema)).collect()
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((r["doc_id"], e.encode_ordinary(r["text"] or "")) for r in copies)
    got = sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, root).collect())
    assert got == want


def test_stages_give_back_the_columns_of_documents(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    fixture(spark, root)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, root).dtypes == docs.dtypes
