import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lectern.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    return bpe.Bpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_as_the_library(both):
    b, e = both
    rng = random.Random(1)
    bits = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "1", "23", ".", "!!", "中", "😀", " ", "　", "\u0085", "don't", "The", "<|endoftext|>"]
    docs = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    for text, got in zip(docs, b.encode_all(docs)):
        assert np.frombuffer(got, "<u4").tolist() == e.encode_ordinary(text), text
        assert b.decode(got).decode() == text


@pytest.mark.parametrize("text", ["a" * 30001, "ab" * 20000 + "a" * 9, "=" * 5000, "".join(random.Random(3).choice("abcdeth") for _ in range(50000))])
def test_very_long_pre_tokens(both, text):
    b, e = both
    assert np.frombuffer(b.encode(text), "<u4").tolist() == e.encode_ordinary(text)


def test_table_with_nulls_repeats_and_clashing_columns(spark, both):
    _, e = both
    rows = [(1, "the cat\n\nsat", "x"), (1, "the cat\n\nsat", None), (None, "a", "y"), (2, None, None), (3, "", ""), (4, " lead and trail \n", "id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted(map(tuple, bpe.encode_documents(df, PATH, P.PATTERN, with_ids=True).collect()), key=str)
    want = []
    for k, t, _ in rows:
        ids = e.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(df.limit(0), PATH, P.PATTERN).count() == 0


def test_ranks_file():
    with open(PATH, "rb") as f:
        tok, r = f.readline().split()
    assert bpe.load_ranks(PATH)[base64.b64decode(tok)] == int(r)
