import random

import public_tokenizers as P
import pytest
import tiktoken

from lectern.llm import bpe
from lectern.llm import token_counts as T

PATH = P.path("byte_bpe_50k.tiktoken")


def brute(text, sections, rule):
    """Counts by walking over every byte of every token."""
    ranks = bpe.load_ranks(PATH)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    owner = [k for k, s in enumerate(sections) for _ in s.encode()]
    out, at = [0.0] * len(sections), 0
    for t in e.encode_ordinary(text):
        own = owner[at:at + len(e.decode_single_token_bytes(t))]
        at += len(own)
        if rule == "start":
            out[own[0]] += 1
        elif rule == "end":
            out[own[-1]] += 1
        elif rule == "majority":
            out[max(sorted(set(own)), key=lambda k: (own.count(k), -k))] += 1
        else:
            for k in own:
                out[k] += 1 / len(own)
    return out


@pytest.mark.parametrize("rule", T.RULES)
def test_lines_as_byte_by_byte(spark, rule):
    rng = random.Random(1)
    docs = ["".join(rng.choice(["the", " ", "\n", "\n\n", "   \n", "é", "中", "ing", "."]) for _ in range(rng.randrange(40))) for _ in range(60)]
    docs += ["\n\n\n\n\n  x", "a\n", "word " * 3000]
    df = spark.createDataFrame([*enumerate(docs), (900, None)], "doc_id long, text string")
    got = {}
    for r in T.attribute(df, PATH, P.PATTERN, rule).orderBy("doc_id", "section").collect():
        got.setdefault(r[0], []).append(r)
    for i, t in enumerate(docs):
        lines = t.splitlines(keepends=True) if t else [""]
        assert [t[r["first_char"]:r["end_char"]] for r in got[i]] == lines
        assert [r["n_tokens"] for r in got[i]] == pytest.approx(brute(t, lines, rule))
    assert [tuple(r) for r in got[900]] == [(900, 0, 0, 0, 0.0)]


def test_fields(spark):
    df = spark.createDataFrame([(1, "Title", "the body of it"), (2, None, "b"), (3, "", None)], "k long, section string, id string")
    rows = T.attribute(df, PATH, P.PATTERN, "start", "k", ["section", "id"], separator="\n\n").orderBy("k", "section").collect()
    assert [r["n_tokens"] for r in rows[:2]] == brute("Title\n\nthe body of it", ["Title\n\n", "the body of it"], "start")
    assert len(rows) == 6 and T.attribute(df.limit(0), PATH, P.PATTERN, id_col="k", text_col="id").count() == 0
    with pytest.raises(ValueError):
        T.attribute(df, PATH, P.PATTERN, "half")
