import hashlib
import random

import pytest

from lectern.llm import substring_dedup as S


def brute(rows):
    first, out = {}, {}
    docs = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(docs):
        for s in range(len(docs[i]) - S.WINDOW + 1):
            first.setdefault(tuple(docs[i][s:s + S.WINDOW]), (i, s))
    for i, w in docs.items():
        gone = {k for s in range(len(w) - S.WINDOW + 1) if first[tuple(w[s:s + S.WINDOW])] != (i, s) for k in range(s, s + S.WINDOW)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"wört{i}" for i in range(300)] + ["x\x00y", "a b"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [text(n) for n in (19, 20, 21, 60, 200)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += text(rng.randrange(30))
            if rng.random() < 0.7:
                p = rng.choice(shared)
                a = rng.randrange(len(p))
                parts += p if rng.random() < 0.5 else p[a:]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(500, None), (501, ""), (502, " ".join(["la"] * 70)), (503, " ".join(shared[3] * 3)), (504, rows[7][1]), (-5, " ".join(shared[4]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("frequent", "held", "chunk"), [(128, 60_000, 20_000), (3, 20, 7)])
def test_as_brute_force(spark, monkeypatch, frequent, held, chunk):
    for name, x in (("FREQUENT", frequent), ("HELD", held), ("CHUNK", chunk)):
        monkeypatch.setattr(S, name, x)
    rows = corpus(frequent)
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = {r[0]: (r[1], r[2], r[3]) for r in S.dedup(df).collect()}
    assert got == brute(rows)


def test_no_rows_and_kept_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup(df).count() == 0
    row = S.dedup(spark.createDataFrame([(1, "a  b\nc"), (None, "d")], "doc_id long, text string"), with_text=True).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_removed"], r["kept_text"]) for r in row] == [(None, 0, "d"), (1, 0, "a b c")]


@pytest.mark.parametrize("mapped", [S.MOST_MAPPED, 0])
def test_places_by_maps_or_by_a_join(spark, monkeypatch, mapped):
    monkeypatch.setattr(S, "MOST_MAPPED", mapped)
    monkeypatch.setattr(S, "FREQUENT", 4)
    rows = corpus(11)
    got = {r[0]: (r[1], r[2], r[3]) for r in S.dedup(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, g string").repartition(3)).collect()}
    assert got == brute(rows)


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(9)
    p, q = ([f"{x}{rng.randrange(99)}" for _ in range(30)] for x in "pq")
    rows = [(1, p), (2, q), (2, p + q), (2, p + q), (3, q[:25]), (2, ["few"]), (None, p)]
    got = sorted((str(r[0]), r[1], r[2]) for r in S.dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect())
    # of id 2, q starts at word 0 of one text and at word 30 of the other
    assert got == [("1", 30, 0), ("2", 1, 0), ("2", 30, 0), ("2", 60, 60), ("2", 60, 60), ("3", 25, 25), ("None", 30, 0)]


def test_a_passage_of_every_document(spark, monkeypatch):
    """Excerpts of one passage that all documents hold are passed on as repeats, by the scan or in the order of their route."""
    monkeypatch.setattr(S, "FREQUENT", 4)
    monkeypatch.setattr(S, "CHUNK", 3)
    shared = " ".join(f"s{k}" for k in range(40))
    rows = [(i, f"a{i} b{i} {shared} c{i}") for i in range(600)]
    for mapped in (S.MOST_MAPPED, 0):
        monkeypatch.setattr(S, "MOST_MAPPED", mapped)
        got = {r["doc_id"]: r["n_removed"] for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)).collect()}
        assert got[0] == 0 and all(got[i] == 40 for i in range(1, 600))
