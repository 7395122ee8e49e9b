import random

import pytest

from lectern.llm import minhash


def brute(rows, k, percent):
    """Components over all pairs of full sets."""
    sets = {}
    for i, text in rows:
        w = [x.decode() for x in (text or "").encode().translate(minhash.LOWER).split()]
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_as_all_pairs(spark, k, percent):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 150]))]
        for _ in range(rng.choice([1, 5, 30])):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in text]
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "x " * 5000)]
    df = spark.createDataFrame([(i, t, 1, b"s") for i, t in rows], "doc_id long, text string, id int, key binary")
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_no_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def counted(monkeypatch):
    """Rows that each call of Sets.dealt deals."""
    rows, real = [], minhash.Sets.dealt

    def dealt(self, wants, fields):
        out = real(self, wants, fields).persist()
        rows.append(out.count())
        return out

    monkeypatch.setattr(minhash.Sets, "dealt", dealt)
    return rows


def test_a_family_of_thousands_deals_no_pairs(spark, monkeypatch):
    rows = counted(monkeypatch)
    text = " ".join(f"w{i}" for i in range(59))
    df = spark.createDataFrame([(i, f"{text} z{i}") for i in range(5_000)], "doc_id long, text string")
    got = minhash.near_duplicates(df, 3, 85).agg({"component_id": "max", "n_shingles": "max"}).first()
    assert tuple(got) == (0, 58) or tuple(got) == (58, 0)
    assert sum(rows) < 5_000 * 8  # a set a head, not a set a block of the family


def test_ties_that_no_link_confirms_tie_nothing(spark, monkeypatch):
    """Texts that share half of their words with each of two neighbours: a chain of ties, of which none is a link."""
    rows = counted(monkeypatch)
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30)) + " " + " ".join(f"w{i + 1}x{k}" for k in range(30))) for i in range(2_000)], "doc_id long, text string")
    got = minhash.near_duplicates(df, 3, 85)
    assert got.where("component_id <> doc_id").isEmpty()
    assert sum(rows) < 2_000 * 30


def test_rows_of_one_id_and_rows_without(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (5, a + " z"), (5, b + " z"), (5, b + " z"), (6, c), (7, c + " y"), (7, None), (None, a), (None, a), (None, None)]
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == [("1", 38, 1, True), ("2", 38, 1, False), ("5", 39, 1, False), ("6", 38, 6, True), ("7", 0, 6, False), ("None", 0, None, True), ("None", 38, None, True), ("None", 38, None, True)]
