import random

import pytest

from lectern.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(i, rng.choice("abé "))
        elif kind == 1 and i < len(s):
            del s[i]
        elif i < len(s):
            s[i] = rng.choice("abxyz")
    return "".join(s)


def test_banded_distance_as_the_full_table():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 3, 8, 30, 90])))
        b = edited(rng, a, rng.randrange(6))
        for most in (1, 2, 3):
            assert L.within(a, b, most) == (distance(a, b) <= most), (a, b, most)


def test_segments_miss_no_pair():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("ab ") for _ in range(rng.randrange(L.MIN_CHARS, 60)))
        b = edited(rng, a, rng.randrange(1, 3))
        if min(len(a), len(b)) < L.MIN_CHARS or a == b:
            continue
        assert L.verify([(0, 1, a), (0, 2, b)], True) == {1: 1, 2: 1}
        assert len(L.compare([(0, 1, 1, True, a), (0, 2, 2, False, b)], True)) == 1
        h = L.SegmentHash()
        h.load([a, "x" * 30, b])
        index, probe = (set(zip(*map(list, f()))) for f in (h.index, h.probes))
        keys = [{k for r, k in index if r == n} for n in (0, 2)]
        more = [{k for r, k in index | probe if r == n} for n in (0, 2)]
        assert keys[0] & more[1] or keys[1] & more[0]


POS_BITS = 24


def brute(rows):
    """place of each line that isn't blank -> (place of its class's first line, to how many other texts it is linked); places are id * 2^24 + number."""
    lines = [(i << POS_BITS | n, x.strip(" \t\n\r\x0b\x0c")) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    lines = [(k, x) for k, x in lines if x]
    alike = lambda x, y: x == y or min(len(x), len(y)) >= L.MIN_CHARS and distance(x, y) <= L.EDITS
    root = {k: k for k, _ in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in lines:
        for b, y in lines:
            if b > a and alike(x, y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {k: (find(k), len({y for _, y in lines if y != x and alike(x, y)})) for k, x in lines}


@pytest.mark.parametrize("block", [3, 128])
def test_as_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", block)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.choice([10, 23, 24, 26, 40]))).strip() for _ in range(12)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.randrange(4)) for _ in range(rng.randrange(1, 6)))) for i in range(22)]
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, base[2] + "\n" + base[2]), (104, "z" * 20000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, k1 string")
    out = L.line_classes(df)
    got = {r["doc_id"]: r for r in out.collect()}
    want = brute(rows)
    assert set(got) == {i for i, _ in rows}
    assert {i << POS_BITS | n: (c["doc"] << POS_BITS | c["line"], k) for i, r in got.items() for n, c, k in zip(r["lines"], r["classes"], r["links"])} == want
    dropped = {r["doc_id"]: r for r in L.drop_lines(df, out).collect()}
    for i, t in rows:
        gone = {k & (1 << POS_BITS) - 1 for k, (c, _) in want.items() if k >> POS_BITS == i and c != k}
        assert got[i]["n_removed"] == len(gone)
        assert got[i]["removed"] == sorted(gone)
        assert dropped[i]["text"] == (t if not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)) and dropped[i]["k1"] == "k"


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_classes(df).count() == 0


def test_short_lines_by_equality(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde é") for _ in range(n)).strip() for n in (1, 2, 5, 10, 22, 23, 24, 26, 40)]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(1, 6)))) for i in range(25)]
    rows += [(103, "All rights reserved.\nLes.\n Les.\n\nAll rights reserved!"), (104, "Les.\nlast")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.line_classes(df)
    assert {r["doc_id"] << POS_BITS | n: (c["doc"] << POS_BITS | c["line"], k) for r in got.collect() for n, c, k in zip(r["lines"], r["classes"], r["links"], strict=True)} == brute(rows)
    texts = {r["doc_id"]: r["text"] for r in L.drop_lines(df, got).collect()}
    assert texts[103] == "All rights reserved.\nLes.\n\nAll rights reserved!" and texts[104] == "last"


def test_rows_of_one_id_and_rows_without(spark):
    first = "this is the first line that is long enough to count"
    rows = [(1, first), (2, "another quite long line that stands here alone\n" + first), (2, "keep me zero\nunique content that must not vanish at all"), (2**40 + 5, "x" * 30), (-(2**62), "y" * 30 + "\n" + "x" * 29 + "z"),
            (5, "Les."), (5, "Les."), (6, "Les.\nLes."), (None, first), (None, first)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.line_classes(df)
    texts = sorted((str(r["doc_id"]), r["text"]) for r in L.drop_lines(df, got).collect())
    assert texts == sorted([("1", first), ("2", "another quite long line that stands here alone"), ("2", rows[2][1]), (str(2**40 + 5), ""), (str(-(2**62)), rows[4][1]), ("5", "Les."), ("5", "Les."), ("6", ""),
                            ("None", first), ("None", first)])
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(["1", "2", "2", str(2**40 + 5), str(-(2**62)), "5", "6", "None", "None"])
    assert got.where("doc_id is null and n_lines = 1 and size(lines) = 0 and n_removed = 0").count() == 2


def test_ties_that_no_link_confirms_tie_nothing(spark, monkeypatch):
    """Thousands of lines share their first segment, and hundreds of them their class: what is dealt grows with ties and with links, not with the square of either."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    core = word(40)
    lines = ["the same " + word(18) for _ in range(2_000)] + [core[:20] + c + core[21:] for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"] + [core]
    dealt, real = [], L.blocked

    def blocked(rows, group, *fields):
        out = real(rows, group, *fields).persist()
        dealt.append((group, out.count()))
        return out

    monkeypatch.setattr(L, "blocked", blocked)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.line_classes(df).collect()}
    assert all(got[i]["classes"][0]["doc"] == i and got[i]["n_links"] == 0 for i in range(2_000))
    assert all(got[i]["classes"][0]["doc"] == 2_000 and got[i]["n_links"] == 26 for i in range(2_000, 2_027))
    assert dict(dealt)["class"] == 27 and dict(dealt).get("key", 0) <= 2_100 * -(-2_000 // L.BLOCK)
