import random
from collections import Counter

import pytest

from shutterlake.llm import substrings


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((str(i), len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeéñ", k=rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(80) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s)), 2))
            parts += [s[a:b], prose(rng.randrange(0, 30))]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    rows += [(70, rows[3][1]), (70, rows[3][1]), (71, None), (72, ""), (73, "z" * 700), (74, "ab" * 300), (75, "x" * 199), (76, "q" * 200), (None, rows[5][1])]
    passage = prose(100)
    rows += [(None, f"{prose(50)} {passage} {prose(50)}"), (90, f"{prose(40)} {passage} {prose(60)}"), (None, f"{prose(20)} {shared[0]} {prose(20)}")]
    line = "a line that is common to many texts and longer than the anchors are, "
    return rows + [(100 + i, f"{prose(30)} {line} {prose(30)}") for i in range(12)]


@pytest.mark.parametrize("crowd", [2000, 2])
def test_matches_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS th", "3 AS first").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(df).collect())
    assert got == brute(rows, 200)


def test_long_texts_are_cut_into_pieces(monkeypatch):
    whole = substrings.runs_of(("abcdefgh" * 50 + "xyz" * 300).encode() * 3, 200)
    monkeypatch.setattr(substrings, "PIECE", 500)
    parts = substrings.runs_of(("abcdefgh" * 50 + "xyz" * 300).encode() * 3, 200)
    assert whole[3].sum() == parts[3].sum()


def test_merged_transforms_find_the_same_repeats():
    rng = random.Random(3)
    for _ in range(20):
        strings = ["".join(rng.choices("ab", k=rng.randrange(0, 30))).encode() for _ in range(6)]
        for length in (1, 3, 6):
            seen = Counter(t[s : s + length] for t in strings for s in range(len(t) - length + 1))
            want = sum(n for n in seen.values() if n > 1)
            assert substrings.bwt_repeats([strings[:2], strings[2:3], strings[3:]], length) == want


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
