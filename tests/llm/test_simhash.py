import random

import pytest
import xxhash

from shutterlake.llm import simhash


def brute(rows):
    fps = {}
    for i, text in rows:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sh = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return fps, components(fps)


def components(fps):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocab = ["w%d" % i for i in range(40)]
    base = [" ".join(rng.choices(vocab, k=60)) for _ in range(6)]
    rows = [(i, None) for i in (0, 3)] + [(5, ""), (6, " \n\t"), (7, "One"), (8, "one two"), (9, "ÉÀ one TWO")]
    for i in range(10, 60):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows.append((100, "x y " * 40_000))
    fps, label = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.selectExpr("doc_id", "text", "1 AS fp", "2 AS id", "3 AS key")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (fps[i], label[i]) for i in fps}
    assert {r.doc_id for r in simhash.kept_one(df).collect()} == set(label.values())


@pytest.mark.parametrize("crowded", [0, 4])
def test_crowded_keys_lose_no_link(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(2)
    fps = {}
    for g in range(4):
        centre = rng.getrandbits(64)
        for j in range(25):
            v = centre
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            fps[g * 100 + j] = v
    signed = lambda v: v if v < 1 << 63 else v - (1 << 64)
    distinct = sorted({signed(v) for v in fps.values()})
    edges = simhash.links(spark.createDataFrame([(v,) for v in distinct], "fp long"))
    found = {v: v for v in distinct}
    rows = edges.collect()
    changed = True
    while changed:
        changed = False
        for a, b in rows:
            low = min(found[a], found[b])
            if found[a] != low or found[b] != low:
                found[a] = found[b] = low
                changed = True
    want = components({v: v & (1 << 64) - 1 for v in distinct})
    assert found == want


def test_empty_and_repeated(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, None)], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 3
    assert simhash.kept_one(df).count() == 2
