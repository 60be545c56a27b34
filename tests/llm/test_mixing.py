import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shutterlake.llm import mixing


def shares(words, top=3):
    """Targets by repeated resharing, straight from their description."""
    weight = [(1, 2, 3)[i % 3] for i in range(len(words))]
    out, total = [0.0] * len(words), float(sum(words))
    open_ = set(range(len(words)))
    while open_:
        rest = total - sum(out[i] for i in range(len(words)) if i not in open_)
        by = sum(weight[i] for i in open_)
        for i in open_:
            out[i] = rest * weight[i] / by
        above = {i for i in open_ if out[i] > top * words[i] + 1e-9}
        if not above:
            return out
        for i in above:
            out[i] = float(top * words[i])
        open_ -= above
    return out


def test_targets():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([0, 1, 5, 100, 1000, 30000]) for _ in range(rng.randrange(1, 9))]
        assert all(abs(a - b) < 1e-6 * max(1, b) for a, b in zip(mixing.targets(words), shares(words), strict=True))


def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 400))), rng.choice(["a", "a", "a", "b", "é", None]), 1) for i in range(150)]
    rows += [(200, None, "a", 1), (201, " \n ", "tiny", 1), (202, "one two three", "tiny", 1), (203, "x y " * 3000, "b", 1), (5, *rows[5][1:]), (None, "no id here", "a", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, n long")


def test_taken(spark):
    rows, df = docs(spark)
    got = mixing.taken(df).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.taken(df.repartition(7)).collect()))
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, t, *_ in rows)
    by = defaultdict(lambda: [0, 0.0, 0])
    names = sorted({s for _, _, s, _ in rows if s is not None}) + [None]
    words = [sum(len((t or "").split()) for _, t, s, _ in rows if s == name) for name in names]
    want = dict(zip(words, shares(words), strict=True))
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        assert abs(r.target - want[r.source_size]) < 1e-6
        by[r.source_size][0] += r.taken
    for size, (took, *_) in by.items():
        assert abs(took - want[size]) <= max(0.05 * want[size], 3 * 64)


def test_mixed_texts_hold_what_is_taken(spark):
    rows, df = docs(spark)
    df = df.where("doc_id is null or doc_id <> 5")
    want = {r.doc_id: r.taken for r in mixing.taken(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = {r.doc_id: len(r.text.split()) for r in out.collect()}
    assert got == {k: v for k, v in want.items() if v}


def frame(spark, rows):
    first, out = 0, []
    for no, n, slots in rows:
        out.append((no, n, slots, first))
        first += slots
    return spark.createDataFrame(out, "no int, n long, slots long, first long")


def test_every_block_once_a_pass(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_ROWS", 50)
    plan = mixing.MixPlan(shard_slots=100)
    rows = mixing._slots(frame(spark, [(0, 57, 171), (1, 2, 3), (2, 0, 0), (3, 400, 130)]), plan).collect()
    seen = Counter((r.no, r.turn, r.block) for r in rows)
    assert set(seen.values()) == {1} and Counter(r.no for r in rows) == {0: 171, 1: 3, 3: 130}
    assert {b for no, t, b in seen if (no, t) == (0, 0)} == set(range(57))
    assert sorted(r.slot for r in rows) == list(range(304))


def test_shard_counts_vary_like_draws(spark):
    """Counts of a source over shards: the mean is its share, and the variance that of a draw, not of a fixed part."""
    plan = mixing.MixPlan(shard_slots=100)
    rows = mixing._slots(frame(spark, [(0, 9000, 10_000), (1, 9000, 5000), (2, 9000, 5000)]), plan).collect()
    counts = Counter((r.slot // 100, r.no) for r in rows)
    for no, share in ((0, 0.5), (1, 0.25), (2, 0.25)):
        each = [counts[s, no] for s in range(200)]
        assert sum(each) == 20_000 * share
        variance = sum((x - 100 * share) ** 2 for x in each) / 200
        assert 0.6 < variance / (100 * share * (1 - share)) < 1.5


def test_taken_matches_blocks_by_hand(spark):
    """What is taken of each document, word by word, from the slots of its source's blocks."""
    rows, df = docs(spark)
    plan = mixing.MixPlan(block=16)
    sized = mixing._sized(df, "doc_id", "text", "source")
    sources = mixing._sources(sized, plan)
    times = Counter((r.no, r.block) for r in mixing._slots(sources, plan).collect())
    of = {r.source: (r.no, r.n) for r in sources.collect()}
    pieces = mixing._pieces(sized, sources, plan).collect()
    words, want = defaultdict(set), Counter()
    for r in pieces:
        for w in range(r.lo, r.lo + (r.n or 0)):
            words[r.no, r.block].add((r.bucket, r.place, w))
            want[r.id, r.size] += times[r.no, r.block]
    # Blocks hold 16 words each, and every word of a source lies in one of them.
    for name, (no, n) in of.items():
        sizes = [len(words[no, b]) for b in range(n)]
        assert sum(sizes) == sum(len((t or "").split()) for _, t, s, _ in rows if s == name)
        assert all(x == 16 for x in sizes[:-1]) and (not sizes or 0 < sizes[-1] <= 16)
    got = Counter()
    for r in mixing.taken(df, plan=plan).collect():
        got[r.doc_id, r.size] += r.taken
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_clashing_names_and_one_source_a_row(spark):
    rows, df = docs(spark)
    extra = [c for c in ("row", "own", "body", "parts", "hash", "id", "mix", "w", "of", "__h")]
    wide = df.where("doc_id is not null and doc_id <> 5").select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(extra)))
    out = mixing.mixed(wide).collect()
    assert out and all(r[c] == f"x{i}" for r in out for i, c in enumerate(extra))
    single = df.where("doc_id < 100 and doc_id <> 5").withColumn("source", F.col("doc_id").cast("string"))
    got = mixing.taken(single).collect()
    assert len(got) == 99 and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.shard_counts(df).groupBy("shard").agg(F.sum("slots").alias("n")).count() >= 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(df).count() == 0 and mixing.mixed(df).count() == 0
