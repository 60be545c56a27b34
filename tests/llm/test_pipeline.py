import random

import corpus_pipeline
from pyspark.sql import functions as F

from shutterlake.llm import bands, simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.groupBy("doc_id").count().where("count > 1").isEmpty()
            assert docs.where(F.length("text") != F.col("n_chars")).isEmpty()
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.select(*again.columns).collect()))


def test_near_dedup_stage_drops_edited_copies(spark, monkeypatch):
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(2000)]
    rows, texts = [], {}

    def add(i, words):
        texts[i] = words
        rows.append((i, " ".join(words)))

    for i in range(60):
        a = rng.choices(vocab, k=rng.choice([60, 120, 300]))
        b = list(a)
        for j in rng.sample(range(len(a)), rng.randrange(1, len(a) // 30 + 1)):
            b[j] = rng.choice(vocab)
        add(i, a)
        add(1000 + i, b)
    base = rng.choices(vocab, k=200)
    for i in range(100):  # a crowd: like the base, less like each other
        c = list(base)
        for j in rng.sample(range(200), rng.randrange(1, 5)):
            c[j] = rng.choice(vocab)
        add(3000 + i, c)
    rows += [(5000, None), (5001, ""), (None, "w1 w2 w3 w4 w5 w6 w7"), (5002, "w1"), (5003, "W1 ")]

    def shingles(w):
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    sets = {i: shingles(w) for i, w in texts.items()}
    label = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    want = set(label.values()) | {5000, None, 5002}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, SF).collect()}
    assert got == want and len(want) < 130
    assert len({r.doc_id for r in simhash.kept_one(docs).collect()}) > len(want) + 50, "the old stage kept these"
    monkeypatch.setattr(bands, "CROWDED", 4)
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, SF).collect()} == want


def test_stages_take_odd_tables(spark, tmp_path):
    """Null, empty and very long texts, null ids, repeated rows, extra columns of clashing names, and no rows at all."""
    rng = random.Random(7)
    vocab = ["w%d" % i for i in range(500)]
    prose = lambda n: "\n".join(" ".join(rng.choices(vocab, k=12)) + "." for _ in range(n))
    rows = [(i, prose(6), "en", "web", 0) for i in range(12)] + [(20, None, None, None, 0), (21, "", "en", "web", 0), (22, " \n\t", "en", None, 0), (23, prose(4000), "en", "long", 0), (None, prose(5), "en", "web", 0)]
    rows += [rows[3], rows[3]]
    extra = ("row", "hash", "__row", "__w", "parts", "h", "gram", "node", "key", "own", "body")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(i).alias(c) for i, c in enumerate(extra)))
    for empty in (False, True):
        table = docs.where("false") if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            out.write.parquet(str(tmp_path / f"{name}-{empty}"))
            table = spark.read.parquet(str(tmp_path / f"{name}-{empty}"))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert table.columns == docs.columns
                assert table.where(" OR ".join(f"`{c}` <> {i}" for i, c in enumerate(extra))).isEmpty()
        assert table.isEmpty() == empty
    assert table.sparkSession.read.parquet(str(tmp_path / "simhash_near_dedup-False")).where("doc_id = 3").count() == 1
