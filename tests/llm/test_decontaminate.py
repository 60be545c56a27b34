import random
import re

import pytest
from pyspark.sql import functions as F

from shutterlake.llm import decontaminate as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choices(["Alpha", "beta,", "ñu", "d4", "E-f", "x"], k=n))
    items = [(i, prose(rng.randrange(0, 30))) for i in range(12)] + [(50, None), (51, "?!"), (52, "Lone"), (53, "two words"), (3, "repeated item id here"), (54, "two words")]
    docs = [(i, " ".join([prose(20), rng.choice(items)[1] or "", prose(15), rng.choice(["", "two  WORDS", "lone"])])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "filler " * 50_000 + "two words"), (5, docs[5][1]), (None, "a lone one")]
    return docs, items


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_matches_brute_force(spark, tables, limit):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS gram", "3 AS items", "4 AS n_words", "5 AS __w", "6 AS __row")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n")
    got = D.hits(d, b, broadcast_bytes=limit).select("doc_id", "n_words", F.size(D.hit_places(F.col("spans"))).alias("n_hit"), "item_ids").collect()
    assert sorted(((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids)) for r in got), key=str) == brute(docs, items)


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before this. {item.upper()} and after!"), (2, "clean text"), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS spans")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in D.without_contaminated(d, b).collect()} == {2, 3}
    out = {r.doc_id: r.text for r in D.without_spans(d, b).collect()}
    assert out == {1: "Before this. and after!", 2: "clean text", 3: None}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.spans, r.item_ids) for r in D.hits(d, b).collect()] == [(2, [], [])]
    assert D.without_contaminated(d, b).count() == 1
    assert D.hits(d.where("false"), d.selectExpr("doc_id AS item_id", "text")).count() == 0
