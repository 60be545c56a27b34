import random
import re
from collections import Counter

from shutterlake.llm import quality
from shutterlake.llm.op01_quality import op1_quality_rules


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def test_base_matches_brute_force(spark):
    rng = random.Random(1)
    parts = ["the", "cat", "é😀", "a|b", "##", " ", "\t", "\n", "\n\n", "one two three four five six", "\x0b", " "]
    rows = [(i, rng.choice(["", " "]).join(rng.choices(parts, k=rng.randrange(0, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "same words again and " * 8000), (904, "word"), (5, rows[5][1]), (None, "x " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS kept", "1 AS n_words", "2 AS __h", "3 AS __w", "4 AS __text", "5 AS __row")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted(map(str, (tuple(r) for r in quality.judged(df).select(*cols).collect())))
    assert got == sorted(str((i, *brute(t))) for i, t in rows)


def test_lines_and_verdict(spark):
    good = "This is a plain sentence with quite a few words in it.\nAnd another line follows here to make it longer."
    nav = "Home | About | News | Contact | Help | Search"
    rows = [(1, good), (2, good + "\n" + nav), (3, nav + "\n" + nav.replace("Home", "Start") + "\nShort text of only a few more words here now."), (4, good + "\nAccept all cookies and read our privacy policy"), (5, "WOW!! BUY!! NOW!! " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "length(text) AS n_chars", "'en' AS kept")
    out = {r.doc_id: r for r in quality.clean(df).collect()}
    assert set(out) == {1, 2, 4}
    assert all(r.text == good and r.n_chars == len(good) and r.kept == "en" for r in out.values())


def test_line_rules(spark):
    plain = "A plain line of some words, with a mark at its end."
    bad = [
        "see http://a.example and https://b.example and www.c.example now", "And this goes on ...", "And so does this…  ", "word " * 80, "BUY THIS NOW OR NEVER BUY IT AGAIN", "Home | About | News | Help", "All Rights Reserved.", "!! a !! b !!",
        "### $$$ %%%",
    ]
    good = [plain, "NATO and the UN met in 1999.", "see http://a.example or www.b.example", "short", "", "LOUD", "word " * 80 + "end."]
    df = spark.createDataFrame([(x,) for x in bad + good], "line string")
    got = {r.line: r.fails for r in df.select("line", quality.line_fails(quality.F.col("line"), quality.QualityRules()).alias("fails")).collect()}
    assert [x for x in bad if not got[x]] == [] and [x for x in good if got[x]] == []
    extra = spark.createDataFrame([(1, plain)], "doc_id long, text string").selectExpr("*", "2 AS __h", "3 AS __in", "4 AS __row", "5 AS __body")
    assert quality.clean(extra, rules=quality.QualityRules(min_words=1)).collect() == extra.collect()


def test_query_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    sound = [r for r in got if r.quality == 1 and not r.base_failed]
    assert sound and all(r.kept for r in sound)
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
