import math
import random

from shutterlake.llm import language, token_counts
from shutterlake.llm.op04_language import op4_language_id
from shutterlake.llm.op06_token_counts import op6_token_counts

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(i, t, l, 1) for i, (t, l) in enumerate([("der die das und ist nicht", "de"), ("the and of to in is", "en")] * 20)] + [(90, None, "de", 1), (91, "12 !!", "en", 1), (92, "", None, 1), (93, "the of and " * 20_000, None, 1), (None, "the", None, 1)], "doc_id long, text string, lang string, score int")
    from pyspark.sql import functions as F

    model = language.fit(df, F.xxhash64("doc_id"))
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 90, 91, 92, 93, None)] == ["de", "en", "und", "und", "und", "en", "en"]
    nothing = language.fit(df.where("false"), F.xxhash64("doc_id"))
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.where("false"), model).count() == 0


def plain_vector(text, idf):
    """TF-IDF of byte n-grams of 1 to 3, one n-gram at a time."""
    data = b" " + bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()) + b" "
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            code = int.from_bytes(data[i : i + n], "big") + (n << 24)
            place = code * 2654435761 % 2**32 >> 20
            counts[place] = counts.get(place, 0) + 1
    v = {p: math.log1p(c) * idf[p] for p, c in counts.items()}
    length = math.sqrt(sum(x * x for x in v.values()))
    return {p: x / length for p, x in v.items()}


def test_language_matches_plain_centroids(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    words = {"de": "der die das und nicht über schön mit".split(), "en": "the and of with not over fine that".split(), "fr": "le la les et avec où très été".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randrange(4, 30))), lang) for i, lang in enumerate(rng.choices(list(words), k=90))]
    rows += [(5, *rows[5][1:]), (200, "le der the 12", None), (201, "?? 7", "de"), (202, "xyz qq", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS rejected", "2 AS id", "3 AS place")
    idf, langs, centroids, least = model = language.fit(df.where("doc_id < 70"), F.xxhash64("doc_id"))
    learnt = [t for i, t, lang in rows if i < 70 and lang]
    seen = {}
    for t in learnt:
        for p in plain_vector(t, [1.0] * language.DIMS):
            seen[p] = seen.get(p, 0) + 1
    for p in range(language.DIMS):
        assert abs(idf[p] - (math.log((1 + len(learnt)) / (1 + seen.get(p, 0))) + 1)) < 1e-5
    assert all(abs(sum(float(x) ** 2 for x in c) - 1) < 1e-4 for c in centroids) and sorted(set(langs)) == ["de", "en", "fr"]
    got = language.predict(df, model).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        if not any(c.isalpha() for c in texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = plain_vector(texts[r.doc_id], idf)
        cosines = [sum(x * float(c[p]) for p, x in v.items()) for c in centroids]
        best = max(range(len(cosines)), key=lambda j: cosines[j])
        assert abs(r.score - cosines[best]) < 1e-4 and (r.lang_pred == langs[best] or abs(sorted(cosines)[-2] - cosines[best]) < 1e-5)
        assert r.rejected == (cosines[best] < least[best]) or abs(cosines[best] - least[best]) < 1e-5


def plain_count(model, word):
    s = token_counts.MARK + word
    best, n = [0.0], [0]
    for j in range(1, len(s) + 1):
        options = [(best[i] + model.score[s[i:j]], i, n[i] + 1) for i in range(j) if s[i:j] in model.score]
        b = len(s[j - 1].encode())
        options.append((best[j - 1] + b * model.byte, j, n[j - 1] + b))
        top = max(options, key=lambda o: (o[0], -o[1]))
        best.append(top[0])
        n.append(top[2])
    return n[-1]


def test_counts_match_plain_programming(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.Unigram.of(path)
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdeéthین😀-", k=rng.randrange(1, 14))) for _ in range(300)] + ["x" * 500, "international", "inter", "in"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(40)] + [(50, None), (51, " \t\n"), (52, "one\ntwo"), (52, "one\ntwo"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS id")
    got = sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(df, path).collect())
    split = lambda t: (t or "").split()
    assert got == sorted((str(i), len(split(t)), sum(plain_count(model, w) for w in split(t))) for i, t in rows)
    assert math.isfinite(model.byte)
    assert op6_token_counts(spark, SF).count() == 200
