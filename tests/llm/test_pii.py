import hashlib
import random
import re

from shutterlake.llm import pii
from shutterlake.llm.op09_pii import op9_personal_data

FIND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(FIND.items()) for m in re.finditer(p, text or "") if good(k, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_base_matches_brute_force(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "x.y+z@h-1.example.com", "a@b", "@", "a@b.c%d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (555) 010-9999", "+12", "+1 234 567 890 1", "++4 4", "é", "😀", " ", "\n", "word", "7", "-", ".", "99999999999999999999999"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(1, 14)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "9" * 20_000), (1003, "a" * 30_000 + "@" + "b." * 3000), (1004, "1 " * 5000), (1005, "x@y.z " * 400), (5, rows[5][1]), (None, "a@b.c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS id", "3 AS th")
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in pii.personal_data(df, min_support=10_000).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", pii.told(pii.F.col("base")).alias("base")).collect())
    want = []
    for i, t in rows:
        b = brute(t)
        want.append((str(i), *(sum(x.startswith(k + ":") for x in b) for k in FIND), ",".join(b)))
    assert got == sorted(want)


def test_contexts_find_what_base_misses(spark):
    rows = [(i, f"some words here then reach me at user{i}@mail.example and more") for i in range(8)]
    rows += [(20, "they said reach me at jo42(at)mail, or not"), (21, "at 7 we met me at noon"), (22, "the door 9 is shut")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df, min_support=5).select("doc_id", "base", "n_email", pii.told(pii.F.col("spans")).alias("spans")).collect()}
    at = rows[8][1].index("jo42")
    assert got[20].spans == f"email:{at}:{at + len('jo42(at)mail')}" and got[20].n_email == 0
    assert got[21].spans == "" and got[22].spans == ""
    assert got[3].spans == "email:" + ":".join(map(str, (rows[3][1].index("user3"), rows[3][1].index(" and"))))


def test_query_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_personal_data(spark, sf).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(","))if base else True
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rare_contexts_stay_beside_many_seeds(spark):
    rows = [(i, f"mail w{i % 40} to x{i}@mail.example") for i in range(6000)]
    rows += [(10_000 + i, f"the rare context user{i}@mail.example") for i in range(6)] + [(20_000, "the rare context jo42(at)mail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).select("doc_id", pii.told(pii.F.col("spans")).alias("spans")).collect()}
    assert got[20_000] == "email:17:29" and got[10_000] == "email:17:35"


def test_contexts_of_adjacent_matches_and_long_words(spark):
    long = "x" * 300
    texts = ["in 2020 contact jo42(at)mail", "a@b.c d@e.f g@h.i j@k.l", "see 1.2.3.4,5.6.7.8,9.9.9.9,4.4.4.4 now 7", f"one {long} {long} a7", "b1 b2", "", "7 8", "p\n\nq  r5 s6 é7 t8(x@y.z)"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = pii._spans(df).where("kind >= 0").collect()
    assert len(rows) > 20
    for r in rows:
        start = r.start if r.kind < 4 else texts[r.id].rindex(" ", 0, r.start) + 1 if " " in texts[r.id][: r.start] else 0
        before = texts[r.id][: r.start].lower().split()
        if r.kind < 4 or start == r.start:
            assert (r.l1, r.l2) == (tuple(before[-2:]) if len(before) > 1 else ("", "")), (texts[r.id], r)


def test_word_after_another_candidate_is_found(spark):
    rows = [(i, f"in 2020 contact user{i}@mail.example") for i in range(8)] + [(20, "in 2020 contact jo42(at)mail")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.told(pii.F.col("spans")).alias("spans")).collect()}
    assert got[20] == "email:16:28"


def added(docs, min_support, min_score, rounds):
    """Spans by the definition, one text and one word at a time."""
    slots, totals, seeds = [], {}, {}
    for i, text in docs:
        low = (text or "").lower()
        w = low.split()
        for a, b in zip(w, w[1:-1]):
            totals[a, b] = totals.get((a, b), 0) + 1
        taken = [tuple(map(int, x.split(":")[1:])) + (x.split(":")[0],) for x in brute(text)]
        for s, e, kind in taken:
            before = low[:s].split()
            if len(before) > 1:
                slots.append((tuple(before[-2:]), text[s:e], i, s, e, None))
            seeds[text[s:e]] = min(seeds.get(text[s:e], 9), list(FIND).index(kind))
        for m in re.finditer(r"\S+", text or ""):
            if not re.search("[0-9@]", m.group()):
                continue
            core = re.sub(r"""[\"')\]>}.,;:!?]*$""", "", re.sub(r"""^[\"'(\[<{=]*""", "", m.group()))
            s = m.start() + len(m.group()) - len(re.sub(r"""^[\"'(\[<{=]*""", "", m.group()))
            e, before = s + len(core), low[: m.start()].split()
            if core and len(before) > 1 and all(e <= x or s >= y for x, y, _ in taken):
                slots.append((tuple(before[-2:]), core, i, s, e, "word"))
    score = {v: (1.0, k) for v, k in seeds.items()}
    accepted = {}
    for _ in range(rounds):
        accepted = {}
        for p in {x[0] for x in slots}:
            filled = [x[1] for x in slots if x[0] == p]
            known = [v for v in filled if score.get(v, (0, 0))[0] >= min_score]
            total = sum(score[v][0] for v in known) / max(totals.get(p, 1), 1)
            if len(set(known)) >= min_support and min(1.0, total) >= min_score:
                by = {}
                for v in known:
                    by[score[v][1]] = by.get(score[v][1], 0) + score[v][0]
                accepted[p] = (min(1.0, total), max(by, key=lambda k: (by[k], -k)))
        for v in {x[1] for x in slots} - set(seeds):
            own = [accepted.get(x[0]) for x in slots if x[1] == v]
            hits = [x for x in own if x]
            if hits:
                score[v] = (sum(x[0] for x in hits) / len(own), max(hits, key=lambda x: (x[0], -x[1]))[1])
            else:
                score.pop(v, None)
    out = {i: set(brute(t)) for i, t in docs}
    for p, _, i, s, e, word in slots:
        if word and p in accepted:
            out[i].add(f"{list(FIND)[accepted[p][1]]}:{s}:{e}")
    return out


def test_added_spans_match_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(40):  # seeds under one pattern, and hidden values under the same and a second one
        rows.append((i, f"please write to a{i % 9}@mail.example today or call 7\n" * 9))
        rows.append((100 + i, f"please write to h{i % 12}(at)mail today, " * 2))
        rows += [(200 + i, f"or ask at h{i % 12}(at)mail then")] * (i < 20)
        rows += [(300 + i, f"or ask at (x{i % 15}-at-host), room {i % 3}")] * (i < 3)
        rows.append((400 + i, f"seen on host 10.0.0.{i % 20} and on host n{i % 11} at {rng.randrange(24)}"))
        rows.append((500 + i, " ".join(rng.choices(["page 4", "in room 12", "to write", "at 5", "on host", "x@", "b2b"], k=6))))
    rows.append((900, None))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (1, 2, 3):
        got = {r.doc_id: set(r.spans.split(",")) - {""} for r in pii.personal_data(df, rounds=rounds).select("doc_id", pii.told(pii.F.col("spans")).alias("spans")).collect()}
        assert got == added(rows, 5, 0.5, rounds)
    # What the first round finds induces the pattern of the second.
    assert got[300] and not [x for x in added(rows, 5, 0.5, 1)[300]]
