"""Personal data: base patterns, and bootstrapped contextual extraction; native columns only.

Base spans (email, ip, card, phone) are leftmost, non-overlapping matches per
kind that pass a check of their digits. They seed the bootstrap: the two words
before a span are a lexical pattern, and what fills its slot (a base span, or a
word with a digit or @ that touches none) is an instance. Each round scores the
graph of patterns and instances from both sides:

* a pattern's score is the sum of the scores of its known instances over all
  occurrences of its two words, whatever follows; it is accepted with
  ``min_support`` distinct known values and a score of ``min_score``;
* a seed scores 1; any other instance scores the mean, over all its occurrences
  in whatever context, of the scores of accepted patterns; it is known from
  ``min_score`` on, and then induces further patterns in the next round.

After ``rounds`` rounds, the words in the slots of accepted patterns are spans
of the kind that most of the pattern's score comes from.

Regular expressions carry possessive quantifiers and look-behinds where these
give the same matches and keep long runs linear. Positions are code points.

Defined cases: null texts are empty and have no spans; rows of one id and text
are read once and each get a row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shutterlake import scratch
from shutterlake.llm.text import ascii_lower, words_of

KINDS = ("email", "ip", "card", "phone")
_WORD, _SEPARATOR = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
#: The last two words; the second may touch what follows.
_TWO_WORDS = rf"({_WORD}++){_SEPARATOR}++({_WORD}++){_SEPARATOR}*+$"
_FIND = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # A word with a digit or @, without the punctuation around it.
    "word": rf"(?<!{_WORD})[^\x20\x09-\x0D0-9@]*+[0-9@]{_WORD}*+",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Code points before a match that are looked at first; where they do not hold two words, all before are.
CONTEXT_CHARS = 200
#: Places of the table that tells word pairs that may be patterns from others.
MARKS = 1 << 18


def _luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, match.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))
        .when(kind == 2, F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == 3, n.between(9, 15))
        .otherwise(True)
    )


def _found(text: Column, kind: int, pattern: str) -> Column:
    """(kind, i, gap, size, match, left) of every match, in order; gap: code points since the match before, left: the two words before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _tied(matches, F.split(text, pattern, -1), kind)


def _tied(matches: Column, gaps: Column, kind: int) -> Column:
    # Bound once as z, so that a match can look at those before it.
    return F.flatten(
        F.transform(
            F.array(F.arrays_zip(matches.alias("m"), gaps.alias("g"))),
            lambda z: F.transform(
                z,
                lambda x, i: F.struct(
                    F.lit(kind).alias("kind"),
                    i.alias("i"),
                    F.length(x["g"]).alias("gap"),
                    F.length(x["m"]).alias("size"),
                    x["m"].alias("match"),
                    F.when(x["m"].isNotNull(), _left(z, x, i)).otherwise("").alias("left"),
                ),
            ),
        )
    )


def _left(z: Column, x: Column, i: Column) -> Column:
    """The end of the text before a match with its last two words: of the gap, or of two more matches and gaps, or of all before."""
    gap = F.right(x["g"], F.lit(CONTEXT_CHARS))
    one, two = F.get(z, i - 1), F.get(z, i - 2)
    near = F.right(F.concat_ws("", F.right(two["g"], F.lit(CONTEXT_CHARS)), two["m"], one["g"], one["m"], x["g"]), F.lit(CONTEXT_CHARS))
    whole = F.concat(F.array_join(F.transform(F.slice(z, 1, i), lambda y: F.concat(y["g"], y["m"])), ""), x["g"])
    # Shorter than the window, it begins with the text.
    return (
        F.when(gap.rlike(_SEPARATOR + _TWO_WORDS) | ((i == 0) & (F.length(gap) < CONTEXT_CHARS)), gap)
        .when(near.rlike(_SEPARATOR + _TWO_WORDS) | ((i <= 2) & (F.length(near) < CONTEXT_CHARS)), near)
        .otherwise(F.regexp_extract(whole, rf"(?:^|{_SEPARATOR}){_TWO_WORDS}", 0))
    )


def _spans(docs: DataFrame) -> DataFrame:
    """(id, th, kind, i, start, end, match, l1, l2, copies): base matches, candidate words (kind 4), and a row of kind -1 per document; written."""
    body = F.coalesce("text", F.lit(""))
    marker = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit("").alias("match"), F.lit("").alias("left")))
    empty = F.slice(marker, 1, 0)
    digits = body.rlike("[0-9]")
    # Without a digit there is no ip, card or phone; without either sign nothing at all.
    sets = [F.when(F.contains(body, F.lit("@")), _found(body, 0, _FIND["email"])).otherwise(empty)]
    sets += [F.when(digits, _found(body, k, _FIND[name])).otherwise(empty) for k, name in ((1, "ip"), (2, "card"))]
    sets += [F.when(F.contains(body, F.lit("+")) & digits, _found(body, 3, _FIND["phone"])).otherwise(empty)]
    sets += [F.when(body.rlike("[0-9@]"), _found(body, 4, _FIND["word"])).otherwise(empty)]
    rows = docs.select("id", F.xxhash64(body).alias("th"), F.explode(F.concat(marker, *(F.filter(s, lambda x: x["match"].isNotNull()) for s in sets))).alias("x")).select("id", "th", "x.*")
    rows = rows.select("*", *(F.regexp_extract(ascii_lower(F.col("left")), rf"(?:^|{_SEPARATOR}){_TWO_WORDS}", k).alias(f"l{k}") for k in (1, 2))).drop("left")
    once = rows.groupBy("id", "th", "kind", "i").agg(F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("match").alias("match"), F.first("l1").alias("l1"), F.first("l2").alias("l2"), F.count("*").alias("copies"))
    run = Window.partitionBy("id", "th", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(run)
    placed = once.select("*", end.alias("end")).withColumn("start", F.col("end") - F.col("size")).where(_valid(F.col("kind"), F.col("match")))
    # Candidate words lose the punctuation around them.
    lead = F.length(F.regexp_extract("match", r"^[\"'(\[<{=]*+", 0))
    core = F.regexp_extract("match", r"^[\"'(\[<{=]*+(.*?)[\"')\]>}.,;:!?]*+$", 1)
    word = F.col("kind") == 4
    return scratch.written(
        placed.select(
            "id", "th", "kind", F.when(word, F.col("start") + lead).otherwise(F.col("start")).alias("start"), F.when(word, F.col("start") + lead + F.length(core)).otherwise(F.col("end")).alias("end"),
            F.when(word, core).otherwise(F.col("match")).alias("match"), "l1", "l2", "copies",
        ),
        "spans",
    )


def _free_words(spans: DataFrame) -> DataFrame:
    """Candidate words that touch no base span."""
    order = Window.partitionBy("id", "th").orderBy("start", "kind")
    base = F.col("kind").between(0, 3)
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = spans.where("kind >= 0").select("*", before.alias("__b"), after.alias("__a"))
    return marked.where((F.col("kind") == 4) & (F.col("match") != "") & (F.coalesce("__b", F.lit(0)) <= F.col("start")) & (F.coalesce("__a", F.col("end")) >= F.col("end"))).drop("__b", "__a")


def _occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(p, total): how often the two words of each pattern p of wanted occur with a word after them."""
    w = docs.select(words_of(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 2)
    slots = w.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))).alias("p"))
    # A table of hashes leaves out nearly all pairs of words that are no pattern; the rest are summed before they
    # meet the patterns, so the join has a row a pair of words, however often a pattern occurs.
    marks = bytearray(MARKS)
    mark = F.pmod("p", F.lit(MARKS))
    bits = wanted.groupBy(F.shiftright(mark, 6).alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), mark.bitwiseAND(63).cast("int"))).alias("bits"))
    for r in bits.collect():  # MARKS / 64 rows at most
        for i in range(64):
            if r.bits >> i & 1:
                marks[r.place * 64 + i] = 1
    marked = F.substring(F.lit(bytes(marks)), mark.cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    return slots.where(marked).groupBy("p").agg(F.count("*").alias("total")).join(wanted, "p")


def _patterns(docs: DataFrame, spans: DataFrame, min_support: int, min_score: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """((l1, l2, kind) of every accepted pattern, free candidate words), both written."""
    words = scratch.written(_free_words(spans), "candidates", gathered=True)
    seeds = spans.where("kind between 0 and 3").select("l1", "l2", "match", "kind")
    filled = seeds.unionAll(words.select("l1", "l2", "match", F.lit(None).cast("int").alias("kind"))).where("l2 <> ''")
    # An instance is a value; a value that is a base span of two kinds anywhere is one of the lower.
    counted = filled.groupBy("l1", "l2", "match").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))
    counted = scratch.written(counted.select("l1", "l2", F.xxhash64("l1", "l2").alias("p"), F.xxhash64("match").alias("x"), "n", "kind"), "graph", gathered=True)
    # Only patterns of enough distinct values, known or not, can ever have the support.
    able = counted.groupBy("p", "l1", "l2").agg(F.count("*").alias("values")).where(F.col("values") >= min_support).select("p", "l1", "l2")
    able = scratch.written(able, "patterns", gathered=True)
    if able.isEmpty():
        return able.select("l1", "l2", F.lit(None).cast("int").alias("kind")), words
    named = able.join(_occurrences(docs, able.select("p").distinct()), "p", "left").select("p", "l1", "l2", F.greatest(F.coalesce("total", F.lit(1)), F.lit(1)).alias("total"))
    named = scratch.written(named, "patterns", gathered=True)
    everywhere = counted.groupBy("x").agg(F.sum("n").alias("everywhere"), F.min("kind").alias("seed"))
    edges = scratch.written(counted.join(named.select("p"), "p", "left_semi").select("p", "x", "n").join(everywhere, "x"), "edges", gathered=True)
    known = edges.select("p", "x", "n", F.col("seed").alias("kind"), F.when(F.col("seed").isNotNull(), 1.0).alias("score"))
    for step in range(rounds):
        votes = known.where(F.col("score") >= min_score).groupBy("p", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("sum"), F.count("*").alias("support"))
        summed = votes.groupBy("p").agg(F.max_by("kind", F.struct("sum", -F.col("kind"))).alias("kind"), F.sum("sum").alias("sum"), F.sum("support").alias("support"))
        scored = summed.where(F.col("support") >= min_support).join(named, "p").select("p", "l1", "l2", "kind", F.least(F.lit(1.0), F.col("sum") / F.col("total")).alias("score"))
        accepted = scored.where(F.col("score") >= min_score)
        if step + 1 < rounds:
            met = edges.join(accepted.select("p", F.col("kind").alias("as_kind"), F.col("score").alias("by")), "p")
            instances = met.groupBy("x").agg((F.sum(F.col("n") * F.col("by")) / F.max("everywhere")).alias("mean"), F.max_by("as_kind", F.struct("by", -F.col("as_kind"))).alias("as_kind"))
            seeded = F.col("seed").isNotNull()
            known = edges.join(instances, "x", "left").select("p", "x", "n", F.when(seeded, F.col("seed")).otherwise(F.col("as_kind")).alias("kind"), F.when(seeded, 1.0).otherwise(F.col("mean")).alias("score"))
    return scratch.written(accepted.select("l1", "l2", "kind"), "accepted", gathered=True), words


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_support: int = 5, min_score: float = 0.5, rounds: int = 3) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans): base and spans are sorted arrays of (start, kind number, end)."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    spans = _spans(src)
    patterns, words = _patterns(src, spans, min_support, min_score, rounds)
    sure = patterns.select("l1", "l2", F.col("kind").alias("as_kind"))
    more = words.where("l2 <> ''").join(sure, ["l1", "l2"]).select("id", "th", F.lit(4).alias("kind"), "start", "end", "as_kind", "copies")
    rows = spans.where("kind < 4").select("id", "th", "kind", "start", "end", F.col("kind").alias("as_kind"), "copies").unionAll(more)
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("as_kind").alias("kind"), F.col("end").cast("long").alias("end"))
    is_base = F.col("kind").between(0, 3)
    per_doc = rows.groupBy("id", "th").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sort_array(F.collect_list(F.when(is_base, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, span))).alias("spans"),
        F.max(F.when(F.col("kind") == -1, F.col("copies"))).cast("int").alias("copies"),
    )
    each = per_doc.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("__one"))
    return each.select(F.col("id").alias(id_col), *(f"n_{name}" for name in KINDS), "base", "spans")


def told(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
