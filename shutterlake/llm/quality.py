"""Quality rules: line-first cleaning, native columns only.

Each line is judged by itself: punctuation (symbol share, shouting, an ellipsis
at its end, a long run without any mark), case (capitals throughout), navigation
(separators between fragments, links) and boilerplate phrases. Failing lines go,
and a document that loses too large a share of its word characters is rejected,
as is one that is too short or repeats its own 5-word windows too much.

Defined cases: a null or blank text has no words and is rejected; its cleaned
text is null or blank. Repeated rows are judged one by one. Columns of the
result's names that come with the input are replaced; all others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shutterlake.llm.text import SPACE_CLASS, count_of, total, words_of

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript", "lorem ipsum", "powered by",
    "privacy policy", "sign up for our newsletter", "skip to content", "subscribe to our", "terms of service", "terms of use",
)
NAV_SEPARATORS = (" | ", " » ", " :: ", " > ")
LINKS = ("http://", "https://", "www.")
ELLIPSES = ("...", "…")
MARKS = r"[.,;:!?\x{2026}\x{3002}\x{ff01}\x{ff1f}]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    max_symbol_percent: int = 10  # of a line's word characters
    max_shouts: int = 2  # "!!" in a line
    max_separators: int = 2  # navigation separators in a line
    max_links: int = 2  # links in a line
    max_capital_percent: int = 70  # of a line's ASCII letters, from min_letters on
    min_letters: int = 20
    max_unmarked: int = 300  # word characters of a line without a punctuation mark
    max_lost_percent: int = 40  # of a document's word characters


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def line_fails(line: Column, rules: QualityRules) -> Column:
    """True if a line breaks one of the line rules."""
    chars = _word_chars(line)
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    separators = sum((count_of(line, s) for s in NAV_SEPARATORS[1:]), count_of(line, NAV_SEPARATORS[0]))
    furniture = F.lower(line).rlike("|".join(BOILERPLATE))
    links = sum((count_of(line, s) for s in LINKS[1:]), count_of(line, LINKS[0]))
    capitals = F.length(line) - F.length(F.translate(line, _CAPITALS, ""))
    small = F.length(line) - F.length(F.translate(line, _CAPITALS.lower(), ""))
    # Lines begin with a capital or hold names; only those of many are counted through.
    loud = line.rlike("[A-Z][^a-z]{3}") & (capitals + small >= rules.min_letters) & (capitals * 100 > (capitals + small) * rules.max_capital_percent)
    end = F.rtrim(line)
    trails = F.endswith(end, F.lit(ELLIPSES[0])) | F.endswith(end, F.lit(ELLIPSES[1]))
    unmarked = (chars > rules.max_unmarked) & ~line.rlike(MARKS)
    symbolic = (symbols * 100 > chars * rules.max_symbol_percent) | (count_of(line, "!!") > rules.max_shouts)
    return symbolic | trails | unmarked | loud | (separators > rules.max_separators) | (links > rules.max_links) | furniture


def judged(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept and cleaned_text."""
    own = [c for c in docs.columns if c.lower() not in _OUT]
    given = F.col(f"`{text}`")
    body = F.coalesce(given, F.lit(""))
    k = rules.window
    # The columns of docs go along in one, so that their names meet none of those below.
    df = docs.select(F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in own)).alias("__row"), given.isNull().alias("__null"), body.alias("__text"), words_of(body).alias("__w"), F.split(body, "\n", -1).alias("__lines"))
    windows = F.transform(F.sequence(F.lit(0), F.size("__w") - k), lambda i: F.xxhash64(*(F.get(F.col("__w"), i + j) for j in range(k))))
    spoken = F.filter("__lines", lambda x: x.rlike("[^" + SPACE_CLASS[1:]))
    df = df.select("*", F.when(F.size("__w") >= k, windows).alias("__h"), spoken.alias("__spoken"), F.transform("__lines", lambda x: line_fails(x, rules)).alias("__bad"))
    # The windows of a repeating text, sorted by hash and place: equal neighbours are repeats.
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.select("*", F.when(repeats, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))
    again = F.filter("__s", lambda x, j: (F.get(F.col("__s"), j - 1)["h"] == x["h"]) | (F.get(F.col("__s"), j + 1)["h"] == x["h"]))
    df = df.select("*", F.sort_array(F.transform(again, lambda x: x["i"])).alias("__at"))
    covered = total(F.transform("__at", lambda x, j: F.least(F.lit(k), F.coalesce(F.get(F.col("__at"), j + 1) - x, F.lit(k)))))
    # Always 0, and not deterministic: a filter on the result is then not pushed down into copies of all these expressions.
    barrier = F.shiftright(F.monotonically_increasing_id(), 63)
    lost = total(F.transform(F.arrays_zip("__lines", "__bad"), lambda x: F.when(x["__bad"], _word_chars(x["__lines"])).otherwise(F.lit(0))))
    df = df.select(
        "__row",
        F.size("__w").cast("long").alias("n_words"),
        _word_chars(F.col("__text")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__spoken") - F.size(F.array_distinct("__spoken"))).cast("long").alias("n_dup_lines"),
        (F.coalesce(covered, F.lit(0)).cast("long") + barrier).alias("n_repeat_words"),
        lost.cast("long").alias("lost_chars"),
        F.when(~F.col("__null"), F.array_join(F.filter("__lines", lambda x, i: ~F.get(F.col("__bad"), i)), "\n")).alias("cleaned_text"),
    )
    df = df.select(*(F.col("__row").getField(c).alias(c) for c in own), *(c for c in df.columns if c != "__row"))
    df = df.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * rules.max_lost_percent))


_OUT = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "cleaned_text", "base_failed", "kept"}


def clean(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, in the columns of docs, with failing lines gone and n_chars, if there, set anew."""
    cols = [(F.col("cleaned_text").alias(c) if c == text else F.length("cleaned_text").cast("long").alias(c) if c == "n_chars" else F.col(f"__in.{c}").alias(c)) for c in docs.columns]
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__in"), F.col(f"`{text}`").alias("__body"))
    return judged(wrapped, "__body", rules).where("kept").select(*cols)
