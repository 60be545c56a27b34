"""Benchmark decontamination: broadcast hash table of test n-grams, native columns only.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and all
non-ASCII characters. Every window of ``window`` = 10 consecutive words of a
benchmark item, or the whole item if it is shorter, is hashed; every document
window of those lengths is looked up, and a hit is verified word by word. A
document word inside an occurrence of a window is hit.

The table of windows is broadcast while its size, measured before, is within
``broadcast_bytes``; beyond it the same join shuffles (hash, place) rows.

Defined cases: null or wordless texts and items have no words and hit nothing.
Repeated document rows each keep a row; repeated items count by item_id once.
Other columns are not read, and pass through where documents are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shutterlake import scratch
from shutterlake.llm.text import ascii_lower

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP, -1), "")


def _hashes(words: Column, length: int) -> Column:
    """Hash of every window of a length, in order."""
    starts = F.sequence(F.lit(0), F.size(words) - length)
    return F.when(F.size(words) >= length, F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(length)))))


def _placed(hashes: Column, length: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"), F.lit(length).alias("n")))


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(h, gram, item_ids): each distinct window with its hash and its items; written."""
    w = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), normal_words(F.col(f"`{text}`")).alias("w")).where(F.size("w") > 0)
    cut = F.when(F.size("w") >= window, F.transform(F.sequence(F.lit(1), F.size("w") - window + 1), lambda i: F.slice("w", i, window))).otherwise(F.array("w"))
    grams = w.select("item", F.explode(cut).alias("gram"))
    by_gram = grams.distinct().groupBy("gram").agg(F.sort_array(F.collect_list("item")).alias("items"))  # an item's id once for each window of its own
    return scratch.written(by_gram.select(F.size("gram").alias("n"), "gram", "items"), "windows")


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(columns of docs but text, text_hash, n_words, spans, item_ids): a row per row of docs; own columns of the last four names are left out.

    spans: sorted (start, length) in words of each window occurrence; item_ids:
    sorted ids of the items with occurring windows.
    """
    grams = item_windows(items, item_id, item_text, window)
    stats = grams.agg(F.collect_set("n"), F.sum(F.length(F.to_json("gram")) + F.length(F.to_json("items")) + 64)).first()  # at most `window` lengths
    lengths = sorted(stats[0])
    gram_table = grams.select(F.xxhash64(*(F.get("gram", F.lit(j)) for j in range(window))).alias("h"), "gram", "items")
    if lengths != [window]:
        gram_table = None
        for n in lengths:
            part = grams.where(F.col("n") == n).select(F.xxhash64(*(F.get("gram", F.lit(j)) for j in range(n))).alias("h"), "gram", "items")
            gram_table = part if gram_table is None else gram_table.unionAll(part)
    # The columns of docs go along in one, so that their names meet none of those below.
    passing = [c for c in docs.columns if c != text]
    keys = ["__row"]
    unwrapped = [F.col("__row").getField(c).alias(c) for c in passing if c not in _OUT]
    df = docs.select(F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in passing)).alias("__row"), F.xxhash64(F.col(f"`{text}`")).alias("__t"), normal_words(F.col(f"`{text}`")).alias("__w"))
    if gram_table is None:
        return df.select(*unwrapped, F.col("__t").alias("text_hash"), F.size("__w").cast("long").alias("n_words"), F.array().cast("array<struct<at:int,n:int>>").alias("spans"), F.array().cast("array<string>").alias("item_ids"))
    looked = [_placed(_hashes(F.col("__w"), n), n) for n in lengths]
    first = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("at"), F.lit(0).alias("n")))  # the document's own row
    empty = F.array().cast("array<struct<h:bigint,at:int,n:int>>")
    all_windows = F.concat(first, *(F.coalesce(x, empty) for x in looked))
    rows = df.select("*", F.explode(all_windows).alias("__x"))
    rows = rows.select(*(F.col(f"`{c}`") for c in keys), "__t", "__w", F.col("__x.h").alias("__h"), F.col("__x.at").alias("__at"), F.col("__x.n").alias("__n"))
    if (stats[1] or 0) <= broadcast_bytes:
        gram_table = F.broadcast(gram_table)
    else:
        rows = rows.withColumn("__w", F.when(F.col("__h").isNull(), F.col("__w")).otherwise(F.slice("__w", F.col("__at") + 1, F.col("__n"))))
    gram = F.when(F.size("__w") == F.col("__n"), F.col("__w")).otherwise(F.slice("__w", F.col("__at") + 1, F.col("__n")))
    found = rows.join(gram_table, (F.col("__h") == F.col("h")) & (gram == F.col("gram")), "left").where("__h IS NULL OR h IS NOT NULL")
    per_doc = found.groupBy(*(F.col(f"`{c}`") for c in keys), "__t").agg(
        F.max(F.when(F.col("__h").isNull(), F.size("__w"))).cast("long").alias("n_words"),
        F.count(F.when(F.col("__h").isNull(), 1)).alias("__copies"),
        F.sort_array(F.collect_set(F.when(F.col("h").isNotNull(), F.struct(F.col("__at").alias("at"), F.col("__n").alias("n"))))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    each = F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))
    return per_doc.select("*", each.alias("__one")).select(*unwrapped, F.col("__t").alias("text_hash"), "n_words", "spans", "item_ids")


_OUT = ("text_hash", "n_words", "spans", "item_ids")


def hit_places(spans: Column) -> Column:
    """Distinct word places inside the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """docs without the documents that hold a window of an item."""
    found = hits(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").alias("__body")), items, text="__body", **kw)
    bad = found.where(F.size("spans") > 0).select("__id", F.col("text_hash").alias("__hash")).distinct()
    same = docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text]) == bad["__hash"])
    return docs.join(bad, same, "left_anti")


def without_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """docs with the words of every span taken out of the text, each with what parts it from the next word."""
    found = hits(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").alias("__body")), items, text="__body", **kw)
    cut = found.where(F.size("spans") > 0).select("__id", F.col("text_hash").alias("__hash"), hit_places(F.col("spans")).alias("__places")).dropDuplicates(["__id", "__hash"])
    between = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # of the text as it is, with A-Z in words
    lead = F.regexp_extract(F.col(text), f"^[{between}]+", 0)
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"[^{between}]+[{between}]*"), F.lit(0))
    left = F.concat(lead, F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains("__places", i)), ""))
    joined = docs.join(cut, docs[id_col].eqNullSafe(cut["__id"]) & (F.xxhash64(docs[text]) == cut["__hash"]), "left")
    return joined.select(*(F.when(F.col("__places").isNull(), F.col(text)).otherwise(left).alias(c) if c == text else docs[c] for c in docs.columns))
