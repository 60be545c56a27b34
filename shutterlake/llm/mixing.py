"""Mixing sources to target weights, native columns only.

The words of a source's documents, in a fixed order, are packed into blocks of
``block`` = 64 words. The mix is a row of output shards of ``shard_slots``
block slots. Which source fills which slot is drawn for all shards at once: the
slots of all sources, counted to meet the targets, are dealt out by one
pseudorandom permutation, so the counts of a shard are multinomial draws under
the condition that all shards together meet the targets (shards drawn one by
one would miss them by 5 % or so on small inputs). The k-th slot of a source
takes block ``perm(k mod n)`` of its n blocks, where perm is a permutation
(swap-or-not rounds) of its own for each pass over the source, and slots join
blocks on (source, block). No source has more than ``max_times`` passes.

Targets: sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ...
and share all words; a target stops at max_times the source's words, and the
excess is shared by weight among the others until none is above.

What the driver holds is one row per source. Offsets inside a source are summed
in parts of BUCKET_ROWS documents by hash of the id, so a hot source is spread.

Defined cases: null texts have no words and take none; a null source is a
source of its own; repeated rows are documents of their own; no words at all
gives targets of zero; other columns are not read, or pass through, whatever
their names. Runs agree, since draws come from hashes of a seed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from shutterlake import scratch
from shutterlake.llm.text import SPACE_CLASS, words_of

#: Documents of a source that one part of its offsets has, about.
BUCKET_ROWS = 2_000
#: Parts at most, which one task sums.
MOST_BUCKETS = 1 << 18
#: Slots that one row of the plan stands for.
SLOT_ROWS = 10_000
ROUNDS = 8
WEIGHTS = (1, 2, 3)


@dataclass(frozen=True)
class MixPlan:
    block: int = 64
    shard_slots: int = 4096
    max_times: int = 3
    seed: int = 17


def targets(words: list[int], max_times: int = 3) -> list[float]:
    """Words to take of each source; words: of the sources in order."""
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(words))]
    order = sorted(range(len(words)), key=lambda i: (max_times * words[i] / weight[i], i))
    left, left_weight, out = sum(words), sum(weight), [0.0] * len(words)
    for at, i in enumerate(order):
        level = left / left_weight  # words a unit of weight
        if level * weight[i] <= max_times * words[i]:
            for j in order[at:]:
                out[j] = left * weight[j] / left_weight
            break
        out[i] = float(max_times * words[i])
        left, left_weight = left - max_times * words[i], left_weight - weight[i]
    return out


def _sized(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    body = F.col(f"`{text}`")
    return scratch.written(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"), F.size(words_of(body)).cast("long").alias("size"), F.xxhash64(body).alias("hash")), "sizes")


def _sources(sized: DataFrame, plan: MixPlan) -> DataFrame:
    """A row per source: (no, source, source_size, target, n blocks, slots, first slot, parts of its offsets)."""
    rows = [tuple(r) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()]  # a row per source
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    found, first = [], 0
    for no, ((name, words, docs), target) in enumerate(zip(rows, targets([w for _, w, _ in rows], plan.max_times), strict=True)):
        n = -(-words // plan.block)
        slots = min(plan.max_times * n, round(target * n / words)) if words else 0
        found.append((no, name, words, target, n, slots, first, min(MOST_BUCKETS, max(1, docs // BUCKET_ROWS))))
        first += slots
    return sized.sparkSession.createDataFrame(found, f"no int, source {sized.schema['source'].dataType.simpleString()}, source_size long, target double, n long, slots long, first long, parts long")


def _permuted(k: Column, n: Column, key: list[Column]) -> Column:
    """Place of k in a pseudorandom permutation of 0..n-1 (swap-or-not shuffle)."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        swap = F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(1) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k, step)


def _slots(sources: DataFrame, plan: MixPlan) -> DataFrame:
    """(no, block, turn, slot): the block that fills each slot of the mix; turn is the pass over the source, slot div shard_slots the shard."""
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("total"))
    live = sources.where("slots > 0").select("no", "n", "slots", "first").join(F.broadcast(total))  # total: one row
    starts = live.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(SLOT_ROWS).cast("long"))).alias("start"))
    spread = starts.repartition(F.col("no"), F.col("start"))
    each = spread.select("no", "n", "first", "total", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + SLOT_ROWS, F.col("slots")) - 1)).alias("i"))
    turn = F.floor(F.col("i") / F.col("n"))
    placed = each.select("no", "n", F.pmod("i", "n").alias("k"), turn.alias("turn"), (F.col("first") + F.col("i")).alias("at"), "total")
    block = _permuted(F.col("k"), F.col("n"), [F.lit(plan.seed), F.col("no"), F.col("turn")])
    return placed.select("no", block.alias("block"), "turn", _permuted(F.col("at"), F.col("total"), [F.lit(plan.seed), F.lit(-1)]).alias("slot"))


def shard_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", plan: MixPlan = MixPlan()) -> DataFrame:
    """(shard, source, slots): how many slots each source got in each output shard."""
    sources = _sources(_sized(docs, id_col, text, source), plan)
    dealt = _slots(sources, plan).groupBy(F.floor(F.col("slot") / plan.shard_slots).alias("shard"), "no").agg(F.count("*").alias("slots"))
    return dealt.join(F.broadcast(sources.select("no", F.col("source").alias(source))), "no").select("shard", source, "slots")


def _pieces(sized: DataFrame, frame: DataFrame, plan: MixPlan) -> DataFrame:
    """A row per document and block it lies in: row key (no, bucket, place), id, hash, size, block, lo and n in words of the document."""
    numbered = sized.join(F.broadcast(frame.select("no", "parts", F.col("source").alias("of"))), F.col("source").eqNullSafe(F.col("of")))
    numbered = numbered.select("no", F.pmod(F.xxhash64("id", "hash"), F.col("parts")).alias("bucket"), "id", "size", "hash")
    sums = numbered.groupBy("no", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("no").orderBy("bucket")) - F.col("words")
    offsets = sums.select("no", "bucket", before.alias("offset"))
    inside = Window.partitionBy("no", "bucket").orderBy("id", "hash", "size")
    placed = numbered.select("*", (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("run"), F.row_number().over(inside).alias("place"))
    placed = placed.join(offsets, ["no", "bucket"]).withColumn("start", F.col("offset") + F.col("run"))
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / plan.block), F.floor((F.col("start") + F.col("size") - 1) / plan.block)))
    cut = placed.select("no", "bucket", "place", "id", "hash", "size", "start", F.explode_outer(blocks).alias("block"))
    lo = F.greatest(F.col("block") * plan.block - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * plan.block - F.col("start"), F.col("size"))
    return cut.select("no", "bucket", "place", "id", "hash", "size", "block", lo.alias("lo"), (hi - lo).alias("n"))


def taken(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", plan: MixPlan = MixPlan()) -> DataFrame:
    """(id, size, source_size, target, taken) of every row of docs."""
    sized = _sized(docs, id_col, text, source)
    frame = _sources(sized, plan)
    times = _slots(frame, plan).groupBy("no", "block").agg(F.count("*").alias("times"))
    joined = _pieces(sized, frame, plan).join(times.hint("merge"), ["no", "block"], "left")
    per_row = joined.groupBy("no", "bucket", "place", "id", "size").agg(F.sum(F.coalesce(F.col("n") * F.col("times"), F.lit(0))).alias("taken"))
    return per_row.join(F.broadcast(frame.select("no", "source_size", "target")), "no").select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", plan: MixPlan = MixPlan()) -> DataFrame:
    """The mix as documents: a row per document of which words are taken, in the columns of docs.

    Its text holds the taken words, pass by pass in their order; n_chars, if
    there, is set anew. Rows of one id, source and text give one row that holds
    what is taken of all of them.
    """
    sized = _sized(docs, id_col, text, source)
    frame = _sources(sized, plan)
    got = _pieces(sized, frame, plan).join(_slots(frame, plan).select("no", "block", "turn").hint("merge"), ["no", "block"]).join(F.broadcast(frame.select("no", F.col("source").alias("of"))), "no")
    parts = got.groupBy("id", "hash", "of").agg(F.sort_array(F.collect_list(F.struct("turn", "place", "lo", "n"))).alias("parts"))  # 3 times the document's blocks
    body = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("own"), F.col(f"`{source}`").alias("own_source"), F.col(f"`{text}`").alias("body"), F.xxhash64(F.col(f"`{text}`")).alias("own_hash"))
    on = body["own"].eqNullSafe(parts["id"]) & (body["own_hash"] == parts["hash"]) & body["own_source"].eqNullSafe(parts["of"])
    found = body.join(parts, on).dropDuplicates(["own", "own_source", "own_hash"])
    words = F.regexp_extract_all("body", F.lit("[^" + SPACE_CLASS[1:] + "+" + SPACE_CLASS + "*"), F.lit(0))
    with_words = found.withColumn("w", words)
    piece = F.transform("parts", lambda p: F.concat(F.array_join(F.slice(F.col("w"), (p["lo"] + 1).cast("int"), p["n"].cast("int")), ""), F.when(p["lo"] + p["n"] == F.size("w"), F.lit("\n")).otherwise(F.lit(""))))
    made = with_words.withColumn("mix", F.rtrim(F.array_join(piece, ""), F.lit("\n")))
    return made.select(*(F.col("mix").alias(c) if c == text else F.length("mix").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
