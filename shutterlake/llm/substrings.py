"""Exact removal of long repeated byte strings.

Every byte that a ``length``-byte string covers which also starts anywhere else
is removed. The work goes in three steps, none of which sorts all suffixes.

1. Each window of ``length`` bytes has an anchor, the k-gram in it whose hash is
   lowest (the first of equals). Equal windows have equal anchors at equal
   offsets. Consecutive windows of one anchor are a run: about one row for every
   70 bytes, with the hash of its anchor and of its content.
2. An anchor that occurs once has no repeated window. If all runs of an anchor
   have one content, all their windows are repeated, and so are those of any
   content that occurs twice.
3. What is left are anchors of several contents, at the ends of repeated
   passages. Their bytes are fetched once per content and brought together by
   anchor, and windows found in two contents are marked. An anchor of more than
   CROWD contents is dealt out by window instead, so no task holds it whole.

bwt_repeats() gives the same marks for a set of strings by merging shard
Burrows-Wheeler transforms through interleave refinement; see README.md for why
step 3 does not use it.

Defined cases: a null text is empty; a null id is an id like any other; a text
shorter than the length loses nothing; repeated rows are copies of each other,
so all their windows are repeated; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shutterlake import scratch

GRAM = 60
CROWD = 2000
PIECE = 1 << 22
BROADCAST_ROWS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, b, _U))]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> _U(32))


class _Hasher:
    """Hashes of any range of a byte array."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _tables(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], dtype=_U)])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, n: int) -> np.ndarray:
        count = len(self.sums) - n
        return (self.sums[n:] - self.sums[:count]) * self.inverse[:count]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs_of(data: bytes, length: int, gram: int = GRAM) -> list[np.ndarray]:
    """[anchor hash, content hash, first window, windows, anchor's offset] of each run of a text."""
    parts = []
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        b = np.frombuffer(data[at : at + PIECE + length - 1], dtype=np.uint8)
        h = _Hasher(b)
        hashes = _mix(h.grams(gram))
        keys = hashes >> _U(24) << _U(24) | np.arange(len(hashes), dtype=_U)
        anchor = (sliding_min(keys, length - gram + 1) & _U((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], len(anchor)] - 1
        place = anchor[first]
        content = _mix(h.ranges(first, last + length) * _U(0x9FB21C651E98DF25) + (last - first).astype(_U) * _U(1 << 16) + (place - first).astype(_U))
        parts.append([hashes[place].view(np.int64), content.view(np.int64), first + at, last - first + 1, place - first])
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5


def marked_windows(contexts: list[tuple[int, int, int, bytes]], length: int) -> list[np.ndarray]:
    """For contexts (group, copies, offset, bytes): which windows of each are in two contexts of its group, at one anchor offset."""
    if not contexts:
        return []
    sizes = np.array([len(c[3]) - length + 1 for c in contexts])
    ends = np.cumsum([len(c[3]) for c in contexts])
    starts = ends - [len(c[3]) for c in contexts]
    own = np.repeat(np.arange(len(contexts)), sizes)
    j = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = starts[own] + j
    h = _Hasher(np.frombuffer(b"".join(c[3] for c in contexts), dtype=np.uint8))
    group = np.array([c[0] for c in contexts], dtype=np.int64)[own]
    offset = np.array([c[2] for c in contexts], dtype=np.int64)[own] - j
    value = _mix(h.ranges(at, at + length) + offset.astype(_U) * _U(0xA0761D6478BD642F))
    order = np.lexsort((value, group))
    same = (value[order][1:] == value[order][:-1]) & (group[order][1:] == group[order][:-1])
    twice = np.zeros(len(own), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return np.split(twice, np.cumsum(sizes)[:-1])


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each stretch of set flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """(id, th, a, b): byte ranges to remove, which may overlap; docs has id, th and text."""
    kind = docs.schema["id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                found = [runs_of((t.as_py() or "").encode("utf-8", "replace"), length) for t in batch.column(2)]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(f[0]) for f in found]))
                cols = [pa.array(np.concatenate(c)) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *cols], names=["id", "th", "anchor", "content", "first", "n", "off"])

    all_runs = scratch.written(docs.select("id", "th", "text").mapInArrow(runs, f"id {kind}, th long, anchor long, content long, first long, n long, off long"), "runs")
    again = all_runs.groupBy("anchor").agg(F.count("*").alias("k"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("k > 1")
    again = scratch.written(again.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors", gathered=True)
    met = scratch.written(all_runs.join(again, "anchor"), "met-runs")
    scratch.drop(all_runs)
    whole = ("id", "th", F.col("first").alias("a"), (F.col("first") + F.col("n") - 1 + length).alias("b"))
    alike = met.where("not mixed").select(*whole)
    contents = met.where("mixed").groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "first")).alias("rep"), F.min("n").alias("n"), F.min("off").alias("off"))
    contents = scratch.written(contents, "contents")
    copied = met.where("mixed").join(contents.where("copies > 1").select("anchor", "content"), ["anchor", "content"]).select(*whole)
    sizes = scratch.written(contents.groupBy("anchor").agg(F.count("*").alias("contents")), "anchor-sizes", gathered=True)
    # The bytes of one run per content; only documents that hold one are read on.
    asked = contents.join(sizes, "anchor").select(F.col("rep.id").alias("id"), F.col("rep.th").alias("th"), F.struct("anchor", F.col("copies").alias("copies"), "off", F.col("rep.first").alias("first"), "n", (F.col("contents") > CROWD).alias("crowded")).alias("run"))
    lists = scratch.written(asked.groupBy("id", "th").agg(F.collect_list("run").alias("runs")), "asked", gathered=True)
    few = lists.count() <= BROADCAST_ROWS  # 16 bytes a row
    named = lists.select(F.col("id").alias("of"), F.col("th").alias("of_th"), "runs")
    same = docs["id"].eqNullSafe(F.col("of")) & (docs["th"] == F.col("of_th"))
    some = docs.join(F.broadcast(named.drop("runs")), same, "left_semi") if few else docs
    same = some["id"].eqNullSafe(F.col("of")) & (some["th"] == F.col("of_th"))
    with_text = some.join(named.hint("merge"), same).select("id", "th", "text", "runs")
    context_schema = f"id {kind}, th long, first long, anchor long, copies long, off long, crowded boolean, context binary"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, rows, keys = set(), [[] for _ in range(6)], []
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key in seen:  # a repeated row
                    continue
                seen.add(key)
                data = (batch.column(2)[i].as_py() or "").encode("utf-8", "replace")
                for r in batch.column(3)[i].as_py():
                    keys.append(i)
                    for c, v in zip(rows, (r["first"], r["anchor"], r["copies"], r["off"], r["crowded"], data[r["first"] : r["first"] + r["n"] - 1 + length])):
                        c.append(v)
            take = pa.array(keys, pa.int64())
            cols = [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *cols], names=["id", "th", "first", "anchor", "copies", "off", "crowded", "context"])

    contexts = scratch.written(with_text.mapInArrow(fetch, context_schema).dropDuplicates(["anchor", "id", "th", "first"]), "contexts")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            flags = marked_windows([(r[3], r[4], r[5], r[7]) for r in rows], length)
            made = [(r[0], r[1], r[2] + x, r[2] + y + length) for r, f in zip(rows, flags) if r[4] == 1 for x, y in stretches(f)]
            cols = list(zip(*made)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type or ids), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["id", "th", "a", "b"])

        ids = None
        for whole_batch in batches:
            ids = whole_batch.column(0).type
            held += zip(*(c.to_pylist() for c in whole_batch.columns))
            if len(held) >= 10_000:  # all but the last anchor's are whole
                cut = next((i for i in range(len(held) - 1, 0, -1) if held[i][3] != held[i - 1][3]), 0)
                if cut:
                    yield out(held[:cut])
                    held = held[cut:]
        if held:
            yield out(held)

    marked = contexts.where("not crowded").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(near, f"id {kind}, th long, a long, b long")
    crowd = contexts.where("crowded")
    windows = crowd.select("id", "th", "first", "anchor", "copies", "off", "context", F.explode(F.sequence(F.lit(0), F.length("context") - length)).alias("j"))
    windows = windows.select("id", "th", "copies", "anchor", (F.col("off") - F.col("j")).alias("o"), F.sha2(F.substring(F.col("context"), F.col("j") + 1, F.lit(length)), 256).alias("w"), (F.col("first") + F.col("j")).alias("a"))
    counted = windows.groupBy("anchor", "o", "w").agg(F.count("*").alias("k")).where("k > 1")
    dealt = windows.where("copies = 1").join(counted, ["anchor", "o", "w"], "left_semi").select("id", "th", "a", (F.col("a") + length).alias("b"))
    return alike.unionAll(copied).unionAll(marked).unionAll(dealt)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row; kept: the bytes that stay."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"), F.col(f"`{text}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    spans = _spans(src.where(F.octet_length("text") >= length), length).groupBy("id", "th").agg(F.array_distinct(F.collect_list(F.struct("a", "b"))).alias("spans"))
    spans = scratch.written(spans, "removed", gathered=True)
    joined = src.join(spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "spans"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for t, spans_of in zip(batch.column(1), batch.column(2)):
                data = (t.as_py() or "").encode("utf-8", "replace")
                rest, at, gone, n = [], 0, 0, 0
                for a, b in sorted((s["a"], s["b"]) for s in spans_of.as_py() or ()):
                    if a > at or not n:
                        rest.append(data[at:a])
                        n, gone, at = n + 1, gone + b - a, b
                    elif b > at:
                        gone, at = gone + b - at, b
                rest.append(data[at:])
                sizes.append(len(data)), removed.append(gone), counts.append(n), kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("id", "text", "spans").mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


# --- the named method, on strings held in memory ---------------------------


def shard_bwt(texts: list[bytes]) -> np.ndarray:
    """Multi-string Burrows-Wheeler transform; ends are 0, other bytes are one more, and equal suffixes stand in order of their text."""
    suffixes = sorted((t[i:], n, i) for n, t in enumerate(texts) for i in range(len(t) + 1))
    return np.array([texts[n][i - 1] + 1 if i else 0 for _, n, i in suffixes], dtype=np.int32)


def merge_bwts(left: np.ndarray, right: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, lcp) of two transforms: True where a row is the right one's; common prefixes capped at depth.

    The interleave starts with all left rows first. Each round deals the rows, in
    order, to the buckets of their symbols, which orders suffixes by one more
    byte; where a new bucket of a round begins, the common prefix ends.
    """
    n = len(left) + len(right)
    side = np.r_[np.zeros(len(left), bool), np.ones(len(right), bool)]
    block = np.zeros(n, dtype=np.int64)
    lcp = np.full(n, depth, dtype=np.int64)
    lcp[0] = 0
    for k in range(depth):
        symbol = np.empty(n, dtype=np.int32)
        symbol[~side], symbol[side] = left, right
        order = np.argsort(symbol, kind="stable")
        # Ends have no order of their own: their rows keep the order of the texts.
        ends = int((symbol == 0).sum())
        end_side = np.sort(side[order[:ends]], kind="stable")
        side = np.r_[end_side, side[order[ends:]]]
        start = np.r_[True, (symbol[order][1:] != symbol[order][:-1]) | (block[order][1:] != block[order][:-1])]
        start[:ends] = True
        new = start & (lcp == depth)
        new[0] = False
        lcp[new] = k
        block = np.cumsum(start)
        if start.all():
            break
    return side, lcp


def bwt_repeats(shards: list[list[bytes]], length: int) -> int:
    """Number of windows of ``length`` bytes that occur elsewhere in the shards, from merged transforms."""
    texts, merged = list(shards[0]), shard_bwt(shards[0])
    lcp = None
    for shard in shards[1:]:
        other = shard_bwt(shard)
        side, lcp = merge_bwts(merged, other, length)
        out = np.empty(len(side), dtype=np.int32)
        out[~side], out[side] = merged, other
        merged, texts = out, texts + shard
    if lcp is None:
        _, lcp = merge_bwts(merged, np.zeros(0, np.int32), length)
    deep = lcp >= length
    return int((deep | np.r_[deep[1:], False]).sum())
