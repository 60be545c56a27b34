"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

A text is lower-cased (A-Z), cut into words, and hashed by word shingles with
XXH64 (seed 42). A fingerprint bit is set if it is set in over half the hashes.
Fingerprints with at most ``max_bits`` = 2 differing bits are linked, and the
smallest id of a connected group names it.

Links are found between distinct fingerprints only. The 64 bits are split into
four blocks of 16; two fingerprints that differ in two bits agree in at least
two of the blocks, so they meet under one of six 32-bit keys. A key with few
fingerprints gives pairs, verified by their Hamming distance. Under a crowded
key (a large group of near copies) pairs would grow with the square of the
group, so its fingerprints are dealt out by all their one-bit variants instead:
two that differ in two bits share a variant, no variant has more than 65
fingerprints, and any two that share one are within two bits. Both ways find
every link or a chain of links that joins the same fingerprints.

Defined cases: a null or blank text has no shingles and fingerprint zero, which
is linked like any other; a text of fewer words than a shingle is one shingle.
Repeated rows each get a row. Other columns are not read.

``kept_similar`` links texts with a Jaccard similarity of their sets of shingles
of at least ``least``. Candidates are all pairs of fingerprints of at most
``max_bits`` different bits, by the same pigeonhole blocks. Fingerprints of such
texts may also be 10 bits or more apart, too far for blocks; so texts that share
one of 20 MinHash keys of five minima (of pairs at 0.8 all but one in 2,800 do)
are candidates beside them. The sets themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shutterlake import scratch
from shutterlake.llm import bands, minhash
from shutterlake.operators.graph import connected_components

SEED = 42
BLOCKS, BLOCK_BITS = 4, 16
MINIMA_OF, KEYS = 5, 20
#: Longs of 64 marks each that a set of shingles has.
MARKS = 16
#: Fingerprints under one key from which variants replace pairs.
CROWDED = 32
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of a text; none of a blank one."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, dtype="<u8")
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=len(shingles))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text."""
    return _fingerprint(shingle_hashes(text, shingle))


def _fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, f"id {kind}, fp long")


def _keys() -> Column:
    """The six (block pair, 32 bits) keys of fp, as one array of longs below 2^35."""
    block = [F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(0xFFFF) for i in range(BLOCKS)]
    return F.array(*(F.lit(n << 32).cast("long").bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))))


def links(fps: DataFrame) -> DataFrame:
    """(src, dst) edges between the distinct fingerprints of column fp, whose components are those of all links."""
    keyed = fps.select("fp", F.explode(_keys()).alias("key"))
    sizes = scratch.written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "block-sizes", gathered=True)
    met = scratch.written(keyed.join(sizes, "key"), "blocks", gathered=True)
    few = met.where(F.col("n") <= CROWDED)
    a, b = few.select("key", F.col("fp").alias("src")), few.select("key", F.col("fp").alias("dst"))
    pairs = a.join(b, "key").where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2)).select("src", "dst")
    crowd = met.where(F.col("n") > CROWDED).select("fp").distinct()
    bits = F.array(F.lit(0).cast("long"), *(F.lit(v if v < 1 << 63 else v - (1 << 64)).cast("long") for v in (1 << i for i in range(64))))
    variants = crowd.select("fp", F.explode(F.transform(bits, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("variant"))
    shared = variants.groupBy("variant").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = shared.select(F.get("fps", F.lit(0)).alias("src"), F.explode(F.slice("fps", 2, 64)).alias("dst")).where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2)
    return pairs.unionAll(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row."""
    rows = scratch.written(fingerprints(docs, id_col, text, shingle), "fingerprints")
    firsts = scratch.written(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    groups = connected_components(links(firsts.select("fp")))
    named = scratch.written(firsts.join(groups, firsts.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("group")), "named", gathered=True)
    lowest = scratch.written(named.groupBy("group").agg(F.min("first").alias("component_id")), "lowest", gathered=True)
    ids = scratch.written(named.join(lowest, "group").select(F.col("fp").alias("of"), "component_id"), "components", gathered=True)
    return rows.join(ids, rows.fp == ids.of).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """docs with one row of each group: the one with the smallest id.

    Rows of one id go or stay together; of those that stay, repeated rows of
    one id and text are left once. A null id is never the smallest.
    """
    found = near_duplicates(docs, id_col, text, shingle)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    left = docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
    return _once(left, id_col, text)


def _once(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.withColumn("__same", F.xxhash64(F.col(f"`{text}`"))).dropDuplicates([id_col, "__same"]).drop("__same")


def _content(text: str | None) -> int:
    """Hash of the words of a text."""
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "replace").lower().split()), SEED)


def block_keys(fp: int, max_bits: int) -> list[int]:
    """Keys of a fingerprint, unsigned: of its max_bits + 2 blocks any two. Fingerprints of at most max_bits different bits share a key."""
    n = max_bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    block = [(fp >> lo & ((1 << (hi - lo)) - 1)).to_bytes(8, "little") for lo, hi in zip(edges, edges[1:])]
    return [xxhash.xxh64_intdigest(block[i] + block[j], MINIMA_OF * KEYS + 1 + i * n + j) for i, j in combinations(range(n), 2)]


def _signatures(src: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """(id, content, size, marks, keys): a hash of the words; of the set of shingles the size, a bit for each by hash, and the keys by blocks of the fingerprint and by MinHash; written."""
    kind = src.schema["id"].dataType.simpleString()
    masks = np.array(minhash.masks(MINIMA_OF * KEYS), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, sizes, marks, keys = [], [], [], []
            for t in batch.column(1):
                every = shingle_hashes(t.as_py(), shingle)
                blocks = block_keys(_fingerprint(every), max_bits) if len(every) else []
                hashes = np.unique(every).view(np.int64)
                low = [np.min(hashes ^ m) for m in masks] if len(hashes) else []
                contents.append(_content(t.as_py()))
                sizes.append(len(hashes))
                bits = np.zeros(64 * MARKS, dtype=np.uint8)
                bits[hashes & (64 * MARKS - 1)] = 1
                marks.append(np.packbits(bits, bitorder="little").view(np.int64))
                minima = [xxhash.xxh64_intdigest(np.array(low[i : i + MINIMA_OF]).tobytes(), i) for i in range(0, len(low), MINIMA_OF)]
                keys.append(np.array(blocks + minima, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(contents, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["id", "content", "size", "marks", "keys"])

    return scratch.written(src.mapInArrow(run, f"id {kind}, content long, size long, marks array<long>, keys array<long>"), "signatures")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(content, hashes) of a column of texts: the set of its shingles, as ints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(at, 256).to_pylist()
                contents = pa.array(np.array([_content(t) for t in part], dtype=np.uint64).view(np.int64))
                sets = [np.unique((shingle_hashes(t, shingle) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in part]
                yield pa.RecordBatch.from_arrays([contents, pa.array(sets, pa.list_(pa.int32()))], names=["content", "hashes"])

    return texts.mapInArrow(run, "content long, hashes array<int>")


def kept_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, max_bits: int = 2) -> DataFrame:
    """docs with one row of each group of texts that are linked by similarity; what kept_one says of ids holds here."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = _signatures(src, shingle, max_bits)
    firsts = scratch.written(rows.groupBy("content").agg(F.min("id").alias("first"), F.first("size").alias("size"), F.first("marks").alias("marks"), F.first("keys").alias("keys")), "contents")
    members = bands.shared(firsts.select(F.explode("keys").alias("key"), F.col("content").alias("node")))

    def verified(pairs: DataFrame) -> DataFrame:
        asked = scratch.written(pairs.select(F.col("src").alias("content")).unionAll(pairs.select("dst")).distinct().join(firsts.select("content", "first"), "content"), "asked", gathered=True)
        texts = src.join(asked.select("first").distinct(), src["id"].eqNullSafe(F.col("first")), "left_semi").select("text")
        sets = scratch.written(_sets(texts, shingle).join(asked.select("content"), "content").dropDuplicates(["content"]), "sets")
        a, b = sets.toDF("src", "ha"), sets.toDF("dst", "hb")
        common = F.size(F.array_intersect("ha", "hb"))
        return pairs.join(a, "src").join(b, "dst").where(common >= least * (F.size("ha") + F.size("hb") - common) - 1e-9).select("src", "dst")

    def may(a: Column, b: Column) -> Column:
        """True if sizes and marks allow the similarity: sets that share enough lack few shingles of each other, and each missing mark is one."""
        missing = lambda p, q: sum(F.bit_count(p[f"m{k}"].bitwiseAND(F.bitwise_not(q[f"m{k}"]))) for k in range(MARKS))
        shared = least / (1 + least) * (a["size"] + b["size"]) - 1e-9
        return (F.least(a["size"], b["size"]) >= least * F.greatest(a["size"], b["size"]) - 1e-9) & (a["size"] - missing(a, b) >= shared) & (b["size"] - missing(b, a) >= shared)

    x = F.struct("size", *(F.get("marks", F.lit(k)).alias(f"m{k}") for k in range(MARKS)))
    groups = bands.links(members, firsts.select(F.col("content").alias("node"), x.alias("x")), may, verified)
    named = scratch.written(firsts.join(groups, firsts.content == groups.node, "left").select("content", "first", F.coalesce("component", "content").alias("group")), "named", gathered=True)
    lowest = scratch.written(named.groupBy("group").agg(F.min("first").alias("lowest")), "lowest", gathered=True)
    of = scratch.written(named.join(lowest, "group").select("content", "lowest"), "components", gathered=True)
    gone = rows.join(of, "content").where(F.col("id") != F.col("lowest")).select(F.col("id").alias("__gone")).distinct()
    return _once(docs.join(gone, docs[id_col] == gone["__gone"], "left_anti"), id_col, text)
