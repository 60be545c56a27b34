"""Token ids in binary files: tokenise, count, encode by rANS, and read back.

write() lays down two tables under a path: ``segments``, rows of whole
documents in ascending id order, each with its index (ids and lengths of its
documents, number of ids before it) and its payload (see rans.py); and
``model``, the shared frequency table (id, freq). Spark's own commit protocol
makes the files whole when tasks are repeated. read() gives a row per document,
documents() the ids themselves.

A document's ids are those of its whole text and the end id. Equal words are
encoded once: texts are cut where the tokenizer's own pattern parts pieces,
unseen words are encoded in bulk, and a bounded table keeps their ids; the ids
of a batch of texts are then gathered from it as arrays.

Defined cases: a null or empty text has the end id alone; repeated rows are
documents of their own, in order of their text's hash; a null id comes first.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from shutterlake import scratch
from shutterlake.llm import rans

#: The byte-level split pattern of the vocabulary's tokenizer (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_PIECES = 1_200_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Controls that are white space to one regular expression library and not to another.
_CONTROL_SPACE = regex.compile("[\x1c-\x1f]")
#: White space but single spaces and line ends.
ODD_SPACE = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BYTES_AT_ONCE = 8_000_000
_PUNCTUATION = string.punctuation
#: The byte-level alphabet: bytes that print stand for themselves, the others, in order, for the characters from 256 on. All bytes are keys, since a missing one costs an exception.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: b for b in _SHOWN} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_BLANK = chr(_BYTES[32])
_encoders: dict[tuple[str, int], "Encoder"] = {}


class Units:
    """Ids of distinct strings, one behind the other, in a bounded table."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int, dtype: np.dtype):
        self.encode, self.kept, self.dtype = encode, kept, dtype
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.sizes, self.starts, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.dtype), 0

    def _learn(self, strings: list[str]) -> None:
        ids, sizes = self.encode(strings)
        n, at = len(self.places), len(self.places) + len(strings)
        while at > len(self.sizes):
            self.sizes, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.starts))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.sizes[n:at], self.starts[n:at] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.places.update(zip(strings, range(n, at)))

    def at(self, place: int) -> list[int]:
        """Ids of the string of a place."""
        start = self.starts[place]
        return self.ids[start : start + self.sizes[place]].tolist()

    def of(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings, number of ids of each)."""
        distinct = coded.dictionary.to_pylist()
        known = self.places.get
        place = np.fromiter((known(x, -1) for x in distinct), np.int64, len(distinct))
        absent = np.flatnonzero(place < 0)
        if len(self.places) + len(absent) > self.kept:  # the table is emptied: all that is wanted is learnt anew
            self.clear()
            absent = np.arange(len(distinct))
        place[absent] = np.arange(len(self.places), len(self.places) + len(absent))
        self._learn([distinct[i] for i in absent.tolist()])
        row = place[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[row]
        ends = np.cumsum(sizes)
        take = np.repeat((self.starts[row] - ends + sizes).astype(np.int32), sizes)  # ids of one portion and of the table: far below 2^31
        take += np.arange(len(take), dtype=np.int32)
        return self.ids[take], sizes


class Encoder:
    """Ids of texts as packed little-endian bytes, with bounded tables of units and pieces.

    A text whose only white space is single spaces and line ends is cut at them:
    there the tokenizer's pattern always parts pieces. Its units are words, each
    with the space before it, or the line end. Other texts are cut by the pattern.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(SPLIT).findall
        self.line_end = self._ids("\n")
        if len(self.line_end) != 1:
            raise ValueError("a line end is not one id of the vocabulary")
        self.units = Units(self._units, kept, self.dtype)
        self.pieces = Units(self._pieces, kept // 4, self.dtype)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of strings without line ends, encoded as the lines of one text, which is cut at its line ends."""
        ids, sizes = [], []
        for at in range(0, len(lines), 20_000):
            part = lines[at : at + 20_000]
            own = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.flatnonzero(own == self.line_end[0])
            if len(cuts) != len(part) - 1:
                raise ValueError("the units of a text are not the tokenizer's own")
            ids.append(np.delete(own, cuts))
            sizes.append(np.diff(np.r_[-1, cuts, len(own)]) - 1)
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A unit that begins with a line end stands for it and the word after it, any other for a space and a word.

        Letters, with ASCII punctuation behind them at most, are two pieces of the
        pattern, which the model takes as they are; other units go through the
        pattern. Letters whose unit is in the table are not encoded again.
        """
        split, known, spaced, bare, marks = self.tokenizer.model.tokenize, self.units.places.get, {}, {}, {}
        out, rest = [], []
        for n, unit in enumerate(units):
            first = unit[0] == "\n"
            word = unit[1:] if first else unit
            stem = word.rstrip(_PUNCTUATION)
            if not stem.isalpha():
                rest.append(n)
                out.append(None)
                continue
            words = bare if first else spaced
            ids = words.get(stem)
            if ids is None:
                place = None if first else known(stem)
                if place is not None:
                    ids = self.units.at(place)
                elif stem.isascii():  # letters stand for themselves
                    ids = [t.id for t in split(stem if first else _BLANK + stem)]
                else:
                    ids = [t.id for t in split((stem if first else " " + stem).encode().decode("latin-1").translate(_BYTES))]
                words[stem] = ids
            if len(stem) < len(word):
                tail = word[len(stem) :]
                if tail not in marks:
                    marks[tail] = self._ids(tail).tolist()
                ids = ids + marks[tail]
            out.append([*self.line_end.tolist(), *ids] if first else ids)
        if rest:
            ids, sizes = self._lines([units[n][1:] if units[n][0] == "\n" else " " + units[n] for n in rest])
            for n, part in zip(rest, np.split(ids, np.cumsum(sizes)[:-1])):
                out[n] = [*self.line_end.tolist(), *part.tolist()] if units[n][0] == "\n" else part.tolist()
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), self.dtype, int(sizes.sum())), sizes

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((not p.isspace() for p in pieces), bool, len(pieces))
        ids, sizes = self._lines([p for p, x in zip(pieces, plain) if x])
        own = iter(np.split(ids, np.cumsum(sizes)[:-1]))
        parts = [next(own) if x else self._ids(p) for p, x in zip(pieces, plain)]
        return np.concatenate([np.zeros(0, self.dtype), *parts]), np.array([len(x) for x in parts], np.int64)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id behind it, number of ids of each text with its end)."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # Each text begins with a line end of its own, whose id gives way to the end id of the text before.
        text = pa.scalar("", pa.large_string())
        lines = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), texts, text), "\n", " \n")
        words = pc.split_pattern(pc.utf8_slice_codeunits(lines, 1), " ")
        coded = words.flatten().dictionary_encode()
        edges = np.asarray(words.offsets)
        edges = edges - edges[0]
        simple = self._simple(coded, edges)
        if not simple.all():
            return self._mixed(texts, simple, end)
        ids, sizes = self.units.of(coded)
        ends = np.r_[0, np.cumsum(sizes)][edges]
        ids = np.r_[ids[1:], self.dtype.type(end)]
        ids[ends[1:-1] - 1] = end
        return ids, np.diff(ends)

    def _simple(self, coded: pa.DictionaryArray, edges: np.ndarray) -> np.ndarray:
        """True for each text that has no white space but single spaces and line ends, and no special piece; units tell, since a space too many makes an empty one."""
        units = coded.dictionary
        odd = pc.or_(pc.match_substring_regex(units, ODD_SPACE), pc.or_(pc.equal(units, ""), pc.equal(units, "\n")))
        for part in self.special:
            odd = pc.or_(odd, pc.match_substring(units, part))
        if not pc.any(odd).as_py():
            return np.ones(len(edges) - 1, bool)
        found = np.asarray(odd.to_numpy(zero_copy_only=False), dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        return np.diff(np.r_[0, np.cumsum(found)][edges]) == 0

    def _mixed(self, texts: pa.Array, simple: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        ids, n = self.encode(texts.filter(pa.array(simple)), end)
        own = iter(np.split(ids, np.cumsum(n)[:-1]))
        rest = self._odd(texts.filter(pa.array(~simple)).to_pylist(), end)
        out = [next(own) if x else next(rest) for x in simple]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _odd(self, texts: list[str], end: int) -> Iterator[np.ndarray]:
        """Ids of texts with other white space: by the pieces of the pattern, or as a whole where two kinds of white space would part."""
        for text in texts:
            whole = _CONTROL_SPACE.search(text) is not None or any(s in text for s in self.special)
            own = self._ids(text) if whole else self.pieces.of(pa.array(self.find(text), pa.large_string()).dictionary_encode())[0]
            yield np.r_[own, self.dtype.type(end)]


def encoder(path: str, kept: int = KEPT_PIECES) -> Encoder:
    if (path, kept) not in _encoders:
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The two columns of the batches in portions of about _BYTES_AT_ONCE of text; a longer text is a portion of its own."""
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + _BYTES_AT_ONCE - size, side="right")))
            held.append(batch.slice(at, to - at))
            size += int(sizes[to - 1]) - before
            if to < batch.num_rows or size >= _BYTES_AT_ONCE:
                yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
                held, size = [], 0
            at = to
    if held:
        yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text: str, end_id: int, kept: int = KEPT_PIECES) -> DataFrame:
    """(shard, seq, id, n, before, ids, counts) in id order; counts is set in a shard's last row."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = src.schema["id"].dataType
    ordered = src.repartitionByRange("id").sortWithinPartitions(F.col("id"), F.xxhash64("text"))
    schema = f"shard int, seq long, id {kind.simpleString()}, n long, before long, ids binary, counts array<struct<id:int,n:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, seq, before = encoder(tokenizer, kept), TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(max(enc.size, end_id + 1), dtype=np.int64)
        counts_type = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))

        def packed(doc_ids: pa.Array, ids: np.ndarray, n: np.ndarray, tail=None) -> pa.RecordBatch:
            nonlocal seq, before
            starts, edges = before + np.cumsum(n) - n, np.r_[0, np.cumsum(n)] * enc.dtype.itemsize
            at = np.arange(seq, seq + len(n))
            seq, before = seq + len(n), before + int(n.sum())
            rows = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids)])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), pa.array(at), doc_ids, pa.array(n), pa.array(starts), rows, pa.array([None] * (len(n) - 1) + [tail], counts_type)], names=["shard", "seq", "id", "n", "before", "ids", "counts"])

        held = None  # the last rows wait, to take the counts
        for doc_ids, texts in _portions(batches):
            ids, n = enc.encode(texts, end_id)
            counts += np.bincount(ids, minlength=len(counts))
            if held is not None:
                yield packed(*held)
            held = (doc_ids, ids, n)
        if held is not None:
            seen = np.flatnonzero(counts)
            yield packed(*held, [{"id": int(i), "n": int(counts[i])} for i in seen])

    return ordered.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2, segment_ids: int = rans.BLOCK_IDS, kept: int = KEPT_PIECES) -> None:
    """kept: strings whose ids a Python worker holds at most, some 150 bytes each."""
    spark = docs.sparkSession
    batch = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, 1000)
    try:
        rows = scratch.written(tokenised(docs, tokenizer, id_col, text, end_id, kept), "tokens")
    finally:
        spark.conf.set(_BATCH, batch)
    # One row per shard, and one per id of the vocabulary.
    totals = sorted((r.shard, r.n) for r in rows.groupBy("shard").agg(F.sum("n").alias("n")).collect())
    offsets = dict(zip((s for s, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist()))
    counted = rows.where("counts is not null").select(F.explode("counts").alias("c")).groupBy(F.col("c.id").alias("id")).agg(F.sum("c.n").alias("n")).collect()
    counts = np.zeros(max([r.id for r in counted], default=0) + 1, dtype=np.int64)
    for r in counted:
        counts[r.id] = r.n
    freq = rans.scaled(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, freq long").coalesce(1).write.parquet(f"{path}/model")
    shared = spark.sparkContext.broadcast((freq, offsets))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"shard int, seq long, start long, n_ids long, doc_ids array<{kind}>, lengths array<bigint>, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, dtype = rans.Table(shared.value[0]), encoder(tokenizer, kept).dtype
        open_, size = [], 0

        def close() -> pa.RecordBatch:
            shard, seq, _, _, before, _ = open_[0]
            ids = np.frombuffer(b"".join(r[5] for r in open_), dtype=dtype)
            row = [[shard], [seq], [shared.value[1][shard] + before], [len(ids)], [[r[2] for r in open_]], [[r[3] for r in open_]], [rans.encode(ids, table)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary()))], names=["shard", "seq", "start", "n_ids", "doc_ids", "lengths", "payload"])

        id_type = None
        for batch in batches:
            id_type = batch.column(2).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ and (size >= segment_ids or (row[0], row[1]) != (open_[-1][0], open_[-1][1] + 1)):
                    yield close()
                    open_, size = [], 0
                open_.append(row)
                size += row[3]
        if open_:
            yield close()

    rows.select("shard", "seq", "id", "n", "before", "ids").mapInArrow(run, schema).write.parquet(f"{path}/segments")
    scratch.drop(rows)


def _model(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/model").collect()
    freq = np.zeros(max([r.id for r in rows], default=0) + 1, dtype=np.int64)
    for r in rows:
        freq[r.id] = r.freq
    return freq


def documents(spark: SparkSession, path: str, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    freq = spark.sparkContext.broadcast(_model(spark, path))
    segments = spark.read.parquet(f"{path}/segments").select("start", "doc_ids", "lengths", "payload")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    names = [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq.value)
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.array(batch.column(2)[i].as_py(), dtype=np.int64)
                ids = rans.decode(batch.column(3)[i].as_py(), table)
                edges = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges.tolist(), edges[1:].tolist())]
                cols = [batch.column(1)[i].values, pa.array(batch.column(0)[i].as_py() + edges[:-1]), pa.array(lengths), pa.array(sums, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return segments.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2, kept: int = KEPT_PIECES) -> DataFrame:
    """Write the token files of docs in the shared folder and read their index and checksums back."""
    path = scratch.new_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, id_col, text, end_id, kept=kept)
    return documents(docs.sparkSession, path, with_ids=False, id_col=id_col)
