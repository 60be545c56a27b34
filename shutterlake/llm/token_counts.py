"""Token counts under a unigram model: dynamic programming over a trie of pre-tokens.

A pre-token is a word with the word mark before it. Its count is the number of
pieces of its best segmentation, found by forward scores: best[j] is the best
score of the first j characters. Distinct pre-tokens are taken in sorted order,
which walks their trie depth first: the scores of a shared prefix stay on the
stack and are computed once, and each word's terminal count is stored. Nothing
is shuffled; a task holds at most KEPT_WORDS terminal counts.

Scores come from the order of a public vocabulary: piece r of n has probability
in proportion to 1 / (r + 2.7) (a Zipf law), and a character outside every
piece costs one byte piece for each of its UTF-8 bytes. Of equal scores the
segmentation with the longer last piece wins.

Defined cases: null and blank texts have no pre-tokens and no tokens; repeated
rows are counted each; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
KEPT_WORDS = 300_000
_BYTES_AT_ONCE = 4_000_000
_models: dict[str, "Unigram"] = {}


class Unigram:
    def __init__(self, pieces: list[str]):
        weight = [1.0 / (r + 2.7) for r in range(len(pieces))]
        log_sum = math.log(sum(weight))
        self.score = {p: math.log(w) - log_sum for p, w in zip(reversed(pieces), reversed(weight))}
        self.longest = max(map(len, self.score), default=1)
        self.byte = min(self.score.values(), default=0.0) - 10.0
        self.counts: dict[bytes, int] = {}

    @classmethod
    def of(cls, path: str) -> "Unigram":
        if path not in _models:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            plain = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
            _models[path] = cls([model.id_to_piece(i) for i in plain])
        return _models[path]

    def learn(self, words: set[bytes]) -> None:
        """Store the counts of words, walking their trie."""
        score, longest, byte, counts = self.score.get, self.longest, self.byte, self.counts
        best, pieces, before = [0.0], [0], ""
        for word, raw in sorted((MARK + w.decode("utf-8", "replace"), w) for w in words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                extra = len(word[j - 1].encode())
                top, n = -math.inf, 0
                for i in range(max(0, j - longest), j):
                    s = score(word[i:j])
                    if s is not None and best[i] + s > top:
                        top, n = best[i] + s, pieces[i] + 1
                if best[j - 1] + extra * byte > top:
                    top, n = best[j - 1] + extra * byte, pieces[j - 1] + extra
                best.append(top)
                pieces.append(n)
            counts[raw] = pieces[-1]
            before = word

    def count(self, texts: list[list[bytes]]) -> list[int]:
        words = set().union(*texts)
        missing = words.difference(self.counts)
        if len(self.counts) + len(missing) > KEPT_WORDS:
            self.counts.clear()
            missing = words
        self.learn(missing)
        get = self.counts.__getitem__
        return [sum(map(get, t)) for t in texts]


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens) of every row."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = Unigram.of(model)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, to = [], 0, at
                while to < batch.num_rows and size < _BYTES_AT_ONCE:
                    raw = (batch.column(1)[to].as_py() or "").encode("utf-8", "replace")
                    texts.append(raw.split())
                    size, to = size + len(raw), to + 1
                n = [len(t) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(unigram.count(texts), pa.int64())], names=[id_col, "n_pretokens", "n_tokens"])
                at = to

    return src.mapInArrow(run, f"`{id_col}` {kind}, n_pretokens long, n_tokens long")
