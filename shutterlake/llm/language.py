"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is lower-cased, ASCII non-letters become spaces, and its UTF-8 byte
n-grams of 1 to 3 are hashed into DIMS places. Weights are log(1 + count) times
the inverse document frequency, taken over all training rows, and vectors have
length 1. Each language has up to ``centroids`` centroids, from spherical
k-means over a bounded sample of its training rows (``sample`` rows a language,
in expectation, by hash of the id). A text gets the language of the nearest
centroid by cosine; ``rejected`` says that the cosine is below what all but 1 %
of that centroid's own sample reach.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if there is nothing to learn from. Rows of a null language are
not learnt from. Repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

DIMS = 4096
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_CHUNK = 1 << 22


@dataclass(frozen=True)
class LanguageConfig:
    centroids: int = 4
    sample: int = 600
    rounds: int = 12


def counts_of(text: str) -> np.ndarray:
    """Counts of the hashed byte n-grams of a text."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SPACES) + b" ", dtype=np.uint8)
    out = np.zeros(DIMS, dtype=np.int64)
    for at in range(0, len(data), _CHUNK):
        b = data[at : at + _CHUNK + 2].astype(np.uint32)
        for n, code in ((1, b), (2, b[:-1] << 8 | b[1:]), (3, b[:-2] << 16 | b[1:-1] << 8 | b[2:])):
            own = code[: min(_CHUNK, len(code))]
            out += np.bincount(((own + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    v = np.log1p(np.array([counts_of(t) for t in texts], dtype=np.float32).reshape(len(texts), DIMS)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def spherical_means(v: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1 and the nearest one of each row; the first is nearest the mean, others are far from those before."""
    picks = [int(np.argmax(v @ v.mean(axis=0)))]
    while len(picks) < min(k, len(v)):
        near = (v @ v[picks].T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        picks.append(int(np.argmin(near)))
    c = v[picks].copy()
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c, np.argmax(v @ c.T, axis=1)


def fit(train: DataFrame, order: Column, text: str = "text", lang: str = "lang", config: LanguageConfig = LanguageConfig()) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(idf, languages, centroids, least cosines) from labelled rows; order: a hash column that picks the sample."""
    rows = train.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), order.alias("order")).where("lang is not null and text is not null")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df += counts_of(t.as_py()) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS), pa.int32()), pa.array(np.r_[n, df])], names=["place", "n"])

    summed = rows.select("text").mapInArrow(places, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows
    df = np.zeros(DIMS + 1)
    for r in summed:
        df[r.place] = r.n  # place -1: the number of rows
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return idf, [], np.zeros((0, DIMS), np.float32), np.zeros(0)
    share = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == name, min(1.0, config.sample / n)).otherwise(share)
    some = rows.where(F.shiftrightunsigned("order", 11).cast("double") * F.lit(2.0**-53) < share)

    def means(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", "text"], kind="stable")
        v = vectors(frame["text"].tolist(), idf)
        c, own = spherical_means(v, config.centroids, config.rounds)
        least = [float(np.quantile((v[own == j] @ c[j]), 0.01)) if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "k": range(len(c)), "centroid": [x.tolist() for x in c], "least": least})

    found = some.groupBy("lang").applyInPandas(means, "lang string, k int, centroid array<float>, least double").collect()  # centroids rows a language
    found.sort(key=lambda r: (r.lang, r.k))
    return idf, [r.lang for r in found], np.array([r.centroid for r in found], np.float32).reshape(-1, DIMS), np.array([r.least for r in found])


def predict(docs: DataFrame, model: tuple, id_col: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, columns of keep, lang_pred, score, rejected) of every row."""
    keep = keep or {}
    src = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{id_col}`"), *(c.alias(n) for n, c in keep.items()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centroids, least = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(0).to_pylist()
                told = [i for i, t in enumerate(texts) if t and langs and _LETTER.search(t)]
                lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if told:
                    cos = vectors([texts[i] for i in told], idf) @ centroids.T
                    for i, j, c in zip(told, cos.argmax(axis=1).tolist(), cos.max(axis=1).tolist()):
                        lang[i], score[i], rejected[i] = langs[j], round(min(1.0, max(0.0, c)), 6), bool(c < least[j])
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang), pa.array(score), pa.array(rejected)], names=[*batch.schema.names[1:], "lang_pred", "score", "rejected"])

    return src.mapInArrow(run, f"{passed}, lang_pred string, score double, rejected boolean")
