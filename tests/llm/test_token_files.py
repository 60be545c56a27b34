import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from shutterlake import scratch
from shutterlake.llm import rans, token_files
from shutterlake.llm.op07_tokens import tokenizer_path


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=800), st.integers(1, 9), st.integers(50, 400))
def test_rans_round_trip(ids, lanes, block):
    ids = np.array(ids, dtype=np.uint32)
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=301)))
    payload = rans.encode(ids, table, block_ids=block, lanes=lanes)
    assert rans.decode(payload, table).tolist() == ids.tolist()


def test_skewed_counts_and_checksum():
    counts = np.ones(60_000, dtype=np.int64)
    counts[5] = 10**12
    freq = rans.scaled(counts)
    assert freq.sum() == rans.SCALE and freq.min() == 1
    ids = np.r_[np.full(5000, 5), np.arange(60_000)].astype(np.uint32)
    payload = bytearray(rans.encode(ids, rans.Table(freq)))
    assert (rans.decode(bytes(payload), rans.Table(freq)) == ids).all()
    payload[-3] ^= 1
    with pytest.raises((ValueError, IndexError)):
        rans.decode(bytes(payload), rans.Table(freq))


def test_files_match_plain_encoding(spark, monkeypatch):
    tokenizer = token_files.encoder(tokenizer_path()).tokenizer
    texts = [None, "", " ", "Hello  world\n\n it's  1234!", "ÉÀ ñandú   日本語 😀😀", "a <|endoftext|> b", "x" * 3000, "the cat " * 20_000, "\t\t  end  ", "a\x1c b\x1f", "it's\u00a0 x\u2028\n\n\t y", " ' \" 's's ..\n.", "\r\n \r\n z", "one two, three.\nFour's (five) 6 7th é! \u00b2x\nñ", "a\tb c\u00a0d e", "don't ... 're we'll?!"]
    rows = [(i * 7 % 31, t) for i, t in enumerate(texts)] + [(7, "again"), (7, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n", "3 AS shard").repartition(3)
    path = scratch.new_path(spark, "test-tokens")
    token_files.write(df, path, tokenizer_path(), segment_ids=1000)
    got = token_files.documents(spark, path).orderBy("start").collect()
    want = sorted(((i, t, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, *_ in want]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), ids) for i, _, ids in want)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.round_trip(df, tokenizer_path()).count() == 0


def test_known_letters_are_not_encoded_again(monkeypatch):
    """Letters met before go to the model once, whatever punctuation follows them; every id stays the tokenizer's own."""
    enc = token_files.Encoder(tokenizer_path())
    own, asked = enc.tokenizer, []

    class Model:
        def tokenize(self, piece):
            asked.append(piece)
            return own.model.tokenize(piece)

    class Watched:
        model = Model()

        def __getattr__(self, name):
            return getattr(own, name)

    monkeypatch.setattr(enc, "tokenizer", Watched())
    for text in ("x zyxwv ñandú zyxwv\nzyxwv", "x zyxwv, zyxwv.\nzyxwv! ñandú?", "y ñandú. ÿĀﬁ ªº ñ² zyxwv!?"):
        ids, n = enc.encode(token_files.pa.array([text]), 2)
        assert ids.tolist() == own.encode(text, add_special_tokens=False).ids + [2] and n.tolist() == [len(ids)]
    spaced = [x for x in asked if x.endswith("zyxwv") and x != "zyxwv"]
    assert len(spaced) == 1 and len([x for x in asked if x.endswith("andÃº")]) == 1
