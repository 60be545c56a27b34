import random

from shutterlake.llm import simhash


def test_blocks_hold_every_pair_within_the_bits():
    rng = random.Random(3)
    for bits in (1, 2, 3):
        for _ in range(200):
            fp = rng.getrandbits(64)
            other = fp
            for at in rng.sample(range(64), bits):
                other ^= 1 << at
            assert set(simhash.block_keys(fp, bits)) & set(simhash.block_keys(other, bits))


def test_fingerprints_alone_link_near_copies(spark, monkeypatch):
    """Without MinHash keys texts of fingerprints within two bits are still found."""
    monkeypatch.setattr(simhash, "KEYS", 0)
    rng = random.Random(5)
    words = ["w%d" % rng.randrange(10**6) for _ in range(600)]
    near = next(t for k in range(600) for t in [words[:k] + ["changed"] + words[k + 1 :]] if bin(simhash.fingerprint(" ".join(words), 5) ^ simhash.fingerprint(" ".join(t), 5)).count("1") <= 2)
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "quite another text of some more words"), (4, None), (5, "")]
    got = simhash.kept_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4]
