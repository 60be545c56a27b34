"""Small cases with known results."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shutterlake import scratch
from shutterlake.functions import columns as C
from shutterlake.operators import blocks, catalog, clustering, faces, history, refresh
from shutterlake.operators.numbering import numbered


def test_bridge_merges_groups(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, None), (3, 0x7FF, None), (4, 0x7FF, None), (5, 0x3FF, None)], "id long, bits long, day long")
    got = {r.id: r.group_id for r in clustering.groups(clustering.duplicate_pairs(df, 10)).collect()}
    assert got == {i: 1 for i in range(1, 6)}


def test_date_veto(spark):
    df = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, None), (4, 9 << 40, 1)], "id long, bits long, day long")
    assert {(r.a, r.b) for r in clustering.duplicate_pairs(df, 3).collect()} == {(1, 3), (2, 3)}


def test_hamming_is_exact(spark):
    rng = random.Random(2)
    rows = [(i, rng.getrandbits(12) | (rng.getrandbits(4) << 59)) for i in range(80)]
    df = spark.createDataFrame([(i, b if b < 1 << 63 else b - (1 << 64)) for i, b in rows], "id long, bits long")
    for most in (0, 2, 5):
        got = {(r.a, r.b, r.distance) for r in blocks.hamming_pairs(df, most).collect()}
        assert got == {(a, b, bin(x ^ y).count("1")) for a, x in rows for b, y in rows if a < b and bin(x ^ y).count("1") <= most}


def test_bands_are_not_broadcast(spark):
    """A written table is small; the variants of its rows, hundreds each, must not be built in the driver."""
    df = scratch.written(spark.range(200).select("id", F.xxhash64("id").alias("bits")), "prints")
    for pairs in (blocks.hamming_pairs(df, 17), blocks.hamming_pairs(df.withColumn("new", F.col("id") < 9), 17, new="new")):
        assert pairs.count() >= 0
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 6))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    u = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 1e-8, np.linalg.norm(v, axis=1, keepdims=True), 1)
    s = u @ u.T
    got = {(r.a, r.b) for r in blocks.cosine_pairs(df, 0.5, block_rows=9).collect()}
    assert got == {(i, j) for i in range(50) for j in range(i + 1, 50) if s[i, j] >= 0.5}
    best = {r.id: r.best for r in blocks.cosine_best(df.where("id < 20"), df.where("id >= 20"), block_rows=7).collect()}
    assert best == {i: int(20 + np.argmax(np.round(s[i, 20:], 12))) for i in range(20)}


def test_purify_splits_orthogonal_packs():
    a, b = [1.0, 0.05, 0.0], [0.0, 0.0, 1.0]
    frame = pd.DataFrame({"id": range(4), "label": [3] * 4, "vector": [a, a, b, b]})
    assert clustering.purify(frame)["part"].tolist() == [0, 0, 1, 1]
    assert set(clustering.purify(frame.assign(label=-1))["part"]) == {0}
    assert set(clustering.purify(frame, most_rows=3)["part"]) == {0}


def test_noise_becomes_singletons(spark):
    df = spark.createDataFrame([(5, -1), (1, 0), (9, -1), (2, 3)], "id long, label long")
    assert {tuple(r) for r in faces.noise_to_singletons(df).collect()} == {(1, 0), (2, 3), (5, 4), (9, 5)}


def test_auto_ignore_cases(spark):
    schema = "id long, photo_id long, w long, h long, det_score double"
    df = spark.createDataFrame([(1, 1, 130, 130, 0.9), (2, 1, 40, 40, 0.9), (3, 1, 20, 20, 0.9), (4, 2, 25, 25, 0.9), (5, 2, 15, 15, 0.9), (6, 3, 200, 200, 0.4)], schema)
    sizes = spark.createDataFrame([(1, 1000, 600), (2, 300, 300), (3, 1000, 1000)], "photo_id long, width long, height long")
    assert {r.id: r.auto_ignored for r in faces.auto_ignore(df, sizes).collect()} == {1: False, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_suggestion_tiers_first_wins(spark):
    schema = "id long, cluster_id long, person_id long, suggestion_person_id long, suggestion_score double, photo_id long, w long, h long, ignored boolean"
    place = [(1, 9, 9, False), (1, 5, 5, False), (2, 9, 9, False), (1, 8, 8, False)]
    df = spark.createDataFrame([r + p for r, p in zip([(1, 1, None, None, None), (2, 2, None, None, None), (3, 1, 7, None, None), (4, 3, 5, None, None)], place)], schema)
    best = lambda rows: spark.createDataFrame(rows, "cluster_id long, person_id long, score double")
    once = faces.apply_suggestions(df, best([(1, 4, 0.65), (2, 5, 0.95)]), faces.Tiers())
    # Face 2 is named at once, and ignored: face 4 of that person in its photo is larger.
    assert {(*r[:5], r.ignored) for r in once.collect()} == {(1, 1, None, 4, 0.65, False), (2, 2, 5, None, None, True), (3, 1, 7, None, None, False), (4, 3, 5, None, None, False)}
    assert {tuple(r) for r in faces.apply_suggestions(once, best([(1, 9, 0.9)]), faces.Tiers()).collect()} == {tuple(r) for r in once.collect()}


def test_edits(spark):
    schema = "photo long, state_json string"
    hist = "id long, photo long, operation string, state_json string, created_at timestamp_ntz"
    current = spark.createDataFrame([(1, "{}"), (2, "{}")], schema)
    old = spark.createDataFrame([(i, 1, "op", "{}", None) for i in range(60)], hist)
    edit = spark.createDataFrame([(1, False, 60, "reset", "{}", None), (3, True, 61, "bw", '{"bw":1}', None)], "photo long, modified boolean, id long, operation string, state_json string, created_at timestamp_ntz")
    now, then = history.save_edit(current, old, edit)
    assert {r.photo for r in now.collect()} == {2, 3}
    assert sorted(r.id for r in then.where("photo = 1").collect()) == list(range(11, 61))
    bad = spark.createDataFrame([(1, 5, "a", "{", None), (2, 5, "b", "{}", None)], hist)
    assert [r.id for r in history.latest(bad, 5).collect()] == [2]


def test_columns(spark):
    r = spark.range(1).select(
        C.subsecond_micros(F.lit("05")).alias("sub"), C.degrees(F.lit(48), F.lit(30), F.lit(36), F.lit("S")).alias("gps"), C.exposure_text(F.lit(2.5)).alias("long"), C.exposure_text(F.lit(0.008)).alias("short"),
        C.aperture_text(F.lit(4)).alias("f"), C.version_parts(F.lit("v1.20.3b")).alias("v"), C.hex_rgb(F.lit("#ff8000")).alias("rgb"), C.split_tags(F.lit(" a, b ,,a")).alias("tags"),
        C.moved(F.lit("/a_b/c"), "/a_b", "/z").alias("p"), C.moved(F.lit("/aXb/c"), "/a_b", "/z").alias("q"), C.segment_distance(*map(F.lit, (0.0, 5.0, -1.0, 0.0, 1.0, 0.0))).alias("d"), C.size_text(F.lit(1536)).alias("size"),
    ).first()
    assert (r["sub"], round(r.gps, 2), r.long, r.short, r.f, r.v, tuple(r.rgb), r.tags, r.p, r.q, r.d, r["size"]) == (50_000, -48.51, "2.5 s", "1/125 s", "f/4.0", [1, 20, 3], (255, 128, 0), ["a", "b"], "/z/c", "/aXb/c", 5.0, "1 KB")


def test_upsert_keeps_user_columns(spark):
    schema = "id long, path string, file_size long, rating long, is_favorite boolean, tags array<string>, duplicate_group_id long"
    old = spark.createDataFrame([(1, "/a", 1, 4, True, ["x"], 3)], schema)
    new = spark.createDataFrame([(8, "/a", 2, 0, False, [], None), (9, "/b", 5, 0, False, [], None)], schema)
    assert {(r.id, r.path, r.file_size, r.rating, r.is_favorite, tuple(r.tags), r.duplicate_group_id) for r in catalog.upsert(old, new).collect()} == {(1, "/a", 2, 4, True, ("x",), 3), (9, "/b", 5, 0, False, (), None)}


def test_image_hash():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (64, 64)).astype(float)
    bits, micro = clustering.fingerprint_image(a)
    again, _ = clustering.fingerprint_image(a * 1.1 + 3)
    assert bin(bits ^ again).count("1") <= 2 and micro.shape == (8, 8)
    assert clustering.fingerprint_image(np.full((20, 20), 9.0))[1] is None
    d = rng.integers(0, 256, (20, 32), dtype=np.uint8)
    assert clustering.keypoint_matches(d, d) == 20


def test_face_changes(spark):
    schema = "id long, photo_id long, x long, w long, h long, cluster_id long, person_id long, suggestion_person_id long, suggestion_score double, ignored boolean, pinned boolean"
    df = spark.createDataFrame([(1, 1, 5, 9, 9, 3, 7, None, None, False, False), (2, 1, 2, 9, 9, 3, None, None, None, False, True), (3, 2, 0, 9, 9, -4, 8, None, None, False, True)], schema)
    ids = spark.createDataFrame([(1,)], "id long")
    row = lambda d, i: d.where(f"id = {i}").first()
    r = row(faces.unassign_faces(df, ids), 1)
    assert (r.person_id, r.cluster_id, r.pinned) == (None, None, False)
    assert row(faces.unassign_from_cluster(df, 3, 7), 1).person_id is None and row(faces.unassign_from_cluster(df, 3, 7), 3).person_id == 8
    r = row(faces.isolate_and_assign(df, ids, 9), 1)
    assert (r.person_id, r.cluster_id, r.pinned) == (9, -5, True)
    r = row(faces.isolate_and_suggest(df, ids, spark.createDataFrame([(1, 6, 0.8), (2, 6, 0.9)], "id long, person_id long, score double"), 0.5), 1)
    assert (r.cluster_id, r.person_id, r.suggestion_person_id) == (-5, None, 6)
    assert [x.id for x in faces.panel_order(df).collect()] == [3, 1, 2]
    assert faces.delete_faces(df, ids).count() == 2
    best = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "cluster_id long, person_id long")
    sizes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 9)], "cluster_id long, n long")
    assert [tuple(r) for r in faces.regrouped_singletons(best, sizes).collect()] == [(5, [1, 2])]


def test_refresh_groups_like_clusters(spark):
    rows = [(1, 1, None, 1.0, 0.0), (2, 2, None, 0.99, 0.1), (3, 3, None, 0.0, 1.0), (4, 9, 7, 0.95, 0.2), (5, 9, 7, 0.9, 0.25), (6, 4, None, -1.0, 0.0)]
    f = spark.createDataFrame([(i, i, c, p, None, None, False, False, True, 5, 5) for i, c, p, *_ in rows], "id long, photo_id long, cluster_id long, person_id long, suggestion_person_id long, suggestion_score double, ignored boolean, pinned boolean, has_embedding boolean, w long, h long")
    v = spark.createDataFrame([(i, [x, y]) for i, _, _, x, y in rows], "face_id long, embedding array<double>")
    view = refresh.grouped(f, v)
    got = {r.cluster_id: (r.n, r.group_id, r.person_id, r.tier) for r in view.collect()}
    assert got == {1: (1, 1, 7, "assign"), 2: (1, 1, 7, "assign"), 3: (1, 3, 7, "none"), 4: (1, 4, 7, "none")}
    after = {r.id: r.person_id for r in refresh.promoted(f, view).collect()}
    assert after == {1: 7, 2: 7, 3: None, 4: 7, 5: 7, 6: None}
    assert refresh.changed_since(f, 3) and not refresh.changed_since(f, 4)


def test_numbers_without_one_task(spark):
    df = spark.range(1000).where("id % 3 = 0").withColumnRenamed("id", "k")
    assert [(r.k, r.n) for r in numbered(df, "k").orderBy("k").collect()] == [(3 * i, i + 1) for i in range(334)]
    assert numbered(df.where("false"), "k").count() == 0


def test_best_by_blocks_and_by_matrix_agree(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([None, i % 7])) for i in range(60)]
    left = spark.createDataFrame(rows, "id long, vector array<double>, ban long")
    right = spark.createDataFrame([(i, v) for i, v, _ in rows[:7]], "id long, vector array<double>")
    whole = sorted(map(tuple, blocks.cosine_best(left, right, exclude="ban").collect()))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    assert whole == sorted(map(tuple, blocks.cosine_best(left, right, exclude="ban", block_rows=10).collect()))


def test_groups_of_prints_match_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, 0x3FF, 0x7FF, rng.getrandbits(62)]), rng.choice([None, 1, 1, 2])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, bits long, day long")
    want = {(r.id, r.group_id) for r in clustering.groups(clustering.duplicate_pairs(df, 10)).collect()}
    assert {(r.id, r.group_id) for r in clustering.print_groups(df, 10).collect()} == want


def test_large_clusters_are_cut_up(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(60, 3)), 1)
    frame = pd.DataFrame({"id": range(60), "label": 1, "vector": v.tolist()})
    whole = clustering.purify(frame)
    assert whole["part"].nunique() > 5
    for size in (0, 60 * 8 * 7):  # one row of distances at a time, and seven
        monkeypatch.setattr(clustering, "MATRIX_ROWS", 10)
        monkeypatch.setattr(clustering, "ROW_BYTES", size)
        assert list(clustering.purify(frame)["part"]) == list(whole["part"])
    monkeypatch.undo()
    # 2,400 rows of two directions, one of three labels null or noise
    rows = [(i, 5, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(2400)] + [(2400, -1, [1.0, 0.0]), (2401, None, [1.0, 0.0]), (2402, 6, [1.0, 0.0])]
    got = {r.id: (r.label, r.part) for r in clustering.purified(spark.createDataFrame(rows, "id long, label long, vector array<double>")).collect()}
    assert got == {i: (n, int(n == 5 and i % 3 > 0)) for i, n, _ in rows}
