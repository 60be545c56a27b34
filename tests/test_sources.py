import json

from shutterlake.functions import images
from shutterlake.functions.extensions import EventBus, Extensions, Processor
from shutterlake.sources import files, snapshots
from pyspark.sql import functions as F
import numpy as np
import pytest


def test_scan_prunes(spark, tmp_path):
    for p in ("a/one.jpg", "a/two.MP4", "a/.hidden.jpg", ".cache/x.jpg", "a/Originals/o.jpg", "my_assets/n.png", "a/note.txt", "b/VIDEO_TS/v.vob"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = files.scan(spark, str(tmp_path))
    assert {r.path.removeprefix(str(tmp_path)) for r in got.collect()} == {"/a/one.jpg", "/a/two.MP4", "/b/VIDEO_TS/v.vob"}
    assert [r.folder.removeprefix(str(tmp_path)) for r in files.dvd_folders(got).collect()] == ["/b"]


def test_journal(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"ts": 1.5, "thread": "scan", "event": "START"}\nnot json\n{"ts": 2, "thread": "scan", "event": "END", "elapsed_ms": 7}\n')
    rows = files.journal(spark, str(tmp_path / "j.jsonl"))
    assert [(r.ts, r.event) for r in rows.orderBy("ts").collect()] == [(1.5, "START"), (2.0, "END")]
    assert files.rotated(rows, 1, 1).collect()[0].ts == 2.0
    files.export_journal(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["wall", "thread", "tid", "event", "elapsed_ms", "msg"]


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.ini").write_text("[Contacts2]\nab12=Ann;;\n[one.jpg]\nfaces=rect64(3f845bcb59418507),ab12;rect64(0000000080008000),ff\nrotate=rotate(1)\nfilters=crop64=1,abc;tilt=1,0.5;tilt=1,0.7;\n[two.jpg]\nstar=yes\n")
    (tmp_path / "c.xml").write_text('<contacts><contact id="ab12" name="Ann"/><contact id="x" name=""/></contacts>')
    s = files.sidecar_sections(spark, str(tmp_path / "a.ini"))
    assert [(r.hash, r.name) for r in files.sidecar_contacts(s).collect()] == [("ab12", "Ann")]
    faces = sorted(files.sidecar_faces(s).collect(), key=lambda r: r.hash)
    assert len(faces) == 2 and abs(faces[0].box.left - 0x3F84 / 65535) < 1e-9 and abs(faces[1].box.right - 0x8000 / 65535) < 1e-9
    edit = files.sidecar_edits(s).collect()
    assert [(r.file, r.rotate, r.filters["tilt"]) for r in edit] == [("one.jpg", 1, ["1", "0.7"])]
    assert tuple(files.sidecar_stats(s).first()) == (1, 1, 1)
    assert [(r.hash, r.name) for r in files.contacts(spark, str(tmp_path / "c.xml")).collect()] == [("ab12", "Ann")]


def test_dates_and_tags(spark):
    df = spark.createDataFrame([("bad", "2024:06:15 10:00:00", None, {"a": "1"}, {"a": "2", "b": "3"})], "o string, d string, c string, x map<string,string>, y map<string,string>")
    r = df.select(files.metadata_date("o", "d", "c").cast("string").alias("t"), files.merged_tags("x", "y").alias("m")).first()
    assert r.t == "2024-06-15 10:00:00" and r.m == {"a": "1", "b": "3"}


def test_snapshots(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n long")
    assert store.read("t", df.schema).count() == 0 and store.write("t", df) == 1
    store.write("t", snapshots.newest(store.read("t"), spark.createDataFrame([("b", 5)], df.schema), "path"))
    assert {tuple(r) for r in store.read("t").collect()} == {("a", 1), ("b", 5)}
    assert store.backups("t") == [2, 1] and store.restore("t", 1) == 3
    assert {tuple(r) for r in store.read("t").collect()} == {("a", 1), ("b", 2)}
    kept = snapshots.keep_known({"t": df}, df.where("n = 1"))["t"]
    assert kept.count() == 1 and store.purge_if_version_differs("t", 1, 2) and store.read("t").count() == 0


def test_images():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (8, 12, 3), dtype=np.uint8)
    assert (images.apply_edits(a, {"brightness": 1.0, "contrast": 1.0, "saturation": 1.0, "gamma": 1.0}) == a).all()
    assert (images.rotate(images.rotate(a, 90), 270) == a).all() and images.rotate(a, 90).shape == (12, 8, 3)
    assert (images.flip(images.flip(a, True, True), True, True) == a).all()
    assert images.crop(a, 0.25, 0.25, 0.75, 0.75).shape == (4, 6, 3)
    assert (images.curve_table([(0, 0), (255, 255)]) == np.arange(256)).all()
    assert (np.diff(images.curve_table([(0, 0), (64, 30), (255, 255)]).astype(int)) >= 0).all()
    assert images.vignette(a, 0.5).sum() < a.sum() and images.black_and_white(a).std(axis=2).max() == 0
    assert images.usable_height(np.vstack([a[..., 0], np.full((4, 12), 7)])) == 8
    assert images.moved_box((1, 2, 3, 4), (10, 20), rotation=90) == (14, 1, 4, 3)
    assert images.moved_box((0, 0, 5, 5), (100, 100), crop_to=(0.04, 0, 1, 1)) is None
    red = np.zeros((4, 4, 3), np.uint8)
    red[..., 0] = 200
    assert images.red_eye(red, (0, 0, 2, 2))[0, 0, 0] == 0 and images.red_eye(red, (0, 0, 2, 2))[3, 3, 0] == 200


def test_extensions(spark, tmp_path):
    ext = Extensions()
    ext.register(Processor("negative", lambda a, p: 255 - a if p["on"] else a, {"on": True}))
    ext.activate("negative")
    df = spark.createDataFrame([(bytes(range(12)), 2, 2)], "pixels binary, width int, height int")
    assert list(ext.processors["negative"].apply(df).first().pixels) == [255 - i for i in range(12)]
    with pytest.raises(ValueError):
        ext.processors["negative"].checked({"off": 1})
    (tmp_path / "p").mkdir(), (tmp_path / "q").mkdir()
    (tmp_path / "p/plugin.json").write_text(json.dumps({"name": "p"}))
    (tmp_path / "q/plugin.json").write_text("{")
    assert [m["name"] for m in Extensions.discover(str(tmp_path))] == ["p"]
    bus, seen = EventBus(), []
    bus.on("e", lambda x: 1 / 0)
    bus.on("e", seen.append, once=True)
    bus.emit("e", 1), bus.emit("e", 2)
    assert seen == [1] and len(bus.errors) == 2


def test_sidecars_in_latin_1_and_below_originals(spark, tmp_path):
    (tmp_path / "Originals").mkdir()
    for name, data in (("a.ini", "[é.jpg]\nrotate=1\n".encode("latin-1")), ("b.ini", "[ü.jpg]\nrotate=2\n".encode()), ("Originals/c.ini", b"[c.jpg]\nrotate=3\n")):
        (tmp_path / name).write_bytes(data)
    rows = files.sidecar_sections(spark, str(tmp_path)).collect()
    assert sorted((r.section, r.entries["rotate"]) for r in rows) == [("é.jpg", "1"), ("ü.jpg", "2")]


def test_json_lines_of_any_schema(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"path": "/a", "n": 1}\nnot json\n{"n": 2}\n{"path": "/b"}\n')
    rows = files.json_lines(spark, str(tmp_path / "h.jsonl"), files.T.StructType.fromDDL("path string, n long"), "path").collect()
    assert sorted((r.path, r.n) for r in rows) == [("/a", 1), ("/b", None)]
