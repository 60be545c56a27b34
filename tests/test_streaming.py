import datetime as dt


from shutterlake.sources.snapshots import Store
from shutterlake.streaming import library


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_debounce(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("d", t0 + dt.timedelta(milliseconds=m)) for m in (0, 100, 450, 2000, 60_000)]
    spark.createDataFrame(rows, "directory string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("directory string, ts timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r.n for r in drain(library.debounced(stream), "bursts")) == [1, 3]


def test_suppression(spark, tmp_path):
    rows = [("d", "x", True, 0), ("d", "x", False, 100), ("d", "x", False, 200), ("d", "y", True, 0), ("d", "y", False, 20_000)]
    schema = "directory string, name string, declared boolean, at_ms long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(library.suppressed(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "changes")
    assert sorted((r.name, r.at_ms) for r in got) == [("x", 200), ("y", 20_000)]


def test_scan_upserts_are_idempotent(spark, tmp_path):
    schema = "id long, path string, mtime_ts timestamp_ntz, file_size long, rating long, is_favorite boolean, duplicate_group_id long, tags array<string>"
    store = Store(spark, str(tmp_path))
    t = dt.datetime(2024, 1, 1)
    store.write("photos", spark.createDataFrame([(1, "/a", t, 10, 5, True, None, ["x"])], schema))
    batch = spark.createDataFrame([(9, "/a", t, 11, 0, False, None, []), (2, "/b", t, 5, 0, False, None, []), (2, "/b", t + dt.timedelta(1), 6, 0, False, None, [])], schema)
    step = library.upsert_scans(store)
    step(batch, 0)
    first = sorted(map(str, store.read("photos").collect()))
    step(batch, 0)
    assert sorted(map(str, store.read("photos").collect())) == first
    got = {r.path: (r.id, r.file_size, r.rating, r.tags) for r in store.read("photos").collect()}
    assert got == {"/a": (1, 11, 5, ["x"]), "/b": (2, 6, 0, [])}


def test_incremental_duplicates_equal_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(i, (i % 4) << 20 | (1 << i % 3), None) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, bits long, day long")
    step = library.incremental_duplicates(store, most=2)
    step(df.where("id < 7"), 0)
    step(df.where("id >= 5"), 1)
    want = {(a, b) for a, x, _ in rows for b, y, _ in rows if a < b and bin(x ^ y).count("1") <= 2}
    assert {(r.a, r.b) for r in store.read("pairs").collect()} == want


def test_scan_stream_and_partial_groups(spark, tmp_path):
    folder = tmp_path / "lib"
    (folder / "thumbnails").mkdir(parents=True)
    for name in ("a.jpg", "b.mp4", "c.txt", "thumbnails/d.jpg"):
        (folder / name).write_bytes(b"12345")
    rows = drain(library.scan_stream(spark, str(folder), 1), "scanned")
    assert sorted((r.path.rsplit("/", 1)[1], r.file_size) for r in rows) == [("a.jpg", 5), ("b.mp4", 5)]
    spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, group_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = library.partial_groups(spark.readStream.schema("id long, group_id long").parquet(str(tmp_path / "in")), lambda batch: seen.extend(batch.collect()), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert {(r.group_id, r.n) for r in seen} == {(1, 2), (2, 1)}


def test_unfinished_version_is_written_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.write("t", spark.range(3)) == 1 and store.write("t", spark.range(4)) == 2
    spark.range(9).write.parquet(str(tmp_path / "store/t/v=3"))  # the process ended before the mark
    assert store.version("t") == 2 and store.read("t").count() == 4 and store.backups("t") == [2, 1]
    assert store.write("t", spark.range(5)) == 3 and store.read("t").count() == 5
    assert store.restore("t", 1) == 4 and store.read("t").count() == 3
