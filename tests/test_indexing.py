from shutterlake.operators import indexing as I

BOXES = "id long, photo_id long, x long, y long, w long, h long, person_id long"


def test_errors(spark):
    schema = "path string, error_type string, last_attempt double, excluded boolean"
    errors = spark.createDataFrame([("a", "timeout", 1.0, True), ("b", "crash", 1.0, False)], schema)
    new = spark.createDataFrame([("a", "error", 2.0, False), ("c", "error", 2.0, False)], schema)
    got = {tuple(r) for r in I.mark_errors(errors, new).collect()}
    assert got == {("a", "error", 2.0, True), ("b", "crash", 1.0, False), ("c", "error", 2.0, False)}
    paths = spark.createDataFrame([("b",), ("z",)], "path string")
    assert {(r.path, r.excluded) for r in I.set_excluded(errors, paths, True, 3.0).collect()} == {("a", True), ("b", True), ("z", True)}
    assert {r.path for r in I.set_excluded(errors, paths, False, 3.0).collect()} == {"a", "b"}


def test_person_survives_redetection(spark):
    old = spark.createDataFrame([(1, 1, 0, 0, 100, 100, 7), (2, 1, 300, 0, 100, 100, 8)], BOXES)
    new = spark.createDataFrame([(11, 1, 10, 10, 100, 100, None), (12, 1, 600, 0, 50, 50, None)], BOXES)
    assert {(r.id, r.person_id) for r in I.redetected(old, new).collect()} == {(11, 7), (12, None)}


def test_placeholders(spark):
    rows = [(1, 1, 0, 0, 100, 100, None, True), (2, 1, 5, 5, 100, 100, 7, False), (3, 2, 0, 0, 50, 50, 4, True), (4, 2, 0, 0, 50, 50, 5, False)]
    df = spark.createDataFrame(rows, BOXES + ", has_embedding boolean")
    assert {(r.id, r.person_id) for r in I.without_placeholders(df).collect()} == {(1, 7), (3, 4), (4, 5)}


def test_boxes_rotation_names_and_report(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 10, 10, None), (2, 1, 5, 5, 10, 10, None)], BOXES)
    got = I.remapped(df, df.selectExpr("id", "x + 1 AS x", "y", "w", "h").where("id = 1"), df.where("id = 2"))
    assert [(r.id, r.x) for r in got.collect()] == [(1, 1)]
    turns = spark.createDataFrame([(1, 0, 1), (1, 90, 5), (2, 0, 0), (2, 90, 2), (2, 180, 2)], "photo_id long, rotation int, n_faces int")
    assert {tuple(r) for r in I.best_rotation(turns).collect()} == {(1, 0), (2, 90)}
    photos = spark.createDataFrame([(1, "a.JPG", "/x/a.JPG", 3, 10, 20), (2, "a.jpg", "/y/a.jpg", 3, 10, 20), (3, "b.jpg", "/b.jpg", None, 1, 1)], "id long, filename string, path string, duplicate_group_id long, width int, height int")
    names = {r.id: r.name for r in I.export_names(photos, spark.createDataFrame([("b.jpg",)], "name string")).collect()}
    assert names == {1: "a.jpg", 2: "a_1.jpg", 3: "b_1.jpg"}
    html = [r.html for r in I.duplicate_report(photos).collect()]
    assert html == ["<tr><td>3</td><td>2</td><td><ul><li>/x/a.JPG (10 x 20)</li><li>/y/a.jpg (10 x 20)</li></ul></td></tr>"]
