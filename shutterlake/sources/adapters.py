"""The driver's tables seen as a photo library: views in the DataFrame API, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shutterlake.functions.columns import sign_bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    i = F.col("o_orderkey")
    tags = F.concat(
        F.array(F.lower("c_mktsegment"), F.lower("o_orderstatus")),
        F.when(i % 10 == 0, F.array(F.lit("vacances"))).when(i % 10 == 1, F.array(F.lit("vacances2024"))).otherwise(F.array().cast("array<string>")),
    )
    video = i % 20 == 0
    folder = F.concat(F.lit("/lib/"), F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit("/"), F.col("c_mktsegment"))
    name = F.concat(F.lit("IMG_"), i.cast("string"), F.when(video, ".mp4").otherwise(".jpg"))
    return j.select(
        i.cast("long").alias("id"), F.concat(folder, F.lit("/"), name).alias("path"), name.alias("filename"), folder.alias("directory"),
        F.when(i % 11 != 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("date_taken"), F.col("o_orderdate").cast("timestamp_ntz").alias("mtime_ts"),
        F.floor("o_totalprice").cast("long").alias("file_size"), (640 + i % 4000).cast("long").alias("width"), (480 + F.col("o_custkey") % 3000).cast("long").alias("height"),
        F.when(i % 4 == 0, "Canon").when(i % 4 == 1, "Nikon").when(i % 4 == 2, "Sony").alias("camera_make"), F.concat(F.lit("M"), (F.col("o_custkey") % 12).cast("string")).alias("camera_model"),
        (i % 6).cast("long").alias("rating"), (F.col("o_orderpriority") == "1-URGENT").alias("is_favorite"), F.when(video, "video").otherwise("image").alias("media_type"), tags.alias("tags"),
        F.when(i % 7 == 0, F.floor(i / 70)).cast("long").alias("duplicate_group_id"),
    )


def faces(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).cast("long").alias("id"), c("l_orderkey").cast("long").alias("photo_id"),
        (c("l_partkey") % 600).cast("long").alias("x"), (c("l_suppkey") % 400).cast("long").alias("y"), (20 + F.floor("l_quantity") * 3).cast("long").alias("w"), (20 + F.floor("l_quantity") * 4).cast("long").alias("h"),
        F.round(0.5 + c("l_discount") * 5, 6).cast("double").alias("det_score"), F.when(c("l_returnflag") != "N", c("l_suppkey") % 10).cast("long").alias("person_id"), (c("l_partkey") % 200).cast("long").alias("cluster_id"),
        ((c("l_linestatus") == "F") & (c("l_linenumber") == 4)).alias("ignored"), (c("l_linenumber") == 7).alias("pinned"), (c("l_partkey") % 50 == 0).alias("is_cover"),
        F.when((c("l_returnflag") == "N") & (c("l_suppkey") % 3 == 0), c("l_suppkey") % 10).cast("long").alias("suggestion_person_id"), F.round(c("l_tax") * 10, 6).cast("double").alias("suggestion_score"),
        (c("l_linenumber") != 6).alias("has_embedding"),
    )


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").where("l_linenumber <= 3").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).cast("long").alias("id"), c("l_orderkey").cast("long").alias("photo_id"), (c("l_partkey") % 600 + 10).cast("long").alias("x"), (c("l_suppkey") % 400 + 10).cast("long").alias("y"),
        (40 + F.floor("l_quantity") * 3).cast("long").alias("w"), (40 + F.floor("l_quantity") * 4).cast("long").alias("h"), (c("l_suppkey") % 10).cast("long").alias("person_id"), ((c("l_linenumber") == 3) & (c("l_orderkey") % 4 == 0)).alias("consumed"),
    )


#: What rows of one id differ in, in the order that picks one of them.
_BY = ("x", "y", "w", "h", "det_score", "coalesce(person_id, -1)", "cluster_id", "ignored", "coalesce(suggestion_person_id, -1)", "suggestion_score")


def _single(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row of each id; the driver's line numbers repeat within some orders."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(*map(F.expr, columns)))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def single_faces(spark: SparkSession, sf: str) -> DataFrame:
    return _single(faces(spark, sf), _BY)


def single_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return _single(annotations(spark, sf), _BY[:4])


def face_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(v.cast("long").alias("face_id"), (v % 50).cast("long").alias("cluster_id"), F.when(v % 2 == 0, F.col("label")).cast("long").alias("person_id"), F.col("embedding"))


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), sign_bits("embedding").alias("bits"), F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 4).cast("long").alias("day"))


def edit_history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").cast("long").alias("id"), F.col("user_id").cast("long").alias("photo"), F.col("event_type").alias("operation"), F.col("props").alias("state_json"), F.col("ts").cast("timestamp_ntz").alias("created_at"))


#: Edit states as JSON, by id modulo their number.
_STATES = (
    "{}", '{"brightness": 0.25, "flip_h": true}', '{"bw_red": 0.5, "bw_green": 1.0, "frame_width": 0.2, "vignette_cx": 0.3}', '{"crop": [0.1, 0.2, 0.5, 0.25], "frame_type": ""}', "not json", '{"gamma": 1.5, "gamma_curve_points": [[0.0, 0.0], [1.0, 1.0]], "vignette_rx2": 0.9}',
    '{"color_green": -0.5, "frame_inner_relief": false}', '{"annotations": [{"id": 7}]}', '{"frame_type": "plain", "crop": []}', '{"gamma_use_curve": true}', '{"vignette_strength": 0.0, "rotation": 0.0, "bw": false}', '{"red_eye_regions": [[1.0, 2.0, 3.0]], "frame_type": null}',
)


def edit_states(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("o_orderkey").cast("long")
    return table(spark, sf, "orders").select(i.alias("id"), F.get(F.array(*map(F.lit, _STATES)), (i % len(_STATES)).cast("int")).alias("state_json"))


def journal(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id") % 4
    event = F.when(i == 0, "START").when(i == 1, "STEP").when(i == 2, "END").otherwise("ERROR")
    return table(spark, sf, "events").select(F.col("event_id").cast("long").alias("id"), F.col("event_type").alias("thread"), event.alias("event"), (F.col("value") * 10).cast("double").alias("elapsed_ms"), F.col("ts").cast("timestamp_ntz").alias("ts"))


def albums(spark: SparkSession, sf: str) -> DataFrame:
    """Albums are the market segments; an album's id is its place in their order."""
    names = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    before = names.select(F.col("name").alias("other"))
    # A handful of names: their order by counting the names before.
    return names.join(F.broadcast(before), F.col("other") <= F.col("name")).groupBy("name").agg(F.count("*").alias("id")).select("id", "name")


def persons(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"))


def album_photos(spark: SparkSession, sf: str) -> DataFrame:
    p = photos(spark, sf).where("id % 3 = 0").select(F.col("id").alias("photo_id"), F.element_at(F.split("directory", "/"), -1).alias("name"))
    return p.join(F.broadcast(albums(spark, sf)), "name").select(F.col("id").alias("album_id"), "photo_id")


_SIGNS = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i} ELSE 0 END)" for i in range(63))

SQL_VIEWS = {
    "photos": """SELECT CAST(o_orderkey AS BIGINT) AS id, '/lib/'||r_name||'/'||n_name||'/'||c_mktsegment||'/IMG_'||o_orderkey||(CASE WHEN o_orderkey%20=0 THEN '.mp4' ELSE '.jpg' END) AS path,
 'IMG_'||o_orderkey||(CASE WHEN o_orderkey%20=0 THEN '.mp4' ELSE '.jpg' END) AS filename, '/lib/'||r_name||'/'||n_name||'/'||c_mktsegment AS directory,
 CASE WHEN o_orderkey%11<>0 THEN CAST(o_orderdate AS TIMESTAMP) END AS date_taken, CAST(o_orderdate AS TIMESTAMP) AS mtime_ts, CAST(floor(o_totalprice) AS BIGINT) AS file_size,
 CAST(640+o_orderkey%4000 AS BIGINT) AS width, CAST(480+o_custkey%3000 AS BIGINT) AS height, CASE o_orderkey%4 WHEN 0 THEN 'Canon' WHEN 1 THEN 'Nikon' WHEN 2 THEN 'Sony' END AS camera_make, 'M'||(o_custkey%12) AS camera_model,
 CAST(o_orderkey%6 AS BIGINT) AS rating, o_orderpriority='1-URGENT' AS is_favorite, CASE WHEN o_orderkey%20=0 THEN 'video' ELSE 'image' END AS media_type,
 [lower(c_mktsegment), lower(o_orderstatus)] || (CASE o_orderkey%10 WHEN 0 THEN ['vacances'] WHEN 1 THEN ['vacances2024'] ELSE [] END) AS tags,
 CASE WHEN o_orderkey%7=0 THEN CAST(o_orderkey//70 AS BIGINT) END AS duplicate_group_id
 FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "faces": """SELECT CAST(l_orderkey*10+l_linenumber AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS photo_id, CAST(l_partkey%600 AS BIGINT) AS x, CAST(l_suppkey%400 AS BIGINT) AS y,
 CAST(20+floor(l_quantity)*3 AS BIGINT) AS w, CAST(20+floor(l_quantity)*4 AS BIGINT) AS h, round(CAST(0.5+l_discount*5 AS DOUBLE), 6) AS det_score, CASE WHEN l_returnflag<>'N' THEN CAST(l_suppkey%10 AS BIGINT) END AS person_id,
 CAST(l_partkey%200 AS BIGINT) AS cluster_id, (l_linestatus='F' AND l_linenumber=4) AS ignored, (l_linenumber=7) AS pinned, (l_partkey%50=0) AS is_cover,
 CASE WHEN l_returnflag='N' AND l_suppkey%3=0 THEN CAST(l_suppkey%10 AS BIGINT) END AS suggestion_person_id, round(CAST(l_tax*10 AS DOUBLE), 6) AS suggestion_score,
 l_linenumber<>6 AS has_embedding FROM lineitem""",
    "annotations": """SELECT CAST(l_orderkey*10+l_linenumber AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS photo_id, CAST(l_partkey%600+10 AS BIGINT) AS x, CAST(l_suppkey%400+10 AS BIGINT) AS y,
 CAST(40+floor(l_quantity)*3 AS BIGINT) AS w, CAST(40+floor(l_quantity)*4 AS BIGINT) AS h, CAST(l_suppkey%10 AS BIGINT) AS person_id, l_linenumber=3 AND l_orderkey%4=0 AS consumed FROM lineitem WHERE l_linenumber<=3""",
    "face_vectors": "SELECT CAST(vec_id AS BIGINT) AS face_id, CAST(vec_id%50 AS BIGINT) AS cluster_id, CASE WHEN vec_id%2=0 THEN CAST(label AS BIGINT) END AS person_id, embedding FROM embeddings",
    "fingerprints": f"SELECT CAST(vec_id AS BIGINT) AS id, CAST({_SIGNS} AS BIGINT) AS bits, CASE WHEN vec_id%3<>0 THEN CAST(vec_id%4 AS BIGINT) END AS day FROM embeddings",
    "edit_history": "SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS photo, event_type AS operation, props AS state_json, CAST(ts AS TIMESTAMP) AS created_at FROM events",
    "journal": "SELECT CAST(event_id AS BIGINT) AS id, event_type AS thread, CASE event_id%4 WHEN 0 THEN 'START' WHEN 1 THEN 'STEP' WHEN 2 THEN 'END' ELSE 'ERROR' END AS event, CAST(value*10 AS DOUBLE) AS elapsed_ms, CAST(ts AS TIMESTAMP) AS ts FROM events",
    "albums": "SELECT CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS id, name FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)",
}
for _name, _columns in (("faces", _BY), ("annotations", _BY[:4])):
    SQL_VIEWS[f"single_{_name}"] = f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {', '.join(_columns)}) AS place FROM ({SQL_VIEWS[_name]})) WHERE place=1"
SQL_VIEWS["persons"] = "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name FROM supplier"
SQL_VIEWS["edit_states"] = f"SELECT CAST(o_orderkey AS BIGINT) AS id, {list(_STATES)!r}[o_orderkey % {len(_STATES)} + 1] AS state_json FROM orders"
SQL_VIEWS["album_photos"] = f"SELECT a.id AS album_id, p.id AS photo_id FROM ({SQL_VIEWS['photos']}) p JOIN ({SQL_VIEWS['albums']}) a ON a.name = split_part(p.directory, '/', 5) WHERE p.id % 3 = 0"


def with_views(sql: str, *names: str) -> str:
    """SQL over the views of these names; views of single rows go by the name of all."""
    views = ", ".join(f"{n.removeprefix('single_')} AS ({SQL_VIEWS[n]})" for n in names)
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{views}, {sql[len(start):]}"
    return f"WITH {views} {sql}"
