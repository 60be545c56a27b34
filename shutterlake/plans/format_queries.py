"""Queries of metadata, formats, edit states and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import columns as C, edits as E, geometry as Q, labels as L, vectors as V
from shutterlake.plans.base import query, spread

# --- metadata -------------------------------------------------------------

query("subsecond_micros", ("photos",), """SELECT id, CAST(CASE id%4 WHEN 3 THEN 0 ELSE CAST(rpad(substr(CASE id%4 WHEN 0 THEN '05' WHEN 1 THEN CAST(id AS VARCHAR) ELSE '1234567' END, 1, 6), 6, '0') AS INTEGER) END AS INTEGER) AS micros FROM photos""")(
    lambda p: p.select("id", C.subsecond_micros(F.when(F.col("id") % 4 == 0, " 05 ").when(F.col("id") % 4 == 1, F.col("id").cast("string")).when(F.col("id") % 4 == 2, "1234567").otherwise("x5")).alias("micros"))
)
query("gps_degrees", ("photos",), "SELECT id, round((id%90 + (id%60)/60.0 + (id%7)/3600.0) * (CASE WHEN id%2=0 THEN -1 ELSE 1 END), 9) + 0.0 AS degrees FROM photos")(
    lambda p: p.select("id", F.round(C.degrees(F.col("id") % 90, F.col("id") % 60, F.col("id") % 7, F.when(F.col("id") % 4 == 0, "S").when(F.col("id") % 4 == 2, "w").when(F.col("id") % 4 == 1, "N").otherwise("E")), 9).alias("degrees"))
)
query("metadata_date_precedence", ("photos",), """SELECT id, CASE WHEN id%3=0 THEN make_timestamp(2001, CAST(id%12+1 AS INTEGER), 3, 4, 5, 6) WHEN id%3=1 THEN make_timestamp(2002, 2, CAST(id%28+1 AS INTEGER), 1, 1, 1) WHEN id%2=0 THEN make_timestamp(2003, 3, 3, 3, 3, CAST(id%60 AS DOUBLE)) END AS taken FROM photos""")(
    lambda p: p.select("id", _taken().alias("taken"))
)


def _taken():
    from shutterlake.sources.files import metadata_date

    i = F.col("id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    original = F.when(i % 3 == 0, F.concat(F.lit("2001:"), two(i % 12 + 1), F.lit(":03 04:05:06"))).otherwise("0000:00:00 00:00:00")
    digitized = F.when(i % 3 != 2, F.concat(F.lit("2002:02:"), two(i % 28 + 1), F.lit(" 01:01:01")))
    changed = F.when((i % 3 != 2) | (i % 2 == 0), F.concat(F.lit("2003:03:03 03:03:"), two(i % 60))).otherwise("no date")
    return metadata_date(original, digitized, changed)


@query("merged_metadata_tags", ("photos",), "SELECT id, CASE WHEN id%2=0 THEN 'first' ELSE 'second' END AS model, CASE WHEN id%2=0 THEN 'only' END AS lens, CAST(id AS VARCHAR) AS iso FROM photos")
def _(p):
    from shutterlake.sources.files import merged_tags

    i = F.col("id")
    first = F.when(i % 2 == 0, F.create_map(F.lit("model"), F.lit("first"), F.lit("lens"), F.lit("only"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = merged_tags(first, F.create_map(F.lit("model"), F.lit("second"), F.lit("iso"), i.cast("string")))
    return p.select("id", merged.alias("m")).select("id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("model", "lens", "iso")))


_SCAN_PATHS = "directory || CASE id%8 WHEN 0 THEN '/.hidden' WHEN 1 THEN '/Originals' WHEN 2 THEN '/thumbnails' WHEN 3 THEN '/film_assets' WHEN 4 THEN '' ELSE '/sub' END || CASE WHEN id%8=4 THEN '/.' ELSE '/' END || filename"


@query("scan_pruned_paths", ("photos",), f"SELECT {_SCAN_PATHS} AS path FROM photos WHERE id%8 >= 5")
def _(p):
    i = F.col("id") % 8
    folder = F.when(i == 0, "/.hidden").when(i == 1, "/Originals").when(i == 2, "/thumbnails").when(i == 3, "/film_assets").when(i == 4, "").otherwise("/sub")
    paths = p.select(F.concat("directory", folder, F.when(i == 4, "/.").otherwise("/"), "filename").alias("path"))
    return paths.where(~C.pruned("path"))


query("row_defaults", ("photos",), "SELECT id, coalesce(camera_make, '') AS camera_make, CASE WHEN id%11=0 THEN 0 ELSE rating END AS rating, CASE WHEN id%3=0 THEN 'a,b' ELSE '' END AS tags FROM photos")(
    lambda p: p.select("id", F.coalesce("camera_make", F.lit("")).alias("camera_make"), F.coalesce(F.when(F.col("id") % 11 != 0, F.col("rating")), F.lit(0)).alias("rating"), F.array_join(C.split_tags(F.when(F.col("id") % 3 == 0, " a ,b,,a")), ",").alias("tags"))
)
query("tag_changes", ("photos",), "SELECT id, CASE WHEN id%10=0 THEN '' ELSE 'vacances' END AS added, list_aggregate(list_filter(tags, lambda t: t<>'vacances'), 'string_agg', ',') AS removed FROM photos")(
    lambda p: p.select("id", *(F.array_join(c, ",").alias(n) for n, c in zip(("added", "removed"), C.tag_changes("tags", F.array(F.lit("vacances"))))))
)
query("version_compare", ("photos",), "SELECT id, CASE WHEN id%5=0 THEN FALSE WHEN id%7>3 THEN TRUE ELSE FALSE END AS newer FROM photos")(
    lambda p: p.select("id", (C.version_parts(F.when(F.col("id") % 5 == 0, "v1.1.99").otherwise(F.concat(F.lit("V1.2."), (F.col("id") % 7).cast("string"), F.lit("-beta")))) > F.array(F.lit(1), F.lit(2), F.lit(3))).alias("newer"))
)
query("backup_times", ("photos",), "SELECT id, CASE WHEN id%2=0 THEN make_timestamp(2024, CAST(id%12+1 AS INTEGER), 5, 1, 2, 3) END AS made FROM photos")(
    lambda p: p.select("id", C.backup_time(F.when(F.col("id") % 2 == 0, F.concat(F.lit("faces_2024"), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"), F.lit("05_010203.zip"))).otherwise("faces_20241399_000000.zip")).cast("timestamp_ntz").alias("made"))
)

# --- labels ---------------------------------------------------------------

_TAGS = ("ExposureTime", "FNumber", "MaxApertureValue", "FocalLengthIn35mmFilm", "ISOSpeedRatings", "ExposureBiasValue", "BrightnessValue", "DigitalZoomRatio", "SubjectDistance", "Orientation", "MeteringMode", "Flash", "LightSource", "Compression", "Artist", "DateTimeOriginal", "SceneCaptureType", "ColorSpace")
_LABELS = f"""WITH t AS (SELECT id, [{', '.join(repr(t) for t in _TAGS)}][id % {len(_TAGS)} + 1] AS tag FROM photos),
 v AS (SELECT id, tag, CASE tag WHEN 'Artist' THEN ' A'||id||' ' WHEN 'DateTimeOriginal' THEN CASE WHEN id%4=0 THEN 'soon' ELSE '1999:12:3'||(id%2)||' 23:59:58' END WHEN 'ColorSpace' THEN CASE id%3 WHEN 0 THEN '1' WHEN 1 THEN '65535' ELSE '9' END
 WHEN 'ExposureTime' THEN CASE WHEN id%4=0 THEN CAST(id%5+1 AS VARCHAR) ELSE '0.0'||(id%9+1) END WHEN 'SubjectDistance' THEN CASE WHEN id%2=0 THEN '99999' ELSE (id%50)||'.5' END WHEN 'ExposureBiasValue' THEN CASE WHEN id%4=0 THEN '-' ELSE '' END||(id%3)||'.3'
 WHEN 'DigitalZoomRatio' THEN CAST(id%4 AS VARCHAR) WHEN 'Compression' THEN CASE WHEN id%4=0 THEN '32773' ELSE CAST(id%10 AS VARCHAR) END WHEN 'Flash' THEN CAST(id%112 AS VARCHAR) WHEN 'LightSource' THEN CAST(id%30 AS VARCHAR) ELSE CAST(id%12 AS VARCHAR) END AS value FROM t),
 n AS (SELECT *, TRY_CAST(value AS DOUBLE) AS n FROM v)
SELECT id, tag, CASE tag WHEN 'ExposureTime' THEN CASE WHEN n>=1 THEN printf('%.1f s', n) ELSE '1/'||CAST(round_even(1/n, 0) AS BIGINT)||' s' END WHEN 'FNumber' THEN printf('f/%.1f', n) WHEN 'MaxApertureValue' THEN printf('f/%.1f', sqrt(pow(2, n)))
 WHEN 'FocalLengthIn35mmFilm' THEN CAST(n AS BIGINT)||' mm' WHEN 'ISOSpeedRatings' THEN CAST(CAST(n AS BIGINT) AS VARCHAR) WHEN 'ExposureBiasValue' THEN printf('%+.1f EV', n) WHEN 'BrightnessValue' THEN printf('%.2f EV', n)
 WHEN 'DigitalZoomRatio' THEN CASE WHEN n IN (0, 1) THEN 'No zoom' ELSE printf('×%.2f', n) END WHEN 'SubjectDistance' THEN CASE WHEN n<9999 THEN printf('%.2f m', n) ELSE 'Infinity' END
 WHEN 'Orientation' THEN coalesce(['Normal','Mirror H','180°','Mirror V','Mirror H + 270°','90° clockwise','Mirror H + 90°','270° clockwise'][CAST(nullif(n, 0) AS BIGINT)], value)
 WHEN 'MeteringMode' THEN coalesce(['Unknown','Average','Centre-weighted average','Spot','Multi-spot','Pattern','Partial'][CAST(n AS BIGINT)+1], value)
 WHEN 'SceneCaptureType' THEN coalesce(['Standard','Landscape','Portrait','Night scene'][CAST(n AS BIGINT)+1], value) WHEN 'ColorSpace' THEN CASE n WHEN 1 THEN 'sRGB' WHEN 65535 THEN 'Uncalibrated' ELSE value END
 WHEN 'Compression' THEN coalesce(['Uncompressed','CCITT 1D','CCITT Group 3','CCITT Group 4','LZW','JPEG (old)','JPEG','Deflate/ZIP'][CAST(nullif(n, 0) AS BIGINT)], CASE n WHEN 32773 THEN 'PackBits (Mac)' ELSE value END)
 WHEN 'LightSource' THEN CASE n WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Daylight' WHEN 2 THEN 'Fluorescent' WHEN 3 THEN 'Tungsten (incandescent)' WHEN 4 THEN 'Flash' WHEN 9 THEN 'Fine weather' WHEN 10 THEN 'Cloudy' WHEN 11 THEN 'Shade' WHEN 12 THEN 'Daylight fluorescent (D)' WHEN 13 THEN 'Day white fluorescent (N)'
  WHEN 14 THEN 'Warm white fluorescent (W)' WHEN 15 THEN 'Cool white fluorescent' WHEN 17 THEN 'Standard light A' WHEN 18 THEN 'Standard light B' WHEN 19 THEN 'Standard light C' WHEN 20 THEN 'D55' WHEN 21 THEN 'D65' WHEN 22 THEN 'D75' ELSE value END
 WHEN 'Flash' THEN CASE n WHEN 0 THEN 'Did not fire' WHEN 1 THEN 'Fired' WHEN 5 THEN 'Fired, return not detected' WHEN 7 THEN 'Fired, return detected' WHEN 8 THEN 'On, did not fire' WHEN 9 THEN 'On, fired' WHEN 13 THEN 'On, return not detected' WHEN 15 THEN 'On, return detected'
  WHEN 16 THEN 'Off, did not fire' WHEN 24 THEN 'Off, return not detected' WHEN 25 THEN 'Off, fired' WHEN 29 THEN 'Off, return not detected' WHEN 31 THEN 'Off, return detected' WHEN 32 THEN 'Auto, did not fire' WHEN 36 THEN 'Auto, did not fire, red-eye reduction' WHEN 37 THEN 'Auto, fired'
  WHEN 39 THEN 'Auto, return detected' WHEN 41 THEN 'Auto, fired, red-eye reduction' WHEN 47 THEN 'Auto, return detected, red-eye reduction' WHEN 48 THEN 'No flash function' WHEN 65 THEN 'Fired, red-eye reduction' WHEN 69 THEN 'Fired, return not detected, red-eye reduction'
  WHEN 71 THEN 'Fired, return detected, red-eye reduction' WHEN 73 THEN 'On, fired, red-eye reduction' WHEN 77 THEN 'On, return not detected, red-eye reduction' WHEN 79 THEN 'On, return detected, red-eye reduction' WHEN 89 THEN 'Auto, fired, red-eye reduction'
  WHEN 93 THEN 'Auto, return not detected, red-eye reduction' WHEN 95 THEN 'Auto, return detected, red-eye reduction' ELSE printf('0x%02X', CAST(n AS BIGINT)) END
 WHEN 'DateTimeOriginal' THEN CASE WHEN id%4=0 THEN 'soon' ELSE '12/3'||(id%2)||'/1999  23:59:58' END ELSE trim(value) END AS label FROM n"""


@query("exif_labels", ("photos",), _LABELS)
def _(p):
    i, s = F.col("id"), lambda c: c.cast("string")
    tag = F.get(F.array(*map(F.lit, _TAGS)), (i % len(_TAGS)).cast("int"))
    t = F.col("tag")
    value = (
        F.when(t == "Artist", F.concat(F.lit(" A"), s(i), F.lit(" "))).when(t == "DateTimeOriginal", F.when(i % 4 == 0, "soon").otherwise(F.concat(F.lit("1999:12:3"), s(i % 2), F.lit(" 23:59:58"))))
        .when(t == "ColorSpace", F.when(i % 3 == 0, "1").when(i % 3 == 1, "65535").otherwise("9")).when(t == "ExposureTime", F.when(i % 4 == 0, s(i % 5 + 1)).otherwise(F.concat(F.lit("0.0"), s(i % 9 + 1))))
        .when(t == "SubjectDistance", F.when(i % 2 == 0, "99999").otherwise(F.concat(s(i % 50), F.lit(".5")))).when(t == "ExposureBiasValue", F.concat(F.when(i % 4 == 0, "-").otherwise(""), s(i % 3), F.lit(".3")))
        .when(t == "DigitalZoomRatio", s(i % 4)).when(t == "Compression", F.when(i % 4 == 0, "32773").otherwise(s(i % 10))).when(t == "Flash", s(i % 112)).when(t == "LightSource", s(i % 30)).otherwise(s(i % 12))
    )
    return p.select("id", tag.alias("tag")).withColumn("value", value).select("id", "tag", L.label("tag", "value").alias("label"))


query("lens_labels", ("photos",), """SELECT id, CASE WHEN id%3=0 THEN printf('%.0f mm', 20.0+id%50) ELSE printf('%.0f–%.0f mm', 20.0+id%50, 90.0+id%9) END || '  ' || CASE WHEN id%2=0 THEN printf('f/%.1f', 2.8) ELSE printf('f/%.1f–f/%.1f', 2.8, 4.0+id%3) END AS lens FROM photos""")(
    lambda p: p.select("id", L.lens_text(20 + F.col("id") % 50, F.when(F.col("id") % 3 == 0, 20 + F.col("id") % 50).otherwise(90 + F.col("id") % 9), F.lit(2.8), F.when(F.col("id") % 2 == 0, 2.8).otherwise(4 + F.col("id") % 3)).alias("lens"))
)
query("wide_text_fields", ("photos",), "SELECT id, 'é'||filename AS title FROM photos")(lambda p: p.select("id", L.wide_text(F.encode(F.concat(F.lit("é"), "filename", F.lit("\0")), "UTF-16LE")).alias("title")))
query("size_format_terabytes", ("photos",), """SELECT id, CASE WHEN n<1024 THEN n||' B' WHEN n<1048576 THEN n//1024||' KB' WHEN n<1073741824 THEN n//1048576||' MB' WHEN n<1099511627776 THEN n//1073741824||' GB' ELSE n//1099511627776||' TB' END AS size
 FROM (SELECT id, file_size * [1, 1000, 1000000, 100000000][id%4+1] AS n FROM photos)""")(lambda p: p.select("id", C.size_text(F.col("file_size") * F.get(F.array(*(F.lit(v).cast("long") for v in (1, 1000, 1_000_000, 100_000_000))), (F.col("id") % 4).cast("int"))).alias("size")))

# --- edit states ----------------------------------------------------------

_NUMBER = "coalesce(TRY_CAST(json_extract_string(j, '$.{0}') AS DOUBLE), {1})"
_FLAG = "coalesce(TRY_CAST(json_extract_string(j, '$.{0}') AS BOOLEAN), {1})"
_J = "SELECT id, CASE WHEN json_valid(state_json) THEN state_json ELSE NULL END AS j FROM edit_states"

query("edit_defaults", ("edit_states",), f"""SELECT id, {_NUMBER.format('brightness', 0.0)} AS brightness, {_NUMBER.format('gamma', 1.0)} AS gamma, {_NUMBER.format('vignette_rx2', 0.8)} AS vignette_rx2, {_FLAG.format('flip_h', 'FALSE')} AS flip_h, {_FLAG.format('frame_inner_relief', 'TRUE')} AS frame_inner_relief,
 coalesce(nullif(json_extract_string(j, '$.frame_type'), ''), 'none') AS frame_type, CASE WHEN json_array_length(j, '$.crop') > 0 THEN json_extract(j, '$.crop[2]')::DOUBLE END AS crop_width, coalesce(json_array_length(j, '$.gamma_curve_points'), 3) AS n_points FROM ({_J}) WHERE j IS NOT NULL""")(
    lambda e: e.select("id", E.parsed("state_json").alias("s")).where("s is not null").select("id", "s.brightness", "s.gamma", "s.vignette_rx2", "s.flip_h", "s.frame_inner_relief", "s.frame_type", F.get("s.crop", F.lit(2)).alias("crop_width"), F.size("s.gamma_curve_points").cast("long").alias("n_points"))
)
_MODIFIED = " OR ".join([f"{_NUMBER.format(n, 0.0)} <> 0" for n in ("brightness", "contrast", "saturation", "sharpness", "noise_reduction", "rotation", "straighten", "color_red", "color_green", "color_blue")] + [_FLAG.format(n, "FALSE") for n in ("gamma_use_curve", "flip_h", "flip_v", "bw")] + [
    f"{_NUMBER.format('gamma', 1.0)} <> 1", "coalesce(json_array_length(j, '$.crop'), 0) > 0", f"{_NUMBER.format('vignette_strength', 0.0)} > 0", "coalesce(json_array_length(j, '$.red_eye_regions'), 0) > 0", "coalesce(json_array_length(j, '$.annotations'), 0) > 0",
    "coalesce(nullif(json_extract_string(j, '$.frame_type'), ''), 'none') <> 'none'"])
query("edit_is_modified", ("edit_states",), f"SELECT id, {_MODIFIED} AS modified FROM ({_J}) WHERE j IS NOT NULL")(lambda e: e.select("id", E.parsed("state_json").alias("s")).where("s is not null").select("id", E.modified("s").alias("modified")))
query("edit_json_round_trip", ("edit_states",), "SELECT id, TRUE AS same FROM edit_states WHERE json_valid(state_json)")(
    # A filter on the state, or one that Spark adds below an explode, would parse each text once more.
    lambda e: spread(e).select("id", F.explode_outer(F.array(E.parsed("state_json"))).alias("s")).where("s is not null").select("id", (E.parsed(E.as_json("s")) == F.col("s")).alias("same"))
)


def _state_sql() -> str:
    """The JSON of a whole state, field by field."""
    lists = {"annotations": "'['||coalesce(replace(json_extract_string(j, '$.annotations[0]'), ' ', ''), '')||']'", "red_eye_regions": "coalesce(replace(CAST(json_extract(j, '$.red_eye_regions') AS VARCHAR), ' ', ''), '[]')", "gamma_curve_points": "coalesce(replace(CAST(json_extract(j, '$.gamma_curve_points') AS VARCHAR), ' ', ''), '[[0.0,0.0],[0.5,0.5],[1.0,1.0]]')", "crop": "CASE WHEN json_array_length(j, '$.crop') > 0 THEN replace(CAST(CAST(json_extract(j, '$.crop') AS DOUBLE[]) AS VARCHAR), ', ', ',') ELSE 'null' END"}
    texts = {"frame_color": "#f2f2f2", "frame_color2": "#8c8c8c", "frame_gap_color": "#ffffff", "frame_inner_color": "#303030", "frame_inner_motif": "line", "frame_style": "solid", "frame_type": "none", "vignette_color": "black"}
    flags = {"bw": "FALSE", "flip_h": "FALSE", "flip_v": "FALSE", "frame_inner_enabled": "FALSE", "frame_inner_relief": "TRUE", "gamma_use_curve": "FALSE"}
    numbers = {"frame_gap": 0.02, "frame_inner_ornament": 1.0, "frame_inner_width": 0.015, "frame_width": 0.05, "gamma": 1.0, "vignette_cx": 0.5, "vignette_cy": 0.5, "vignette_rx1": 0.4, "vignette_rx2": 0.8, "vignette_ry1": 0.4, "vignette_ry2": 0.8}
    numbers |= dict.fromkeys(("bw_blue", "bw_green", "bw_red", "brightness", "color_blue", "color_green", "color_red", "contrast", "noise_reduction", "rotation", "saturation", "sharpness", "straighten", "vignette_angle", "vignette_strength"), 0.0)
    parts = {n: f"CAST(CAST({_NUMBER.format(n, d)} AS DOUBLE) AS VARCHAR)" for n, d in numbers.items()} | {n: f"CAST({_FLAG.format(n, d)} AS VARCHAR)" for n, d in flags.items()} | {n: f"""'"'||coalesce(nullif(json_extract_string(j, '$.{n}'), ''), '{d}')||'"'""" for n, d in texts.items()} | lists
    return "'{'||" + "||','||".join(f"""'"{n}":'||{parts[n]}""" for n in sorted(parts)) + "||'}'"


query("edit_signatures", ("edit_states",), f"SELECT id, CASE WHEN {_MODIFIED} THEN substr(md5({_state_sql()}), 1, 16) ELSE '' END AS signature FROM ({_J}) WHERE j IS NOT NULL AND json_array_length(j, '$.annotations') IS NULL")(
    lambda e: e.where("not contains(state_json, 'annotations')").select("id", E.parsed("state_json").alias("s")).where("s is not null").select("id", E.signature("s").alias("signature"))
)

_CHAIN = "'crop=1,10,20,110,220;' || CASE WHEN id%2=0 THEN 'bw=1;' ELSE 'bw=0;' END || 'tilt=1,' || CASE WHEN id%4=0 THEN '-' ELSE '' END || '0.' || (id%9) || ',0;finetune2=1,0.' || (id%4) || ',0.' || (id%3) || ',-0.' || (id%5) || ',0.' || (id%2) || ',0;fill=1,0.' || (id%10) || ';warmth=1,0.' || (id%6) || ';lumi=1,-0.' || (id%7) || ';autolight=1,0.' || (id%8) || ';sat=' || (id%2) || ',0.5;' || CASE id%3 WHEN 0 THEN 'sharpen=1;' WHEN 1 THEN 'sharpen=1,0.9;anisotropic=1,0.2;' ELSE '' END || 'softfocus=1,0.' || (id%10) || ';bad'"
_CLAMP = "greatest(-1.0, least(1.0, {0}))"
_STEPS = f"""WITH v AS (SELECT id, CAST(id%4 AS INTEGER) AS rot, id%3=0 AS has_crop, width AS w, height AS h, (CASE WHEN id%4=0 THEN -1 ELSE 1 END)*(id%9)/10.0 AS tilt, (id%4)/10.0 AS light, (id%3)/10.0 AS dark, -(id%5)/10.0 AS temp, (id%2)/10.0 AS fsat,
  (id%10)/10.0 AS fill, (id%6)/10.0 AS warm, -(id%7)/10.0 AS lumi, (id%8)/10.0 AS auto, id%2=1 AS sat, CASE id%3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.2 END AS sharp FROM photos),
 a AS (SELECT *, CASE WHEN light<>0 THEN light ELSE 0.0 END AS b1, CASE WHEN dark<>0 THEN dark*0.5 ELSE 0.0 END AS c1, temp*0.15 AS r1, CASE WHEN fsat<>0 THEN fsat ELSE 0.0 END AS s1 FROM v),
 b AS (SELECT *, {_CLAMP.format('b1+fill*0.8')} AS b2, {_CLAMP.format('r1+warm*0.2')} AS r2 FROM a), c AS (SELECT *, {_CLAMP.format('b2+lumi')} AS b3 FROM b), d AS (SELECT *, {_CLAMP.format('b3+auto*0.15')} AS b4, {_CLAMP.format('c1+auto*0.2')} AS c2 FROM c),
 s AS (SELECT id, 1 AS o, 'picasa_rotate' AS label, 0.0 AS brightness, 0.0 AS contrast, 0.0 AS color_red, 0.0 AS saturation FROM d WHERE rot > 0 UNION ALL SELECT id, 2, 'picasa_crop', 0, 0, 0, 0 FROM d UNION ALL SELECT id, 3, 'picasa_bw', 0, 0, 0, 0 FROM d WHERE id%2=0
  UNION ALL SELECT id, 4, 'picasa_tilt', 0, 0, 0, 0 FROM d WHERE abs(tilt*2.5/(pi()/4)) > 0.05 UNION ALL SELECT id, 5, 'picasa_finetune2', b1, c1, r1, s1 FROM d WHERE light<>0 OR dark<>0 OR temp<>0 OR fsat<>0 UNION ALL SELECT id, 6, 'picasa_fill', b2, c1, r1, s1 FROM d WHERE fill<>0
  UNION ALL SELECT id, 7, 'picasa_warmth', b2, c1, r2, s1 FROM d WHERE warm<>0 UNION ALL SELECT id, 8, 'picasa_lumi', b3, c1, r2, s1 FROM d WHERE lumi<>0 UNION ALL SELECT id, 9, 'picasa_autolight', b4, c2, r2, s1 FROM d WHERE auto<>0 UNION ALL SELECT id, 10, 'picasa_sat', b4, c2, r2, least(1.0, s1+0.5) FROM d WHERE sat
  UNION ALL SELECT id, 11, CASE WHEN id%3=1 THEN 'picasa_anisotropic' ELSE 'picasa_sharpen' END, b4, c2, r2, CASE WHEN sat THEN least(1.0, s1+0.5) ELSE s1 END FROM d WHERE sharp IS NOT NULL UNION ALL SELECT id, 12, 'picasa_softfocus', b4, c2, r2, CASE WHEN sat THEN least(1.0, s1+0.5) ELSE s1 END FROM d WHERE fill<>0)
 SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS INTEGER) AS place, label, round(brightness, 9) AS brightness, round(contrast, 9) AS contrast, round(color_red, 9) AS color_red, round(saturation, 9) AS saturation FROM s"""


@query("sidecar_edit_steps", ("photos",), _STEPS)
def _(p):
    i, s = F.col("id"), lambda k: (F.col("id") % k).cast("string")
    chain = F.concat(
        F.lit("crop=1,10,20,110,220;"), F.when(i % 2 == 0, "bw=1;").otherwise("bw=0;"), F.lit("tilt=1,"), F.when(i % 4 == 0, "-").otherwise(""), F.lit("0."), s(9), F.lit(",0;finetune2=1,0."), s(4), F.lit(",0."), s(3), F.lit(",-0."), s(5), F.lit(",0."), s(2), F.lit(",0;fill=1,0."), s(10),
        F.lit(";warmth=1,0."), s(6), F.lit(";lumi=1,-0."), s(7), F.lit(";autolight=1,0."), s(8), F.lit(";sat="), s(2), F.lit(",0.5;"), F.when(i % 3 == 0, "sharpen=1;").when(i % 3 == 1, "sharpen=1,0.9;anisotropic=1,0.2;").otherwise(""), F.lit("softfocus=1,0."), s(10), F.lit(";bad"),
    )
    crop = F.when(i % 3 == 0, F.struct(F.lit(0.1).alias("left"), F.lit(0.2).alias("top"), F.lit(0.9).alias("right"), F.lit(0.8).alias("bottom")))
    rows = spread(p.select("id", "width", "height")).select("id", (i % 4).cast("int").alias("rot"), crop.alias("crop"), C.filter_steps(chain).alias("filters"), "width", "height")
    # Spark adds a filter below an inner explode, which would work out the steps, and the filters for each use, once more.
    steps = rows.select("id", F.posexplode_outer(E.edit_steps("rot", "crop", "filters", "width", "height")).alias("place", "step")).where("step is not null")
    return steps.select("id", "place", "step.label", *(F.round(f"step.state.{n}", 9).alias(n) for n in ("brightness", "contrast", "color_red", "saturation")))


# --- geometry -------------------------------------------------------------

query("segment_distances", ("photos",), """WITH s AS (SELECT id, CAST(id%100 AS DOUBLE) AS px, CAST(id%37 AS DOUBLE) AS py, CAST(id%10 AS DOUBLE) AS ax, CAST(id%7 AS DOUBLE) AS ay, CAST(CASE WHEN id%5=0 THEN id%10 ELSE 50 END AS DOUBLE) AS bx, CAST(CASE WHEN id%5=0 THEN id%7 ELSE 20 END AS DOUBLE) AS by_ FROM photos),
 t AS (SELECT *, CASE WHEN ax=bx AND ay=by_ THEN 0 ELSE greatest(0, least(1, ((px-ax)*(bx-ax)+(py-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) END AS t FROM s) SELECT id, round(sqrt(pow(px-ax-t*(bx-ax), 2)+pow(py-ay-t*(by_-ay), 2)), 6) AS distance FROM t""")(
    lambda p: p.select("id", F.round(C.segment_distance(*(c.cast("double") for c in (F.col("id") % 100, F.col("id") % 37, F.col("id") % 10, F.col("id") % 7, F.when(F.col("id") % 5 == 0, F.col("id") % 10).otherwise(50), F.when(F.col("id") % 5 == 0, F.col("id") % 7).otherwise(20)))), 6).alias("distance"))
)
query("gamma_levels", ("photos",), "SELECT id, CAST(floor(pow((id%256)/255.0, 1/2.2)*255+0.5) AS INTEGER) AS level FROM photos")(lambda p: p.select("id", F.get(C.gamma_table(2.2), (F.col("id") % 256).cast("int")).alias("level")))
_PERSPECTIVE = """WITH k AS (SELECT id, CAST(id%9 AS DOUBLE) AS x0, CAST(id%5 AS DOUBLE) AS y0, 100.0+id%11 AS x1, CAST(id%3 AS DOUBLE) AS y1, CASE WHEN id%4=0 THEN 100.0+id%11 ELSE 90.0+id%13 END AS x2, CASE WHEN id%4=0 THEN 80.0+id%3 ELSE 85.0 END AS y2, CASE WHEN id%4=0 THEN CAST(id%9 AS DOUBLE) ELSE 5.0 END AS x3, CASE WHEN id%4=0 THEN 80.0+id%5 ELSE 75.0+id%7 END AS y3, 120.0 AS w, 60.0 AS h FROM photos),
 -- the linear system of the map's two last coefficients, solved by Cramer's rule
 m AS (SELECT *, w*(x1-x2) AS a11, h*(x3-x2) AS a12, x2-x1-x3+x0 AS r1, w*(y1-y2) AS a21, h*(y3-y2) AS a22, y2-y1-y3+y0 AS r2 FROM k),
 g AS (SELECT *, a11*a22-a12*a21 AS det FROM m), s AS (SELECT *, CASE WHEN abs(det)<1e-6 THEN 0 ELSE (r1*a22-a12*r2)/det END AS g, CASE WHEN abs(det)<1e-6 THEN 0 ELSE (a11*r2-r1*a21)/det END AS hh FROM g)
 SELECT id, round(x1*g+(x1-x0)/w, 9) AS a, round(x3*hh+(x3-x0)/h, 9) + 0.0 AS b, round(y1*g+(y1-y0)/w, 9) + 0.0 AS d, round(y3*hh+(y3-y0)/h, 9) AS e, round(g, 9) + 0.0 AS g, round(hh, 9) + 0.0 AS h FROM s"""


@query("perspective_coefficients", ("photos",), _PERSPECTIVE)
def _(p):
    i, flat = F.col("id"), F.col("id") % 4 == 0
    at = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    corners = F.array(at(i % 9, i % 5), at(100 + i % 11, i % 3), at(F.when(flat, 100 + i % 11).otherwise(90 + i % 13), F.when(flat, 80 + i % 3).otherwise(85)), at(F.when(flat, i % 9).otherwise(5), F.when(flat, 80 + i % 5).otherwise(75 + i % 7)))
    return p.select("id", Q.perspective(corners, F.lit(120), F.lit(60)).alias("m")).select("id", *(F.round(f"m.{n}", 9).alias(n) for n in "abdegh"))


_SPLINE = """WITH p AS (SELECT id, [0.0, 10.0+id%7, 25.0, 40.0+id%5] AS xs, [CAST(id%9 AS DOUBLE), 20.0, 5.0+id%3, 30.0] AS ys FROM photos),
 q AS (SELECT id, i, xs[greatest(i-1, 1)] AS ax, ys[greatest(i-1, 1)] AS ay, xs[i] AS bx, ys[i] AS by_, xs[i+1] AS cx, ys[i+1] AS cy, xs[least(i+2, 4)] AS dx, ys[least(i+2, 4)] AS dy FROM p, range(1, 4) t(i)),
 -- knots at the square root of distances; tangents of the curve at both ends of the middle part
 k AS (SELECT *, sqrt(sqrt(pow(bx-ax, 2)+pow(by_-ay, 2))) AS u, sqrt(sqrt(pow(cx-bx, 2)+pow(cy-by_, 2))) AS v, sqrt(sqrt(pow(dx-cx, 2)+pow(dy-cy, 2))) AS w FROM q)
 SELECT id, CAST(i-1 AS INTEGER) AS place, round(CASE WHEN u=0 THEN bx ELSE bx+v/3*((bx-ax)/u-(cx-ax)/(u+v)+(cx-bx)/v) END, 6) AS x1, round(CASE WHEN u=0 THEN by_ ELSE by_+v/3*((by_-ay)/u-(cy-ay)/(u+v)+(cy-by_)/v) END, 6) AS y1,
 round(CASE WHEN w=0 THEN cx ELSE cx-v/3*((cx-bx)/v-(dx-bx)/(v+w)+(dx-cx)/w) END, 6) AS x2, round(CASE WHEN w=0 THEN cy ELSE cy-v/3*((cy-by_)/v-(dy-by_)/(v+w)+(dy-cy)/w) END, 6) AS y2 FROM k"""


@query("spline_controls", ("photos",), _SPLINE)
def _(p):
    i = F.col("id")
    at = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    points = F.array(at(F.lit(0), i % 9), at(10 + i % 7, F.lit(20)), at(F.lit(25), 5 + i % 3), at(40 + i % 5, F.lit(30)))
    rows = p.select("id", F.posexplode(Q.spline_segments(points)).alias("place", "s"))
    return rows.select("id", "place", *(F.round(F.get(f"s.control{c}", F.lit(k)), 6).alias(f"{n}{c}") for c in (1, 2) for k, n in enumerate("xy")))


_HIT = """WITH s AS (SELECT id, CAST(id%200 AS DOUBLE) AS x, CAST(id%90 AS DOUBLE) AS y FROM photos),
 d AS (SELECT id, sqrt(pow(x-20, 2)+pow(y-10, 2)) AS d1, sqrt(pow(x-least(160.0, greatest(40.0, x)), 2)+pow(y-50, 2)) AS d2, least(abs(x-100)+CASE WHEN y BETWEEN 0 AND 40 THEN 0 ELSE 1e9 END, sqrt(pow(x-100, 2)+least(pow(y, 2), pow(y-40, 2)))) AS d3 FROM s)
 SELECT id, CASE WHEN least(d1, d2, d3) >= 8 THEN NULL WHEN d1 <= d2 AND d1 <= d3 THEN 'dot' WHEN d2 <= d3 THEN 'line' ELSE 'pole' END AS hit FROM d"""


@query("annotation_hits", ("photos",), _HIT)
def _(p):
    at = lambda *points: F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in points))
    drawn = F.array(*(F.struct(F.lit(n).alias("id"), points.alias("points")) for n, points in (("dot", at((0.1, 0.1))), ("line", at((0.2, 0.5), (0.8, 0.5))), ("pole", at((0.5, 0.0), (0.5, 0.4))))))
    return p.select("id", Q.nearest_annotation(drawn, (F.col("id") % 200).cast("double"), (F.col("id") % 90).cast("double"), F.lit(200.0), F.lit(100.0)).alias("hit"))


_BORDER = "SELECT id, width, height, CASE id%4 WHEN 0 THEN 0.0 WHEN 1 THEN least(0.3, (id%40)/100.0+0.035) ELSE least(0.3, (id%40)/100.0) END AS s FROM photos"
_BORDER_PX = "CASE WHEN s<=0 THEN 0 ELSE greatest(2, CAST(round_even(s*least(width, height), 0) AS INTEGER)) END"


def _share():
    return Q.border_share(F.when(F.col("id") % 4 == 0, "none").when(F.col("id") % 4 == 1, "double").otherwise("plain"), (F.col("id") % 40) / 100.0)


query("frame_borders", ("photos",), f"SELECT id, round(s, 6) AS share, {_BORDER_PX} AS pixels FROM ({_BORDER})")(lambda p: p.withColumn("s", _share()).select("id", F.round("s", 6).alias("share"), Q.border_pixels("s", "width", "height").alias("pixels")))
query("framed_photo_boxes", ("photos",), f"SELECT id, CAST(b AS DOUBLE) AS x, CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h FROM (SELECT *, {_BORDER_PX} AS b FROM ({_BORDER}))")(
    lambda p: p.withColumn("s", _share()).withColumn("b", Q.border_pixels("s", "width", "height")).select("id", Q.photo_box("s", F.col("width") + 2 * F.col("b"), F.col("height") + 2 * F.col("b")).alias("box")).select("id", "box.x", "box.w", "box.h")
)
query("frame_colours", ("photos",), """WITH c AS (SELECT id, CASE WHEN id%5=0 THEN 255 ELSE CAST(id%256 AS INTEGER) END AS r, CASE WHEN id%5=0 THEN 255 ELSE CAST((id//3)%256 AS INTEGER) END AS g FROM photos)
 SELECT id, r, g, CAST(least(255, round_even(r*1.5, 0)) AS INTEGER) AS lighter, CAST(round_even(r+(g-r)*0.25, 0) AS INTEGER) AS mixed FROM c""")(
    lambda p: p.select("id", Q.hex_colour(F.when(F.col("id") % 5 == 0, "#12345").otherwise(F.format_string("#%02x%02x00", F.col("id") % 256, F.floor(F.col("id") / 3) % 256))).alias("c")).select(
        "id", F.get("c", F.lit(0)).alias("r"), F.get("c", F.lit(1)).alias("g"), F.get(Q.shaded("c", F.lit(1.5)), F.lit(0)).alias("lighter"), F.get(Q.mixed_colour("c", F.array(F.get("c", F.lit(1)), F.lit(0), F.lit(0)), F.lit(0.25)), F.lit(0)).alias("mixed")
    )
)

# --- vectors --------------------------------------------------------------

query("vector_blobs", ("face_vectors",), "SELECT face_id, CAST(256 AS INTEGER) AS n_bytes, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM face_vectors")(
    lambda v: v.select("face_id", V.packed("embedding").alias("blob")).select("face_id", F.octet_length("blob").alias("n_bytes"), F.round(F.aggregate(V.unpacked("blob"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
)
query("cosine_function", ("face_vectors",), "SELECT face_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[]))/list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS score FROM face_vectors")(
    lambda v: v.select("face_id", F.round(C.cosine("embedding", F.reverse("embedding")), 9).alias("score"))
)
