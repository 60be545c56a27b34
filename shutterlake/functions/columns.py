"""Column expressions of the photo library: tags, dates, paths, boxes, vectors and display formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The file name extensions of videos.
VIDEO_EXTENSIONS = ("3gp", "avi", "flv", "m2ts", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "mts", "ts", "vob", "webm", "wmv")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- tags -----------------------------------------------------------------


def normal_tags(tags) -> Column:
    """Trimmed tags without empty ones and ones that hold a comma, each once, in order."""
    return F.array_distinct(F.filter(F.transform(col(tags), lambda t: F.trim(t)), lambda t: (t != "") & ~F.contains(t, F.lit(","))))


def split_tags(text) -> Column:
    return normal_tags(F.split(F.coalesce(col(text), F.lit("")), ","))


def has_tag(tags, tag: str) -> Column:
    """Whole element, whatever its case."""
    return F.exists(col(tags), lambda t: F.lower(t) == tag.lower())


def add_tags(tags, new: list[str]) -> Column:
    return normal_tags(F.concat(F.coalesce(col(tags), F.array().cast("array<string>")), F.array(*map(F.lit, new)).cast("array<string>")))


def tag_changes(old, new) -> tuple[Column, Column]:
    """(to add, to remove)."""
    return F.array_except(col(new), col(old)), F.array_except(col(old), col(new))


# --- dates ----------------------------------------------------------------


def effective_date(taken="date_taken", mtime="file_mtime") -> Column:
    """When a photo was taken, else when its file was changed (epoch seconds, UTC)."""
    return F.coalesce(col(taken), F.timestamp_seconds(col(mtime)).cast("timestamp_ntz"))


def dates_differ(a, b) -> Column:
    return col(a).isNotNull() & col(b).isNotNull() & (col(a) != col(b))


def coherent_date(d, now_year: int) -> Column:
    return F.year(col(d)).between(1990, now_year + 1)


def subsecond_micros(text) -> Column:
    """'05' is 50,000 microseconds; anything but digits is 0."""
    t = F.trim(col(text))
    return F.when(t.rlike("^[0-9]+$"), F.rpad(F.substring(t, 1, 6), 6, "0").cast("int")).otherwise(F.lit(0))


def degrees(d, m, s, ref) -> Column:
    value = col(d) + col(m) / 60.0 + col(s) / 3600.0
    return F.when(F.upper(col(ref)).isin("S", "W"), -value).otherwise(value)


def backup_time(name) -> Column:
    return F.try_to_timestamp(F.regexp_extract(col(name), r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))


# --- paths ----------------------------------------------------------------


def extension(path) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./\\]+)$", 1))


def is_video(path) -> Column:
    return extension(path).isin(*VIDEO_EXTENSIONS)


def is_hidden(path) -> Column:
    return F.startswith(F.element_at(F.split(col(path), "/"), -1), F.lit("."))


def in_assets(path) -> Column:
    """True if a folder of the path is named *_assets."""
    parts = F.split(col(path), "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.endswith(p, F.lit("_assets")))


def pruned(path) -> Column:
    """True for files that a scan passes over: hidden, thumbnail, original and asset folders."""
    folders = F.slice(F.split(col(path), "/"), 1, F.greatest(F.size(F.split(col(path), "/")) - 1, F.lit(0)))
    return is_hidden(path) | F.exists(folders, lambda p: F.startswith(p, F.lit(".")) | F.lower(p).isin("originals", "thumbnails") | F.endswith(p, F.lit("_assets")))


def under(path, folder: str) -> Column:
    """The folder itself or anything below it."""
    return (col(path) == folder) | F.startswith(col(path), F.lit(folder + "/"))


def moved(path, old: str, new: str) -> Column:
    return F.when(under(path, old), F.concat(F.lit(new), F.substring(col(path), len(old) + 1, 1 << 20))).otherwise(col(path))


def ancestors(folder) -> Column:
    """Every folder from the top down to this one: /a, /a/b, ..."""
    parts = F.split(col(folder), "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


# --- boxes ----------------------------------------------------------------


def overlap(a: tuple, b: tuple) -> Column:
    """Area shared by two (x, y, w, h)."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = [tuple(map(col, t)) for t in (a, b)]
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union; 0 if there is no area."""
    shared = overlap(a, b).cast("double")
    union = col(a[2]) * col(a[3]) + col(b[2]) * col(b[3]) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def centre_inside(box: tuple, outer: tuple) -> Column:
    """The whole-pixel centre of box lies in outer."""
    x, y, w, h = map(col, box)
    ox, oy, ow, oh = map(col, outer)
    cx, cy = x + F.floor(w / 2), y + F.floor(h / 2)
    return (cx >= ox) & (cx <= ox + ow) & (cy >= oy) & (cy <= oy + oh)


def rect64(text) -> Column:
    """Four fractions (left, top, right, bottom) of 16 bits each from 16 hex digits."""
    digits = F.lpad(F.lower(col(text)), 16, "0")
    part = lambda i: F.conv(F.substring(digits, 4 * i + 1, 4), 16, 10).cast("int") / 65535.0
    return F.struct(part(0).alias("left"), part(1).alias("top"), part(2).alias("right"), part(3).alias("bottom"))


def oriented(x, y, w, h, width, height, orientation) -> Column:
    """A box of the raw pixel frame in the frame that an EXIF orientation of 1 to 8 shows."""
    x, y, w, h, width, height, o = map(col, (x, y, w, h, width, height, orientation))
    box = lambda *v: F.struct(*(c.cast("long").alias(n) for c, n in zip(v, "xywh")))
    right, below = width - x - w, height - y - h
    return (
        F.when(o == 2, box(right, y, w, h)).when(o == 3, box(right, below, w, h)).when(o == 4, box(x, below, w, h)).when(o == 5, box(y, x, h, w))
        .when(o == 6, box(below, x, h, w)).when(o == 7, box(below, right, h, w)).when(o == 8, box(y, right, h, w)).otherwise(box(x, y, w, h))
    )


def inscribed_scale(width, height, angle) -> Column:
    """Scale of the largest upright rectangle of the same shape inside a photo straightened by an angle in degrees."""
    a = F.radians(F.abs(col(angle)))
    w, h = col(width).cast("double"), col(height).cast("double")
    return F.least(w / (w * F.cos(a) + h * F.sin(a)), h / (w * F.sin(a) + h * F.cos(a)))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


# --- vectors --------------------------------------------------------------


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    d = norm(a) * norm(b)
    return F.when(d <= 1e-8, F.lit(0.0)).otherwise(dot(a, b) / d)


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def sign_bits(v, n: int = 63) -> Column:
    """Bit i is set if element i is above 0."""
    bits = [F.when(F.get(col(v), F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(n)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


# --- formats --------------------------------------------------------------


def size_text(n) -> Column:
    """Bytes in steps of 1024, rounded down."""
    n = col(n)
    step = lambda k, unit: F.concat(F.floor(n / (1024**k)).cast("string"), F.lit(" " + unit))
    return F.when(n < 1024, step(0, "B")).when(n < 1024**2, step(1, "KB")).when(n < 1024**3, step(2, "MB")).when(n < 1024**4, step(3, "GB")).otherwise(step(4, "TB"))


def exposure_text(seconds) -> Column:
    s = col(seconds)
    return F.when(s >= 1, F.format_string("%.1f s", s.cast("double"))).when(s > 0, F.concat(F.lit("1/"), F.bround(1 / s).cast("long").cast("string"), F.lit(" s")))


def aperture_text(apex) -> Column:
    return F.format_string("f/%.1f", F.sqrt(F.pow(F.lit(2.0), col(apex).cast("double"))))


def cache_key(path) -> Column:
    return F.md5(col(path))


def version_parts(text) -> Column:
    return F.transform(F.split(F.regexp_replace(col(text), "^[vV]", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, "^[0-9]+", 0).try_cast("int"), F.lit(0)))


def hex_rgb(text) -> Column:
    t = F.regexp_replace(col(text), "^#", "")
    return F.struct(*(F.conv(F.substring(t, 2 * i + 1, 2), 16, 10).cast("int").alias(n) for i, n in enumerate("rgb")))


def gamma_table(gamma: float) -> Column:
    """The 256 output levels of a gamma curve."""
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.floor(F.pow(i / 255.0, F.lit(1.0 / gamma)) * 255 + 0.5).cast("int"))


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filter_steps(chain) -> Column:
    """Map of a sidecar's filter chain 'name=enabled,p1,...;': name to its values; the last of a name counts."""
    items = F.filter(F.split(F.coalesce(col(chain), F.lit("")), ";"), lambda s: F.contains(s, F.lit("=")) & (F.substring_index(s, "=", 1) != ""))
    pairs = F.transform(items, lambda s: F.struct(F.trim(F.substring_index(s, "=", 1)).alias("k"), F.split(F.regexp_replace(s, "^[^=]*=", ""), ",").alias("v")))
    last = lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(let(pairs, last))
