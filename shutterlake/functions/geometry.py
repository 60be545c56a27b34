"""Plane geometry as columns: perspective, splines, hits on drawn lines, and frames around photos."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shutterlake.functions.columns import col, segment_distance

#: A frame takes at most this share of a photo's short side.
MOST_BORDER = 0.30


def perspective(corners, width, height) -> Column:
    """Coefficients a..h of the map from a width x height picture to four corners (x, y): top left, top right, bottom right, bottom left."""
    p = [(F.get(F.get(col(corners), F.lit(i)), F.lit(0)).cast("double"), F.get(F.get(col(corners), F.lit(i)), F.lit(1)).cast("double")) for i in range(4)]
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = p
    w, h = col(width).cast("double"), col(height).cast("double")
    # Edge vectors at the corner opposite the origin, and how far the corners are from a parallelogram.
    ux, uy, vx, vy = w * (x1 - x2), w * (y1 - y2), h * (x3 - x2), h * (y3 - y2)
    sx, sy = x2 - x1 - x3 + x0, y2 - y1 - y3 + y0
    det = ux * vy - vx * uy
    flat = F.abs(det) < 1e-6
    g = F.when(flat, 0.0).otherwise((sx * vy - vx * sy) / F.nullif(det, F.lit(0.0)))
    k = F.when(flat, 0.0).otherwise((ux * sy - sx * uy) / F.nullif(det, F.lit(0.0)))
    values = {"a": x1 * g + (x1 - x0) / w, "b": x3 * k + (x3 - x0) / h, "c": x0, "d": y1 * g + (y1 - y0) / w, "e": y3 * k + (y3 - y0) / h, "f": y0, "g": g, "h": k}
    return F.struct(*(v.alias(n) for n, v in values.items()))


def spline_segments(points, alpha: float = 0.5) -> Column:
    """Cubic Bézier segments (start, control 1, control 2, end) of a centripetal Catmull-Rom spline through points, arrays (x, y).

    Two points give a straight segment; fewer give none. The end points count
    twice, and where two points fall together the control point is the nearer end.
    """
    p = col(points)
    n = F.size(p)
    at = lambda i: F.get(p, F.greatest(F.lit(0), F.least(i, n - 1)))
    gap = lambda a, b: F.pow(F.hypot(b[0] - a[0], b[1] - a[1]), F.lit(alpha))

    def control(before: Column, near: Column, far: Column, sign: int) -> Column:
        """The control point next to near, on the way to far; before is near's other neighbour."""
        d1, d2 = gap(before, near), gap(near, far)
        scale = 3 * d1 * (d1 + d2)
        part = lambda i: (d1 * d1 * far[i] - d2 * d2 * before[i] + (2 * d1 * d1 + 3 * d1 * d2 + d2 * d2) * near[i]) / F.nullif(scale, F.lit(0.0))
        return F.when((d1 > 1e-9) & (d2 > 1e-9), F.array(part(0), part(1))).otherwise(near)

    def segment(i: Column) -> Column:
        a, b, c, d = at(i - 1), at(i), at(i + 1), at(i + 2)
        return F.struct(b.alias("start"), control(a, b, c, 1).alias("control1"), control(d, c, b, -1).alias("control2"), c.alias("end"))

    straight = F.array(F.struct(at(F.lit(0)).alias("start"), at(F.lit(0)).alias("control1"), at(F.lit(1)).alias("control2"), at(F.lit(1)).alias("end")))
    return F.when(n == 2, straight).when(n > 2, F.transform(F.sequence(F.lit(0), n - 2), segment)).otherwise(F.slice(straight, 1, 0))


def line_distance(points, x, y, width, height) -> Column:
    """Distance from (x, y) to a line through points, given as fractions of a picture; null without points."""
    p, w, h = col(points), col(width), col(height)
    n = F.size(p)
    px = lambda i: F.get(F.get(p, i), F.lit(0)) * w
    py = lambda i: F.get(F.get(p, i), F.lit(1)) * h
    first = F.hypot(col(x) - px(F.lit(0)), col(y) - py(F.lit(0)))
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: segment_distance(col(x), col(y), px(i), py(i), px(i + 1), py(i + 1)))
    return F.when(n == 1, first).when(n > 1, F.array_min(each))


def nearest_annotation(annotations, x, y, width, height, tolerance: float = 8.0) -> Column:
    """Id of the drawn annotation nearest to a point, within a tolerance; the first of equals. annotations: array of (id, points)."""
    placed = F.transform(col(annotations), lambda a, i: F.struct(line_distance(a["points"], x, y, width, height).alias("d"), i.alias("i"), a["id"].alias("id")))
    return F.array_min(F.filter(placed, lambda s: s["d"] < tolerance))["id"]


# --- frames ---------------------------------------------------------------


def border_share(kind, width=0.05, gap=0.02, inner=0.015) -> Column:
    """Thickness of a photo's frame as a share of its short side; a double frame has a gap and an inner band too."""
    k, part = col(kind), lambda c: F.lit(c) if isinstance(c, float) else col(c)
    whole = part(width) + F.when(k == "double", part(gap) + part(inner)).otherwise(F.lit(0.0))
    return F.when(F.coalesce(k, F.lit("none")) == "none", F.lit(0.0)).otherwise(F.least(F.lit(MOST_BORDER), whole))


def border_pixels(share, width, height) -> Column:
    """Thickness of a frame in pixels, two at least."""
    s = col(share)
    none = (s <= 0) | (col(width) <= 0) | (col(height) <= 0)
    return F.when(none, F.lit(0)).otherwise(F.greatest(F.lit(2), F.bround(s * F.least(col(width), col(height))).cast("int")))


def photo_box(share, width, height) -> Column:
    """(x, y, w, h) of the photo inside a framed picture: the border of which border_pixels gives the same again, if there is one near."""
    s, w, h = col(share), col(width).cast("double"), col(height).cast("double")
    short = F.least(w, h)
    guess = F.bround(s * short / (1.0 + 2.0 * s)).cast("int")
    tries = F.filter(F.array(*(guess + d for d in (0, -1, 1, -2, 2))), lambda b: (b >= 0) & (2 * b < short) & (border_pixels(s, short - 2 * b, short - 2 * b) == b))
    b = F.greatest(F.lit(0), F.least(F.coalesce(F.get(tries, F.lit(0)), guess), F.floor((short - 1) / 2).cast("int"))).cast("double")
    framed = (s > 0) & (w > 0) & (h > 0)
    box = lambda *v: F.struct(*(c.alias(n) for c, n in zip(v, "xywh")))
    return F.when(framed, box(b, b, F.greatest(F.lit(1.0), w - 2 * b), F.greatest(F.lit(1.0), h - 2 * b))).otherwise(box(F.lit(0.0), F.lit(0.0), w, h))


def hex_colour(text, default: tuple[int, int, int] = (255, 255, 255)) -> Column:
    """[r, g, b] of '#rrggbb' or '#rgb'; the default for anything else."""
    t = F.regexp_replace(F.trim(col(text)), "^#+", "")
    six = F.when(F.length(t) == 3, F.regexp_replace(t, "(.)", "$1$1")).otherwise(t)
    parts = F.array(*(F.conv(F.substring(six, 2 * i + 1, 2), 16, 10).cast("int") for i in range(3)))
    return F.when(six.rlike("^[0-9a-fA-F]{6}$"), parts).otherwise(F.array(*map(F.lit, default)))


def shaded(colour, factor) -> Column:
    """A colour made lighter (above 1) or darker (below 1)."""
    return F.transform(col(colour), lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c * col(factor)).cast("int"))))


def mixed_colour(first, second, share) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(share).cast("double")))
    return F.zip_with(col(first), col(second), lambda a, b: F.bround(a + (b - a) * t).cast("int"))
