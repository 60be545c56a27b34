"""The edit state of a photo: fields and defaults, JSON, what counts as an edit, and the steps of a sidecar's filters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from shutterlake.functions.columns import col, let

# The fields of an edit state with their defaults.
NUMBERS = {
    "bw_blue": 0.0, "bw_green": 0.0, "bw_red": 0.0, "brightness": 0.0, "color_blue": 0.0, "color_green": 0.0, "color_red": 0.0, "contrast": 0.0, "frame_gap": 0.02, "frame_inner_ornament": 1.0,
    "frame_inner_width": 0.015, "frame_width": 0.05, "gamma": 1.0, "noise_reduction": 0.0, "rotation": 0.0, "saturation": 0.0, "sharpness": 0.0, "straighten": 0.0, "vignette_angle": 0.0,
    "vignette_cx": 0.5, "vignette_cy": 0.5, "vignette_rx1": 0.4, "vignette_rx2": 0.8, "vignette_ry1": 0.4, "vignette_ry2": 0.8, "vignette_strength": 0.0,
}
FLAGS = {"bw": False, "flip_h": False, "flip_v": False, "frame_inner_enabled": False, "frame_inner_relief": True, "gamma_use_curve": False}
TEXTS = {
    "frame_color": "#f2f2f2", "frame_color2": "#8c8c8c", "frame_gap_color": "#ffffff", "frame_inner_color": "#303030", "frame_inner_motif": "line", "frame_style": "solid", "frame_type": "none",
    "vignette_color": "black",
}
CURVE = ((0.0, 0.0), (0.5, 0.5), (1.0, 1.0))
_NUMBER_LIST = T.ArrayType(T.DoubleType())
_LISTS = {"annotations": T.ArrayType(T.StringType()), "crop": _NUMBER_LIST, "gamma_curve_points": T.ArrayType(_NUMBER_LIST), "red_eye_regions": T.ArrayType(_NUMBER_LIST)}
#: All fields in order of name, as JSON with sorted keys has them.
FIELDS = sorted([*NUMBERS, *FLAGS, *TEXTS, *_LISTS])
_TYPES = dict.fromkeys(NUMBERS, T.DoubleType()) | dict.fromkeys(FLAGS, T.BooleanType()) | dict.fromkeys(TEXTS, T.StringType()) | _LISTS
SCHEMA = T.StructType([T.StructField(n, _TYPES[n]) for n in FIELDS])


def _default(name: str, value: Column) -> Column:
    if name in TEXTS:  # an empty text counts as none
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(TEXTS[name]))
    if name == "crop":  # four or eight numbers, or null
        return F.when(F.size(value) > 0, value)
    if name == "gamma_curve_points":
        return F.coalesce(value, F.array(*(F.array(*map(F.lit, p)) for p in CURVE)))
    if name in _LISTS:
        return F.coalesce(value, F.array().cast(_LISTS[name]))
    return F.coalesce(value, F.lit((NUMBERS | FLAGS)[name]))


def parsed(text) -> Column:
    """The state that a JSON text holds, with defaults for what it lacks; null if it is no JSON object."""

    def state(t: Column) -> Column:
        ok = F.startswith(F.ltrim(t), F.lit("{")) & F.try_parse_json(t).isNotNull()
        return F.when(ok, let(F.from_json(t, SCHEMA, {"mode": "PERMISSIVE"}), lambda raw: F.struct(*(_default(n, raw[n]).alias(n) for n in FIELDS))))

    return let(col(text), state)


def as_json(state) -> Column:
    """A state as JSON with all fields in order of name."""
    return F.to_json(col(state), {"ignoreNullFields": "false"})


def modified(state) -> Column:
    """True if a state changes its photo. Channel weights of black and white, and a frame's or vignette's parameters alone, do not."""
    s = col(state)
    moved = [s[n] != 0.0 for n in ("brightness", "contrast", "saturation", "sharpness", "noise_reduction", "rotation", "straighten", "color_red", "color_green", "color_blue")]
    flags = [s[n] for n in ("gamma_use_curve", "flip_h", "flip_v", "bw")]
    lists = [F.size(s["red_eye_regions"]) > 0, F.size(s["annotations"]) > 0]
    return reduce(Column.__or__, [*moved, *flags, *lists, s["gamma"] != 1.0, s["crop"].isNotNull(), s["vignette_strength"] > 0.0, s["frame_type"] != "none"])


def signature(state) -> Column:
    """16 hex digits that tell states apart; '' for a state that changes nothing."""
    return F.when(modified(state), F.substring(F.md5(as_json(state)), 1, 16)).otherwise(F.lit(""))


# --- sidecar filters ------------------------------------------------------

#: The parts of a state that sidecar filters set.
STEP_FIELDS = ("rotation", "crop", "bw", "straighten", "brightness", "contrast", "color_red", "color_blue", "saturation", "sharpness", "noise_reduction")


def _clamped(value: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def edit_steps(rotate, crop, filters, width=None, height=None) -> Column:
    """Array of (label, state after the step), one for each edit of a sidecar, in the order they apply.

    rotate: quarter turns; crop: struct of fractions left, top, right, bottom;
    filters: map of name to values (see columns.filter_steps). width and height,
    where known, give the crop that a filter states in pixels.
    """
    f = col(filters)
    value = lambda name, i: F.get(f[name], F.lit(i)).try_cast("double")
    on = lambda name: F.coalesce(value(name, 0) >= 1, F.lit(False))
    amount = lambda name, i=1: F.coalesce(value(name, i), F.lit(0.0))
    label = lambda name: F.lit(f"picasa_{name}")
    zero = F.lit(0.0)
    # What a step adds is 0 where it does not apply, so that each value names the one before it once.
    added = lambda old, applies, amount: _clamped(old + F.when(applies, amount).otherwise(zero))
    state = {n: zero for n in STEP_FIELDS} | {"crop": F.lit(None).cast("array<double>"), "bw": F.lit(False)}
    values, steps = [], []  # values that are computed once; of each step the label, the number of the value that tells if it applies, and those of its state

    def step(name: Column, applies: Column, **changes: Column) -> None:
        state.update(changes)
        at = {n: len(values) + 1 + k for k, n in enumerate(changes)}
        before = steps[-1][2] if steps else {}
        values.extend([applies, *changes.values()])
        steps.append((name, len(values) - 1 - len(changes), before | at))

    turns = F.coalesce(col(rotate).between(1, 3), F.lit(False))
    step(label("rotate"), turns, rotation=F.when(turns, col(rotate) * 90.0).otherwise(zero))
    c = col(crop)
    whole = c.isNotNull() & (c["right"] > c["left"]) & (c["bottom"] > c["top"])
    box, fits = F.array(c["left"], c["top"], c["right"] - c["left"], c["bottom"] - c["top"]), whole
    if width is not None:
        w, h = col(width).cast("double"), col(height).cast("double")
        left, top, right, bottom = (value("crop", i) for i in (1, 2, 3, 4))
        pixels = c.isNull() & on("crop") & (w > 0) & (h > 0) & (right > left) & (bottom > top)
        box = F.when(whole, box).otherwise(F.array(left / w, top / h, right / w - left / w, bottom / h - top / h))
        fits = whole | pixels
    fits = F.coalesce(fits, F.lit(False))
    step(label("crop"), fits, crop=F.when(fits, box))
    step(label("bw"), on("bw"), bw=on("bw"))
    # A tilt is stated in radians up to a quarter of pi, which stands for 2.5 degrees the other way.
    angle = -(amount("tilt") * 2.5 / (math.pi / 4.0))
    tilted = on("tilt") & (F.abs(angle) > 0.05)
    step(label("tilt"), tilted, straighten=F.when(tilted, _clamped(angle, -2.5, 2.5)).otherwise(zero))
    light, dark, warm, sat = (amount("finetune2", i) for i in (1, 2, 3, 4))
    either = on("finetune2") & ((light != 0) | (dark != 0) | (warm != 0) | (sat != 0))
    given = lambda new: F.when(either, _clamped(new)).otherwise(zero)  # noqa: E731  nothing before has set these
    step(label("finetune2"), either, brightness=given(light), contrast=given(dark * 0.5), color_red=given(_clamped(warm) * 0.15), color_blue=given(zero - _clamped(warm) * 0.15), saturation=given(sat))
    fill = on("fill") & (amount("fill") != 0)
    step(label("fill"), fill, brightness=added(state["brightness"], fill, amount("fill") * 0.8))
    tinted, tint = on("warmth") & (amount("warmth") != 0), _clamped(amount("warmth")) * 0.20
    step(label("warmth"), tinted, color_red=added(state["color_red"], tinted, tint), color_blue=added(state["color_blue"], tinted, -tint))
    lumi = on("lumi") & (amount("lumi") != 0)
    step(label("lumi"), lumi, brightness=added(state["brightness"], lumi, amount("lumi")))
    lit, auto = on("autolight") & (amount("autolight") != 0), _clamped(amount("autolight"), 0.0)
    step(label("autolight"), lit, brightness=added(state["brightness"], lit, auto * 0.15), contrast=added(state["contrast"], lit, auto * 0.20))
    more = on("sat") & (amount("sat") != 0)
    step(label("sat"), more, saturation=added(state["saturation"], more, amount("sat")))
    edge = F.when(on("anisotropic"), F.coalesce(value("anisotropic", 1), F.lit(0.5))).when(on("sharpen"), F.coalesce(value("sharpen", 1), F.lit(0.5))).otherwise(zero)
    step(F.when(on("anisotropic"), label("anisotropic")).otherwise(label("sharpen")), on("anisotropic") | on("sharpen"), sharpness=_clamped(edge, 0.0))
    soft = on("softfocus") & (amount("softfocus") != 0)
    step(label("softfocus"), soft, noise_reduction=F.when(soft, _clamped(amount("softfocus") * 0.5, 0.0)).otherwise(zero))
    start = {n: zero for n in STEP_FIELDS} | {"crop": F.lit(None).cast("array<double>"), "bw": F.lit(False)}

    def listed(v: Column) -> Column:
        whole_state = lambda at: F.struct(*((v[f"v{at[n]}"] if n in at else start[n]).alias(n) for n in STEP_FIELDS))
        return F.array(*(F.when(v[f"v{applies}"], F.struct(name.alias("label"), whole_state(at).alias("state"))) for name, applies, at in steps))

    return F.array_compact(let(F.struct(*(x.alias(f"v{k}") for k, x in enumerate(values))), listed))
