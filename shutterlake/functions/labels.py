"""Readable labels of a photo's metadata values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from shutterlake.functions import columns as C

# The labels of numbered metadata values.
NAMED = {
    "ExposureProgram": {0: "Not defined", 1: "Manual", 2: "Program AE", 3: "Aperture priority", 4: "Shutter priority", 5: "Creative (depth of field)", 6: "Action (fast shutter)", 7: "Portrait", 8: "Landscape"},
    "MeteringMode": {0: "Unknown", 1: "Average", 2: "Centre-weighted average", 3: "Spot", 4: "Multi-spot", 5: "Pattern", 6: "Partial"},
    "WhiteBalance": {0: "Auto", 1: "Manual"},
    "ExposureMode": {0: "Auto", 1: "Manual", 2: "Auto bracket"},
    "ColorSpace": {1: "sRGB", 2: "Adobe RGB", 65535: "Uncalibrated"},
    "Orientation": {1: "Normal", 2: "Mirror H", 3: "180°", 4: "Mirror V", 5: "Mirror H + 270°", 6: "90° clockwise", 7: "Mirror H + 90°", 8: "270° clockwise"},
    "ResolutionUnit": {1: "No unit", 2: "dpi", 3: "dpcm"},
    "SceneCaptureType": {0: "Standard", 1: "Landscape", 2: "Portrait", 3: "Night scene"},
    "LightSource": {
        0: "Unknown", 1: "Daylight", 2: "Fluorescent", 3: "Tungsten (incandescent)", 4: "Flash", 9: "Fine weather", 10: "Cloudy", 11: "Shade", 12: "Daylight fluorescent (D)", 13: "Day white fluorescent (N)",
        14: "Warm white fluorescent (W)", 15: "Cool white fluorescent", 17: "Standard light A", 18: "Standard light B", 19: "Standard light C", 20: "D55", 21: "D65", 22: "D75", 255: "Other",
    },
    "GainControl": {0: "None", 1: "Low gain up", 2: "High gain up", 3: "Low gain down", 4: "High gain down"},
    "Contrast": {0: "Normal", 1: "Soft", 2: "Hard"},
    "Saturation": {0: "Normal", 1: "Soft", 2: "Hard"},
    "Sharpness": {0: "Normal", 1: "Soft", 2: "Hard"},
    "SubjectDistanceRange": {0: "Unknown", 1: "Macro", 2: "Close view", 3: "Distant view"},
    "SensitivityType": {0: "Unknown", 1: "SOS", 2: "REI", 3: "Standard output sensitivity", 4: "SOS + REI", 5: "SOS + ISO", 6: "REI + ISO", 7: "SOS + REI + ISO"},
    "CustomRendered": {0: "Normal process", 1: "Custom process"},
    "Compression": {1: "Uncompressed", 2: "CCITT 1D", 3: "CCITT Group 3", 4: "CCITT Group 4", 5: "LZW", 6: "JPEG (old)", 7: "JPEG", 8: "Deflate/ZIP", 32773: "PackBits (Mac)", 34713: "Nikon NEF compressed"},
    "Flash": {
        0x00: "Did not fire", 0x01: "Fired", 0x05: "Fired, return not detected", 0x07: "Fired, return detected", 0x08: "On, did not fire", 0x09: "On, fired", 0x0D: "On, return not detected",
        0x0F: "On, return detected", 0x10: "Off, did not fire", 0x18: "Off, return not detected", 0x19: "Off, fired", 0x1D: "Off, return not detected", 0x1F: "Off, return detected",
        0x20: "Auto, did not fire", 0x24: "Auto, did not fire, red-eye reduction", 0x25: "Auto, fired", 0x27: "Auto, return detected", 0x29: "Auto, fired, red-eye reduction",
        0x2F: "Auto, return detected, red-eye reduction", 0x30: "No flash function", 0x41: "Fired, red-eye reduction", 0x45: "Fired, return not detected, red-eye reduction",
        0x47: "Fired, return detected, red-eye reduction", 0x49: "On, fired, red-eye reduction", 0x4D: "On, return not detected, red-eye reduction", 0x4F: "On, return detected, red-eye reduction",
        0x59: "Auto, fired, red-eye reduction", 0x5D: "Auto, return not detected, red-eye reduction", 0x5F: "Auto, return detected, red-eye reduction",
    },
}


def wide_text(data) -> Column:
    """Text of the UTF-16LE bytes that some metadata fields hold, without the zeros at its end."""
    return F.rtrim(F.decode(C.col(data), "UTF-16LE"), F.lit("\0"))


def lens_text(short, long, wide, tele) -> Column:
    """Focal lengths and apertures of a lens: '24–70 mm  f/2.8–f/4.0', with one number where both ends agree."""
    a, b, x, y = (C.col(c).cast("double") for c in (short, long, wide, tele))
    mm = F.when(a != b, F.format_string("%.0f–%.0f mm", F.bround(a), F.bround(b))).otherwise(F.format_string("%.0f mm", F.bround(a)))
    stop = F.when(x != y, F.format_string("f/%.1f–f/%.1f", x, y)).otherwise(F.format_string("f/%.1f", x))
    return F.concat(mm, F.lit("  "), stop)


def _named(tag: Column, value: Column) -> Column:
    """Label of a numbered value; null for other tags and unknown numbers."""
    table = F.create_map(*chain.from_iterable((F.lit(t), F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))) for t, values in NAMED.items()))
    return F.try_element_at(F.try_element_at(table, tag), value.try_cast("double").cast("int"))


def label(tag, value) -> Column:
    """Readable text of a metadata value, itself a text; what cannot be read stays as it is, trimmed; null gives ''."""
    t, v = C.col(tag), C.col(value)
    n = v.try_cast("double")
    when = F.try_to_timestamp(v, F.lit("yyyy:MM:dd HH:mm:ss"))
    text = (
        F.when(t == "ExposureTime", C.exposure_text(n))
        .when(t == "FNumber", F.format_string("f/%.1f", n))
        .when(t == "MaxApertureValue", C.aperture_text(n))
        .when(t == "FocalLength", F.format_string("%.0f mm", F.bround(n)))
        .when(t == "FocalLengthIn35mmFilm", F.format_string("%d mm", n.cast("long")))
        .when(t.isin("ISOSpeedRatings", "RecommendedExposureIndex"), n.cast("long").cast("string"))
        .when(t == "DateTimeOriginal", F.date_format(when, "MM/dd/yyyy  HH:mm:ss"))
        .when(t == "ExposureBiasValue", F.format_string("%+.1f EV", n))
        .when(t == "BrightnessValue", F.format_string("%.2f EV", n))
        .when(t == "DigitalZoomRatio", F.when(n.isin(0.0, 1.0), "No zoom").otherwise(F.format_string("×%.2f", n)))
        .when(t == "SubjectDistance", F.when(n < 9999, F.format_string("%.2f m", n)).otherwise("Infinity"))
        .when(t.isin("XResolution", "YResolution"), F.format_string("%.0f", F.bround(n)))
        .when(t == "Flash", F.coalesce(_named(t, v), F.concat(F.lit("0x"), F.lpad(F.hex(n.cast("long")), 2, "0"))))
        .when(t.isin(*NAMED), _named(t, v))
    )
    readable = F.when(t == "DateTimeOriginal", when.isNotNull()).otherwise(n.isNotNull())
    return F.when(v.isNull(), "").otherwise(F.coalesce(F.when(readable, text), F.trim(v)))
