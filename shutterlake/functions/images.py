"""Image operators on decoded arrays (height x width x 3, values 0 to 255), and boxes through geometry."""

from __future__ import annotations

import math

import numpy as np

#: The order in which edits are applied (a fixed rule of the edit model).
ORDER = ("rotation", "flip_h", "flip_v", "crop", "bw", "brightness", "contrast", "saturation", "channels", "gamma", "sharpness", "noise", "red_eye", "vignette")


def _bytes(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def brightness(a: np.ndarray, factor: float) -> np.ndarray:
    return _bytes(a.astype(float) * factor)


def luma(a: np.ndarray) -> np.ndarray:
    return a.astype(float) @ np.array([0.299, 0.587, 0.114])


def contrast(a: np.ndarray, factor: float) -> np.ndarray:
    mean = round(float(luma(a).mean()))
    return _bytes(mean + (a.astype(float) - mean) * factor)


def saturation(a: np.ndarray, factor: float) -> np.ndarray:
    grey = luma(a)[..., None]
    return _bytes(grey + (a.astype(float) - grey) * factor)


def gamma(a: np.ndarray, value: float) -> np.ndarray:
    table = _bytes(255 * (np.arange(256) / 255) ** (1 / value))
    return table[a]


def channels(a: np.ndarray, red: float = 1, green: float = 1, blue: float = 1) -> np.ndarray:
    return _bytes(a.astype(float) * np.array([red, green, blue]))


def black_and_white(a: np.ndarray, red: float = 0.299, green: float = 0.587, blue: float = 0.114) -> np.ndarray:
    weights = np.array([red, green, blue], float)
    total = weights.sum()
    return np.repeat(_bytes(a.astype(float) @ (weights / total if total else weights))[..., None], 3, axis=2)


def _blurred(a: np.ndarray, radius: float) -> np.ndarray:
    if radius <= 0:
        return a.astype(float)
    k = np.arange(-math.ceil(3 * radius), math.ceil(3 * radius) + 1)
    w = np.exp(-(k**2) / (2 * radius**2))
    w /= w.sum()
    out = a.astype(float)
    for axis in (0, 1):
        padded = np.pad(out, [(len(k) // 2,) * 2 if i == axis else (0, 0) for i in range(3)], mode="edge")
        out = sum(wi * np.take(padded, np.arange(i, i + a.shape[axis]), axis=axis) for i, wi in enumerate(w))
    return out


def noise_reduction(a: np.ndarray, value: float) -> np.ndarray:
    return _bytes(_blurred(a, 2 * value))


def sharpness(a: np.ndarray, factor: float) -> np.ndarray:
    soft = _blurred(a, 0.8)
    return _bytes(soft + (a - soft) * factor)


def red_eye(a: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """Where red is over 80 and 1.3 times the others, it becomes their mean."""
    x, y, w, h = box
    out = a.copy()
    part = out[y : y + h, x : x + w].astype(float)
    r, g, b = part[..., 0], part[..., 1], part[..., 2]
    part[..., 0] = np.where((r > 80) & (r > 1.3 * g) & (r > 1.3 * b), (g + b) / 2, r)
    out[y : y + h, x : x + w] = _bytes(part)
    return out


def vignette(a: np.ndarray, strength: float, inner: float = 0.5, outer: float = 1.0) -> np.ndarray:
    h, w = a.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    d = np.hypot((x - (w - 1) / 2) / max(w / 2, 1), (y - (h - 1) / 2) / max(h / 2, 1))
    t = np.clip((d - inner) / max(outer - inner, 1e-9), 0, 1)
    return _bytes(a * (1 - strength * (t * t * (3 - 2 * t)))[..., None])


def rotate(a: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by quarter turns."""
    return np.rot90(a, -(degrees // 90) % 4).copy()


def flip(a: np.ndarray, horizontal: bool = False, vertical: bool = False) -> np.ndarray:
    return a[:: -1 if vertical else 1, :: -1 if horizontal else 1].copy()


def crop(a: np.ndarray, left: float, top: float, right: float, bottom: float) -> np.ndarray:
    h, w = a.shape[:2]
    x0, y0 = max(0, int(left * w)), max(0, int(top * h))
    return a[y0 : max(y0 + 1, min(h, int(bottom * h))), x0 : max(x0 + 1, min(w, int(right * w)))].copy()


def apply_edits(a: np.ndarray, edits: dict) -> np.ndarray:
    """All edits of a photo, in the fixed order."""
    steps = {
        "rotation": lambda v: rotate(a, v), "flip_h": lambda v: flip(a, horizontal=v), "flip_v": lambda v: flip(a, vertical=v), "crop": lambda v: crop(a, *v), "bw": lambda v: black_and_white(a),
        "brightness": lambda v: brightness(a, v), "contrast": lambda v: contrast(a, v), "saturation": lambda v: saturation(a, v), "channels": lambda v: channels(a, *v), "gamma": lambda v: gamma(a, v),
        "sharpness": lambda v: sharpness(a, v), "noise": lambda v: noise_reduction(a, v), "red_eye": lambda v: red_eye(a, v), "vignette": lambda v: vignette(a, v),
    }
    for name in ORDER:
        if edits.get(name) not in (None, False):
            a = steps[name](edits[name])
    return a


def usable_height(grey: np.ndarray, least: float = 1.0) -> int:
    """Rows down to the last one that is not flat."""
    live = np.flatnonzero(grey.std(axis=1) > least)
    return int(live[-1]) + 1 if len(live) else 0


def moved_box(box: tuple[float, float, float, float], size: tuple[int, int], rotation: int = 0, flip_h: bool = False, flip_v: bool = False, crop_to: tuple | None = None) -> tuple | None:
    """A box (x, y, w, h) after quarter turns, flips and a crop in fractions; None if less than 2 pixels are left."""
    x, y, w, h = box
    width, height = size
    for _ in range(rotation // 90 % 4):
        x, y, w, h, width, height = height - y - h, x, h, w, height, width
    if flip_h:
        x = width - x - w
    if flip_v:
        y = height - y - h
    if crop_to:
        l, t, r, b = crop_to[0] * width, crop_to[1] * height, crop_to[2] * width, crop_to[3] * height
        x0, y0, x1, y1 = max(x, l), max(y, t), min(x + w, r), min(y + h, b)
        x, y, w, h = x0 - l, y0 - t, x1 - x0, y1 - y0
    return None if w < 2 or h < 2 else (x, y, w, h)


def curve_table(points: list[tuple[float, float]]) -> np.ndarray:
    """256 levels of a monotone cubic curve through points."""
    p = sorted(dict(points).items())
    x, y = np.array([a for a, _ in p], float), np.array([b for _, b in p], float)
    if len(x) < 2:
        return np.arange(256, dtype=np.uint8)
    step, slope = np.diff(x), np.diff(y) / np.diff(x)
    m = np.r_[slope[0], np.where(slope[:-1] * slope[1:] > 0, 2 * slope[:-1] * slope[1:] / np.where(slope[:-1] + slope[1:] == 0, 1, slope[:-1] + slope[1:]), 0), slope[-1]]
    at = np.arange(256, dtype=float)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(step) - 1)
    t = np.clip((at - x[k]) / step[k], 0, 1)
    value = (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * step[k] * m[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * step[k] * m[k + 1]
    return _bytes(value)
