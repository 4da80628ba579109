"""Bright regions of images: threshold, connected parts, smallest rectangles, polygons."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import schema_of, views

REGION = "img long, region int, cx double, cy double, width double, height double, angle_deg double, area long, rectangularity double, polygon array<array<double>>"


def otsu(u: np.ndarray) -> int:
    """The level that separates the histogram of 0..255 best, the lowest among equals; pixels above it are bright."""
    c = np.bincount(u.ravel().astype(int), minlength=256).astype(float)
    low, mass = np.cumsum(c), np.cumsum(c * np.arange(256))
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = mass / low - (mass[-1] - mass) / high
        spread = np.nan_to_num(low * high * gap * gap)
    return int(spread.round(3).argmax())


def labelled(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the 8-connected parts of a mask, by repeated spreading of the smallest number."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        p = np.pad(np.where(mask, label, big), 1, constant_values=big)
        h, w = mask.shape
        least = np.min([p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], 0)
        new = np.where(mask, least, 0)
        flat = np.append(0, new.ravel())
        new = np.where(mask, flat[new], 0)  # jump to the number of the pixel that gave it
        if (new == label).all():
            break
        label = new
    return np.unique(label, return_inverse=True)[1].reshape(mask.shape) + (0 if (label == 0).any() else 1)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    pts = sorted(map(tuple, points.tolist()))
    if len(pts) < 3:
        return np.array(pts, float)

    def side(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(side(pts) + side(pts[::-1]), float)


def smallest_rectangle(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """(cx, cy, width, height, angle) of the rectangle of least area; one of its sides lies on a hull edge."""
    ring = hull(points)
    best = None
    for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        turn = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        p = ring @ turn.T
        low, high = p.min(0), p.max(0)
        size = high - low
        if best is None or size.prod() < best[0] - 1e-12:
            centre = (low + high) / 2 @ turn
            best = (size.prod(), centre[0], centre[1], size[0], size[1], math.degrees(t) % 180)
    return best[1:]


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring without points that are nearer than tolerance to the line between those that stay."""

    def open_line(p: np.ndarray) -> list:
        if len(p) < 3:
            return p[:-1].tolist()
        a, b = p[0], p[-1]
        length = max(np.hypot(*(b - a)), 1e-12)
        off = np.abs((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])) / length
        k = int(off.argmax())
        return [a.tolist()] if off[k] <= tolerance else open_line(p[: k + 1]) + open_line(p[k:])

    if len(ring) < 4:
        return ring
    far = int(((ring - ring[0]) ** 2).sum(1).argmax())
    return np.array(open_line(ring[: far + 1]) + open_line(np.vstack([ring[far:], ring[:1]])))


def regions_of(u: np.ndarray, min_area: int = 16, max_share: float = 0.25, threshold: int | None = None, rectangular: float = 0.85) -> list[dict]:
    """Regions of an image of 0..255 between both areas that fill their rectangle well enough."""
    parts, out = labelled(u > (otsu(u) if threshold is None else threshold)), []
    for k in range(1, parts.max(initial=0) + 1):
        ys, xs = np.nonzero(parts == k)
        if not min_area <= len(ys) <= max_share * u.size:
            continue
        corners = np.unique(np.concatenate([np.stack([xs + dx, ys + dy], 1) for dx in (0, 1) for dy in (0, 1)]), axis=0)
        cx, cy, w, h, angle = smallest_rectangle(corners)
        share = min(1.0, len(ys) / max(w * h, 1e-6))
        if share >= rectangular:
            ring = hull(corners)
            around = np.hypot(*(ring - np.roll(ring, -1, 0)).T).sum()
            out.append({"region": len(out), "cx": round(cx, 1), "cy": round(cy, 1), "width": round(w, 1), "height": round(h, 1), "angle_deg": round(angle, 1), "area": len(ys), "rectangularity": round(share, 3), "polygon": simplified(ring, 0.02 * around).tolist()})
    return out


def find(images: DataFrame, **limits) -> DataFrame:
    """Regions of each image (img, h, w, data in 0..1): an image gives as many rows as it has regions."""
    schema = schema_of(REGION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for img, h, w, data in zip(*(batch.column(k).to_pylist() for k in range(3)), views(batch.column(3)), strict=True):
                if data is not None and h and w and data.size == h * w:
                    rows += [{"img": img, **r} for r in regions_of(levels(data.reshape(h, w)), **limits)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return images.select(F.col("img").cast("long"), F.col("h").cast("int"), F.col("w").cast("int"), F.col("data").cast("array<double>")).mapInArrow(run, REGION)


def levels(x: np.ndarray) -> np.ndarray:
    """0..1 as whole numbers 0..255."""
    return np.floor(np.clip(np.nan_to_num(x), 0, 1) * 255)


def overlay(x: np.ndarray, found: list[dict]) -> np.ndarray:
    """An RGB image (0..255) with the rectangle of each region in green and its polygon in red."""
    out = np.stack([levels(x)] * 3, -1)
    h, w = x.shape
    for r in found:
        t = math.radians(r["angle_deg"])
        axis = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        half = np.array([r["width"], r["height"]]) / 2
        box = np.array([r["cx"], r["cy"]]) + (np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * half) @ axis
        for ring, colour in ((box, (0, 255, 0)), (np.array(r["polygon"], float), (255, 0, 0))):
            for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
                line = a + (b - a) * np.linspace(0, 1, 2 * int(np.abs(b - a).max()) + 2)[:, None]
                xs, ys = np.clip(line.astype(int), 0, [w - 1, h - 1]).T
                out[ys, xs] = colour
    return out
