"""Training transforms as one operator: a spec names the steps (by substring, as trainers write them), a run maps images.

Places, flips and zooms are drawn from hashes of the image's id, the same in any run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Rows, schema_of, views

OUT = "img long, h int, w int, channels int, data array<double>"


def drawn(img: int, name: str) -> float:
    """A number in 0..1 made of the id."""
    return int(hashlib.md5(f"{img}:{name}".encode()).hexdigest()[:7], 16) / 268435456.0


def _cubic(t: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel with a = -1/2."""
    t = np.abs(t)
    return np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0))


def _weights(n: int, m: int) -> np.ndarray:
    """m x n weights of a cubic filter that widens when it shrinks."""
    scale = max(n / m, 1.0)
    centre = (np.arange(m) + 0.5) * n / m
    weight = _cubic(((np.arange(n) + 0.5)[None, :] - centre[:, None]) / scale)
    return weight / weight.sum(1, keepdims=True)


def resampled(x: np.ndarray, w: int, h: int) -> np.ndarray:
    """x (h x w x channels) at another size, within the range of its type (0..255)."""
    if x.shape[:2] == (h, w):
        return x
    return np.clip(np.einsum("ai,ijc,bj->abc", _weights(x.shape[0], h), x, _weights(x.shape[1], w)), 0, 255)


@dataclass(frozen=True)
class Options:
    """What trainers set: the spec, sizes, and whether images are gray and are mirrored."""

    preprocess: str = "resize_and_crop"
    load_size: int = 286
    crop_size: int = 256
    fixed: tuple[int, int] | None = None  # (w, h) of fixsize
    gray: bool = False
    flip: bool = True
    convert: bool = True


def _rounded(v: float) -> int:
    return int(np.round(v))  # half to even


def steps(o: Options) -> list[tuple[str, Callable[[np.ndarray, int], np.ndarray]]]:
    """The steps of a spec in their order, each (image of 0..255, id) -> image."""

    def scaled_width(x, img):
        h, w = x.shape[:2]
        return x if w == o.load_size and h >= o.crop_size else resampled(x, o.load_size, int(max(o.load_size * h / w, o.crop_size)))

    def scaled_short(x, img):
        h, w = x.shape[:2]
        s = o.load_size / min(w, h)
        return x if s <= 1 else resampled(x, _rounded(w * s), _rounded(h * s))

    def zoomed(x, img):
        h, w = x.shape[:2]
        return resampled(x, _rounded(max(o.crop_size, w * (0.8 + 0.2 * drawn(img, "zw")))), _rounded(max(o.crop_size, h * (0.8 + 0.2 * drawn(img, "zh")))))

    def place(room: int, img: int, name: str) -> int:
        return int(drawn(img, name) * (max(0, room) + 1))

    def cropped(x, img):
        (h, w), s = x.shape[:2], o.crop_size
        if w <= s and h <= s:
            return x
        y, k = place(h - s, img, "y"), place(w - s, img, "x")
        return x[y : y + s, k : k + s]

    def patched(x, img):
        (h, w), s = x.shape[:2], o.crop_size
        across, down = w // s, h // s
        if not across or not down:
            raise ValueError("the image is smaller than a patch")
        k = int(drawn(img, "patch") * across * down)
        y, x0 = place(h - down * s, img, "py") + k % down * s, place(w - across * s, img, "px") + k // down * s
        return x[y : y + s, x0 : x0 + s]

    def trimmed(x, img):
        (h, w), s = x.shape[:2], o.crop_size
        y, k = (int(drawn(img, n) * (size - s)) if size > s else 0 for n, size in (("ty", h), ("tx", w)))
        return x[y : y + s, k : k + s]

    def by_four(x, img):
        h, w = x.shape[:2]
        return resampled(x, _rounded(w / 4) * 4, _rounded(h / 4) * 4)

    gray = ("gray", lambda x, img: (x[..., :3] @ [0.299, 0.587, 0.114])[..., None] if x.shape[2] >= 3 else x)
    sizes = [("resize", lambda x, img: resampled(x, o.load_size, o.load_size)), ("scale_width", scaled_width), ("scale_shortside", scaled_short)]
    out = [gray] if o.gray else []
    if "fixsize" in o.preprocess and o.fixed:
        out.append(("fixsize", lambda x, img: resampled(x, *o.fixed)))
    out += [s for s in sizes if s[0] in o.preprocess][:1]
    out += [(n, fn) for n, fn in (("zoom", zoomed), ("crop", cropped), ("patch", patched), ("trim", trimmed)) if n in o.preprocess]
    out.append(("multiple_of_4", by_four))
    if o.flip:
        out.append(("flip", lambda x, img: x[:, ::-1] if drawn(img, "f") > 0.5 else x))
    if o.convert:
        out.append(("normalise", lambda x, img: (x / 255 - 0.5) / 0.5))
    return out


def apply(images: DataFrame, options: Options) -> DataFrame:
    """images (img, h, w, channels, data of 0..255) through the steps, one pass and no shuffle."""
    chain, schema = steps(options), schema_of(OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for img, h, w, c, data in zip(*(batch.column(k).to_pylist() for k in range(4)), views(batch.column(4)), strict=True):
                x = data.reshape(h, w, c)
                for _, fn in chain:
                    x = fn(x, img)
                yield from out.add({"img": img, "h": x.shape[0], "w": x.shape[1], "channels": x.shape[2], "data": np.ascontiguousarray(x).ravel()})
        yield from out.rest()

    return images.select("img", F.col("h").cast("int"), F.col("w").cast("int"), F.col("channels").cast("int"), F.col("data").cast("array<double>")).mapInArrow(run, OUT)
