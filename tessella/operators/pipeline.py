"""Ordered raster pipelines: a spec is a list of {name, enabled, params}; a run gives images and a manifest."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .batches import Rows, schema_of, views

#: Names of the speckle filters and of the modes of histogram mapping.
SPECKLE_METHODS = ("lee", "frost", "bm3d", "refined_lee", "gamma_map")
HISTOGRAM_MODES = ("sar_only", "unpaired_optical_reference", "preset")
RESULT = (
    "img long, status string, error string, orig_h int, orig_w int, out_h int, out_w int, channels int, steps string, enl double, warnings array<string>, "
    "p01 double, p50 double, p99 double, p998 double, zero_ratio double, elapsed_sec double, data array<double>"
)


def default_spec(method: str = "refined_lee", size: int = 256) -> list[dict]:
    params = {
        "validate_image": {"drop_empty": True, "handle_nan": "zero"},
        "sar_intensity_transform": {"mode": "log1p", "eps": 1e-6},
        "speckle_filter": {"method": method, "window_size": 7, "enl": "auto"},
        "outlier_clipping": {"min_percentile": 0.2, "max_percentile": 99.8, "ignore_zero": True},
        "histogram_mapping": {"mode": "sar_only", "bins": 1024},
        "resize_or_tile": {"mode": "resize", "image_size": size},
        "channel_adapter": {"output_channels": 3},
        "normalize_for_cut": {"output_range": "uint8"},
    }
    return [{"name": n, "enabled": True, "params": p} for n, p in params.items()]


def built(spec: list[dict]) -> list[dict]:
    """The steps that run: enabled and known."""
    return [s for s in spec if s.get("enabled", True) and s.get("name") in kernels.STEPS]


def moved(spec: list[dict], at: int, by: int) -> list[dict]:
    """spec with step ``at`` moved by ``by`` places, as far as there are places."""
    out = list(spec)
    if 0 <= at < len(out):
        step = out.pop(at)
        out.insert(max(0, min(len(out), at + by)), step)
    return out


def without(spec: list[dict], at: int) -> list[dict]:
    return [s for i, s in enumerate(spec) if i != at]


def with_params(spec: list[dict], name: str, **params) -> list[dict]:
    """spec with parameters of the steps of that name overlaid."""
    return [{**s, "params": {**s.get("params", {}), **params}} if s["name"] == name else s for s in spec]


def speckle_params(method: str, window: int = 7, enl: float | None = None, damping: float = 2.0) -> dict:
    out: dict = {"method": method}
    if method in ("lee", "frost", "refined_lee", "gamma_map"):
        out |= {"window_size": int(window), "enl": "auto" if enl is None else float(enl)}
    if method == "frost":
        out["damping_factor"] = float(damping)
    if method == "bm3d":
        out["bm3d_sigma"] = "auto"
    return out


def process(x: np.ndarray, steps: list[dict], target=None) -> tuple[np.ndarray | None, dict]:
    """One image through all steps; errors and skips end it and are recorded."""
    ctx: dict = {"status": "success", "error": None, "warnings": [], "enl": None, "target": target}
    try:
        for s in steps:
            x = kernels.STEPS[s["name"]](x, s.get("params", {}), ctx)
            if ctx["status"] == "skipped":
                return None, ctx
    except Exception as e:  # an image that fails is a row of the manifest, not the end of the run
        ctx["status"], ctx["error"] = "failed", f"{type(e).__name__}: {e}".splitlines()[-1]
        return None, ctx
    return x, ctx


def run(images: DataFrame, spec: list[dict], target: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """images (img, h, w, data) through the steps, one pass and no shuffle; target is a bounded (x, cdf) curve.

    A worker holds the Arrow batch it reads and results of about PIXELS numbers.
    """
    steps = json.loads(json.dumps(built(spec)))
    names, schema = "|".join(s["name"] for s in steps), schema_of(RESULT)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for img, h, w, data in zip(*(batch.column(k).to_pylist() for k in range(3)), views(batch.column(3)), strict=True):
                began = time.perf_counter()
                broken = data is None or not h or not w or data.size != h * w
                x, ctx = (None, {"status": "failed", "error": "image can't be decoded", "warnings": [], "enl": None}) if broken else process(data.reshape(h, w), steps, target)
                row = {"img": img, "status": ctx["status"], "error": ctx["error"], "orig_h": h, "orig_w": w, "steps": names, "enl": ctx["enl"], "warnings": ctx["warnings"]}
                if x is not None:
                    unit = x / 255 if x.size and x.max() > 1 else x
                    p = np.round(np.percentile(unit, [1, 50, 99, 99.8]), 3)
                    row |= {"out_h": x.shape[0], "out_w": x.shape[1], "channels": 1 if x.ndim == 2 else x.shape[2], "zero_ratio": round(float((unit <= 1e-4).mean()), 4), "data": x.ravel()}
                    row |= dict(zip(("p01", "p50", "p99", "p998"), p.tolist(), strict=True))
                yield from out.add(row | {"elapsed_sec": round(time.perf_counter() - began, 3)})
        yield from out.rest()

    return images.select(F.col("img").cast("long"), F.col("h").cast("int"), F.col("w").cast("int"), F.col("data").cast("array<double>")).mapInArrow(go, RESULT)


def manifest(results: DataFrame) -> DataFrame:
    """The rows of a run without the images and the time they took."""
    return results.drop("data", "warnings", "elapsed_sec")
