"""Pipelines over folders of images: processed files, previews, manifest and resolved configuration; exports and overlays."""

from __future__ import annotations

import copy
import html
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.curation_queries import numbered_within
from ..scratch import Scratch
from ..sources import sinks
from ..sources.files import write_files
from ..sources.images import encode_png, read_images
from . import kernels, pipeline, regions
from .batches import mapped, views

MANIFEST = "input_path output_path status error orig_h orig_w out_h out_w steps p01 p50 p99 p998 zero_ratio elapsed_sec".split()


def default_config() -> dict:
    """Folders and limits (max_items 0: all; a few previews) and the default steps."""
    return {"io": {"input_dir": None, "output_dir": None, "max_items": 0, "recursive": True, "previews": 6}, "pipeline": {"steps": pipeline.default_spec()}}


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def as_files(rows: DataFrame) -> DataFrame:
    """(name, content): a PNG of each row (name, h, w, channels, data of 0..255)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, h, w, c, data in zip(*(batch.column(k).to_pylist() for k in range(4)), views(batch.column(4)), strict=True):
                x = np.clip(data.reshape(h, w, c), 0, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([encode_png(x[..., 0] if c == 1 else x)], pa.binary())], names=["name", "content"])

    return rows.select("name", F.col("h").cast("int"), F.col("w").cast("int"), F.col("channels").cast("int"), "data").mapInArrow(run, "name string, content binary")


def reference_curve(spark: SparkSession, folder: str, bins: int = 1024) -> tuple[np.ndarray, np.ndarray] | None:
    """(x, cumulative histogram) over all images of a folder: an image sends ``bins`` counts, which are summed; None without images."""
    images = read_images(spark, folder).where("data is not null").withColumnRenamed("img", "id")

    def count(x: np.ndarray) -> dict:
        found = np.histogram(kernels.gray01(x), bins, (0.0, 1.0))[0]
        return {"c": found.astype(float)}

    parts = mapped(images, "id", ("data",), count, "id long, c array<double>").select(F.posexplode("c").alias("bin", "c"))
    counts = np.zeros(bins)
    for r in parts.groupBy("bin").agg(F.sum("c").alias("c")).collect():  # bins rows
        counts[r["bin"]] = r["c"]
    return (np.linspace(0, 1, bins), np.cumsum(counts) / counts.sum()) if counts.sum() else None


def _target(spark: SparkSession, steps: list[dict]) -> tuple[tuple | None, list[str]]:
    """The curve that histogram mapping aims at, and warnings where there is none."""
    for s in pipeline.built(steps):
        mode = s.get("params", {}).get("mode")
        if s["name"] == "histogram_mapping" and mode in ("unpaired_optical_reference", "preset"):
            params, found = s["params"], None
            try:
                if mode == "preset":
                    found = sinks.load_npy_curve(spark, params.get("reference_cdf_path"))
                elif params.get("optical_reference_dir"):
                    found = reference_curve(spark, params["optical_reference_dir"], int(params.get("bins", 1024)))
            except PySparkException:  # a folder that is not there
                found = None
            return found, [] if found else ["no reference curve: the built-in one is used"]
    return None, []


def run_folder(spark: SparkSession, config: dict) -> DataFrame:
    """Runs the steps over a folder's images; returns the manifest.

    Below output_dir: images/<stem>.png (stems that occur twice get the image's number),
    preview/<stem>_ba.png of the first successes, manifest.csv and the resolved configuration.
    An image that can't be read, fails or is skipped is a row of the manifest.
    """
    place, steps = config["io"], config["pipeline"]["steps"]
    out = place["output_dir"].rstrip("/")
    images = read_images(spark, place["input_dir"], place.get("recursive", True))
    if place.get("max_items"):
        images = images.orderBy("path").limit(int(place["max_items"]))
    target, warnings = _target(spark, steps)
    scratch = Scratch(spark)
    images = scratch.save(images, "images")
    done = scratch.save(pipeline.run(images, steps, target), "results")
    seen = images.select("img", "path", F.col("error").alias("unread"), stem(F.col("path")).alias("stem"))
    twice = seen.groupBy("stem").agg(F.count("*").alias("n"))
    seen = seen.join(twice, "stem").withColumn("stem", F.when(F.col("n") > 1, F.concat_ws("_", "stem", F.col("img").cast("string"))).otherwise(F.col("stem")))
    rows = seen.drop("n").join(done, "img")
    good = rows.where("status = 'success'")
    write_files(as_files(good.select(F.concat(F.lit("images/"), "stem", F.lit(".png")).alias("name"), F.col("out_h").alias("h"), F.col("out_w").alias("w"), "channels", "data")), out)
    if place.get("previews", 6):  # a few
        some = good.orderBy("path").limit(int(place.get("previews", 6))).select("img", "stem", "out_h", "out_w", "channels", F.col("data").alias("after"))
        write_files(previews(some.join(images.select("img", "h", "w", "data"), "img")), out)
    shown = F.when(F.col("status") == "success", F.concat(F.lit(f"{out}/images/"), "stem", F.lit(".png")))
    rows = rows.withColumn("error", F.coalesce("unread", "error")).withColumn("input_path", F.col("path")).withColumn("output_path", shown)
    found = scratch.save(rows.select(*MANIFEST), "manifest")
    sinks.write_manifest(found, f"{out}/manifest.csv")
    write_files(spark.createDataFrame([("pipeline_config.resolved.json", bytearray(json.dumps({**config, "warnings": warnings}, indent=2, default=str).encode()))], "name string, content binary"), out)
    scratch.drop("images", "results")
    return found


def previews(rows: DataFrame) -> DataFrame:
    """(name, content): before and after side by side of rows (stem, h, w, data, out_h, out_w, channels, after)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = [batch.column(k).to_pylist() for k in range(6)]
            for name, h, w, oh, ow, c, data, after in zip(*fixed, views(batch.column(6)), views(batch.column(7)), strict=True):
                before = np.floor(np.clip(np.nan_to_num(kernels.resized(kernels.gray01(data.reshape(h, w)), oh, oh)), 0, 1) * 255)
                x = after.reshape(oh, ow, c)
                pair = np.concatenate([np.stack([before] * 3, -1), x if c == 3 else np.repeat(x[..., :1], 3, -1)], 1)
                yield pa.RecordBatch.from_arrays([pa.array([f"preview/{name}_ba.png"]), pa.array([encode_png(pair.astype(np.uint8))], pa.binary())], names=["name", "content"])

    cols = ["stem", "h", "w", "out_h", "out_w", "channels", "data", "after"]
    return rows.select(*cols).mapInArrow(run, "name string, content binary")


def export_layout(files_a: DataFrame, folder: str, files_b: DataFrame | None = None, ratio: float = 0.1, mode: str = "link", seed: str = "42") -> DataFrame:
    """Links or copies of files (path) as trainA, testA and, with a second set, trainB, testB; returns folder and n, targets that were there counted.

    Each set's first floor(n * ratio) files in hash order are its test split; a file's number is its place in its split.
    """
    rows = files_a.select(F.lit("A").alias("domain"), "path")
    if files_b is not None:
        rows = rows.unionByName(files_b.select(F.lit("B").alias("domain"), "path"))
    rows = numbered_within(rows.withColumn("key", F.md5(F.concat_ws(":", "path", F.lit(seed)))), ("domain",), "key", "path")
    sizes = rows.groupBy("domain").agg(F.floor(F.count("*") * ratio).alias("k"))
    rows = rows.join(sizes, "domain").withColumn("split", F.when(F.col("pos") < F.col("k"), "test").otherwise("train"))
    at = F.when(F.col("split") == "test", F.col("pos")).otherwise(F.col("pos") - F.col("k"))
    rows = rows.withColumn("folder", F.concat("split", "domain"))
    name = F.concat_ws("/", "folder", F.concat_ws("_", F.lpad(at.cast("string"), 6, "0"), F.substring_index("path", "/", -1)))
    write_files(rows.select(name.alias("name"), F.col("path").alias("source")), folder, mode)
    return rows.groupBy("folder").agg(F.count("*").alias("n"))


def rectify_folder(spark: SparkSession, folder: str, out: str, **limits) -> DataFrame:
    """Bright regions of a folder's images: rectangles.csv and an overlay PNG of each image; returns the rectangles."""
    scratch = Scratch(spark)
    images = scratch.save(read_images(spark, folder, recursive=False).where("data is not null"), "images")

    def drawn(x: np.ndarray) -> dict:
        unit = kernels.gray01(x)
        return {"h": x.shape[0], "w": x.shape[1], "channels": 3, "data": regions.overlay(unit, regions.regions_of(regions.levels(unit), **limits))}

    layers = mapped(images.withColumnRenamed("img", "id"), "id", ("data",), drawn, "id long, h int, w int, channels int, data array<double>")
    names = images.select("img", F.substring_index("path", "/", -1).alias("image"))
    write_files(as_files(layers.join(names, F.col("id") == F.col("img")).withColumn("name", F.concat(stem(F.col("image")), F.lit(".png")))), out)
    scaled = mapped(images.withColumnRenamed("img", "id"), "id", ("data",), lambda x: {"h": x.shape[0], "w": x.shape[1], "data": kernels.gray01(x)}, "id long, h int, w int, data array<double>")
    found = regions.find(scaled.withColumnRenamed("id", "img"), **limits).join(names, "img")
    found = scratch.save(found.select("image", "cx", "cy", "width", "height", "angle_deg", "rectangularity"), "rectangles")
    sinks.write_manifest(found, f"{out.rstrip('/')}/rectangles.csv")
    scratch.drop("images")
    return found


def gallery(spark: SparkSession, folder: str, title: str, sections: list[tuple[str, list[tuple[str, str]]]], width: int = 400, refresh: int = 0) -> None:
    """index.html of a folder: per section a heading and a row of images (file below images/, caption), each a link to itself."""
    parts = [f'<meta http-equiv="refresh" content="{refresh}">'] if refresh else []
    parts = [f"<!DOCTYPE html>\n<html><head><title>{html.escape(title)}</title>{''.join(parts)}</head><body>"]
    for head, shown in sections:
        cells = [f'<td style="word-wrap: break-word;" valign="top"><a href="images/{html.escape(f, True)}"><img style="width:{width}px" src="images/{html.escape(f, True)}"></a><p>{html.escape(text)}</p></td>' for f, text in shown]
        parts.append(f'<h3>{html.escape(head)}</h3><table border="1" style="table-layout: fixed;"><tr>{"".join(cells)}</tr></table>')
    page = "\n".join([*parts, "</body></html>"])
    write_files(spark.createDataFrame([("index.html", bytearray(page.encode()))], "name string, content binary"), folder)


def save_images(rows: DataFrame, folder: str) -> None:
    """Rows (label, stem, h, w, channels, data of 0..255) as <label>/<stem>.png."""
    write_files(as_files(rows.withColumn("name", F.concat("label", F.lit("/"), "stem", F.lit(".png")))), folder)


def overridden(config: dict, input_dir=None, output_dir=None, max_items=None, speckle_method=None, histogram_mode=None, optical_reference_dir=None, image_size=None) -> dict:
    """config with what a command line sets."""
    out = copy.deepcopy(config)
    out["io"] |= {k: v for k, v in (("input_dir", input_dir), ("output_dir", output_dir), ("max_items", max_items)) if v is not None}
    changes = {"speckle_filter": {"method": speckle_method}, "histogram_mapping": {"mode": histogram_mode, "optical_reference_dir": optical_reference_dir}, "resize_or_tile": {"image_size": image_size}}
    for name, params in changes.items():
        out["pipeline"]["steps"] = pipeline.with_params(out["pipeline"]["steps"], name, **{k: v for k, v in params.items() if v is not None})
    return out


def summary(manifest: DataFrame) -> str:
    n = {r["status"]: r["n"] for r in manifest.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return f"success {n.get('success', 0)}, skipped {n.get('skipped', 0)}, failed {n.get('failed', 0)}"
