"""Sinks: manifests, append-only result logs, metric logs with footers, split layouts, curves."""

from __future__ import annotations

import datetime
import io
import json

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_files

RESULTS = "signature string, stage int, order string, speckle string, n_images int, psnr double, cc double, epi double, enl double, speckle_index double, composite double, fid double, timestamp string"


def write_manifest(manifest: DataFrame, path: str) -> str:
    """The manifest as CSV, and where it is: a path that can't be written gives way to one with a time stamp.

    The commit is atomic, so readers see a whole run or none.
    """
    try:
        manifest.write.mode("overwrite").option("header", True).csv(path)
    except Exception:  # locked or not ours: the run's record must not be lost
        path = f"{path.removesuffix('.csv')}_{datetime.datetime.now():%Y%m%d_%H%M%S}.csv"
        manifest.write.option("header", True).csv(path)
    return path


def append_results(rows: DataFrame, path: str) -> None:
    """Rows added to an append-only log of declared columns; missing ones are empty."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], RESULTS)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema]
    rows.select(*cols).write.mode("append").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results log, typed; nothing yet is an empty table."""
    try:
        return spark.read.schema(RESULTS).option("header", True).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], RESULTS)


def with_footers(metrics: DataFrame, key: str = "image") -> DataFrame:
    """Per-image metrics with an __AVG__ and an __STD__ row."""
    names = [c for c in metrics.columns if c != key]
    keyed = metrics.withColumn(key, F.col(key).cast("string"))
    foot = [metrics.agg(*[f(c).alias(c) for c in names]).select(F.lit(n).alias(key), *names) for n, f in (("__AVG__", F.avg), ("__STD__", F.stddev_pop))]
    return keyed.unionByName(foot[0]).unionByName(foot[1])


def write_split(rows: DataFrame, path: str) -> None:
    """Rows with split and domain as a folder for each of both."""
    rows.write.mode("overwrite").partitionBy("split", "domain").parquet(path)


def save_curve(curve: DataFrame, path: str) -> None:
    curve.select("bin", "x", "cdf").coalesce(1).write.mode("overwrite").parquet(path)


def load_curve(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """(x, cdf) of a saved curve in order; its size is the number of bins."""
    return [(r["x"], r["cdf"]) for r in spark.read.parquet(path).orderBy("bin").collect()]


def best_as_json(best: DataFrame) -> DataFrame:
    return best.select(F.to_json(F.struct("*")).alias("json"))


def _content(spark: SparkSession, path: str | None) -> bytes | None:
    """A file's bytes by Spark's readers; None if there is no such file."""
    if not path:
        return None
    try:
        row = spark.read.format("binaryFile").load(path).select("content").first()
    except AnalysisException:
        return None
    return bytes(row["content"]) if row else None


def save_json(spark: SparkSession, value: dict, path: str) -> str:
    """A configuration or a best result as a JSON file."""
    folder, _, name = path.rpartition("/")
    write_files(spark.createDataFrame([(name, bytearray(json.dumps(value, indent=2, default=str).encode()))], "name string, content binary"), folder or ".")
    return path


def load_json(spark: SparkSession, path: str | None) -> dict | None:
    """What save_json wrote; None if it is not there or no JSON."""
    try:
        return json.loads(_content(spark, path) or b"")
    except ValueError:
        return None


def save_npy_curve(spark: SparkSession, x, cdf, path: str) -> str:
    """A curve as an .npy file of two rows."""
    held = io.BytesIO()
    np.save(held, np.stack([x, cdf]))
    folder, _, name = path.rpartition("/")
    write_files(spark.createDataFrame([(name, bytearray(held.getvalue()))], "name string, content binary"), folder or ".")
    return path


def load_npy_curve(spark: SparkSession, path: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(x, cdf) of an .npy file of two rows, or of one over 0..1; None if it is not there, bad or empty."""
    data = _content(spark, path)
    try:
        found = np.asarray(np.load(io.BytesIO(data or b"")), np.float64)
    except (ValueError, EOFError, OSError):
        return None
    if found.ndim == 2 and len(found) >= 2:
        return found[0], found[1]
    return (np.linspace(0, 1, found.size), found.ravel()) if found.size else None


def options_text(options: dict, defaults: dict) -> str:
    """Options by name, one a line, with the default behind those that differ from it."""
    lines = ["----------------- Options ---------------"]
    for name in sorted(options):
        mark = "" if options[name] == defaults.get(name) else f"\t[default: {defaults.get(name)}]"
        lines.append(f"{name:>25}: {options[name]!s:<30}{mark}")
    return "\n".join([*lines, "----------------- End -------------------"])


def eval_folder(results: str, name: str) -> str:
    """Where the evaluation logs of a run are kept."""
    return f"{results.rstrip('/')}/{name}/eval_logs"
