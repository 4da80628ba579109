"""Command line of a preprocessing run: python -m tessella.preprocess --input_dir ... --output_dir ..."""

from __future__ import annotations

import argparse
import json
import os

from .operators import folder, pipeline


def main(args: list[str] | None = None, spark=None) -> str:
    ap = argparse.ArgumentParser(description="Runs the steps of a configuration over a folder of images")
    ap.add_argument("--config", help="JSON configuration; else the default one")
    for name in ("input_dir", "output_dir", "optical_reference_dir"):
        ap.add_argument(f"--{name}")
    for name in ("max_items", "image_size"):
        ap.add_argument(f"--{name}", type=int)
    ap.add_argument("--speckle_method", choices=pipeline.SPECKLE_METHODS)
    ap.add_argument("--histogram_mode", choices=pipeline.HISTOGRAM_MODES)
    given = vars(ap.parse_args(args))
    path = given.pop("config")
    config = folder.default_config()
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    return folder.summary(folder.run_folder(spark, folder.overridden(config, **given)))


if __name__ == "__main__":
    print(main())
