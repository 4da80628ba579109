"""Kernels against expressions, pipelines, image files, sinks, streams and the driver contract."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import raster as R
from tessella.operators import kernels, pipeline
from tessella.plans import distance_queries, search_queries, transform_queries
from tessella.sources import images, sinks
from tessella.streaming.progress import ReplayBuffer, stalls



@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(0)
    rows = [(i, h, w, rng.gamma(1, 1, h * w).tolist()) for i, (h, w) in enumerate([(9, 9), (8, 12), (20, 10)])]
    return spark.createDataFrame(rows, "img long, h int, w int, data array<double>").cache()


CASES = {
    "box": (lambda: R.box_mean(R.gray01(F.col("data")), F.col("h"), F.col("w"), 5), lambda x: kernels.box(x, 5)),
    "box_zero": (lambda: R.box_mean(R.gray01(F.col("data")), F.col("h"), F.col("w"), 3, "zero"), lambda x: kernels.box(x, 3, "zero")),
    "lee": (lambda: R.lee(R.gray01(F.col("data")), F.col("h"), F.col("w")), lambda x: np.clip(kernels.lee(x, 7, kernels.looks(x)), 0, 1)),
    "refined": (lambda: R.refined_lee(R.gray01(F.col("data")), F.col("h"), F.col("w")), lambda x: np.clip(kernels.refined_lee(x, 7, kernels.looks(x)), 0, 1)),
    "gamma": (lambda: R.gamma_map(R.gray01(F.col("data")), F.col("h"), F.col("w")), lambda x: np.clip(kernels.gamma_map(x, 7, kernels.looks(x)), 0, 1)),
    "frost": (lambda: R.frost(R.gray01(F.col("data")), F.col("h"), F.col("w"), 5), lambda x: np.clip(kernels.frost(x, 5, 2.0), 0, 1)),
    "log": (lambda: R.intensity(R.gray01(F.col("data"))), lambda x: kernels.intensity(x, {}, {})),
    "db": (lambda: R.intensity(R.gray01(F.col("data")), "db"), lambda x: kernels.intensity(x, {"mode": "db"}, {})),
    "clip": (lambda: R.clip_outliers(R.gray01(F.col("data"))), lambda x: kernels.clip_outliers(x, {}, {})),
    "histogram": (lambda: R.map_histogram(R.gray01(F.col("data")), 64, R.tone_curve(64)), lambda x: kernels.map_histogram(x, {"bins": 64}, {})),
    "u8": (lambda: F.transform(R.to_u8(R.gray01(F.col("data"))), lambda v: v.cast("double")), lambda x: np.floor(x * 255)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_expressions_equal_kernels(pictures, name):
    column, kernel = CASES[name]
    for r in pictures.select("img", "h", "w", "data", column().alias("out")).collect():
        x = np.array(r["data"]).reshape(r["h"], r["w"])
        np.testing.assert_allclose(np.array(r["out"]), kernel(x / max(x.max(), 1)).ravel(), atol=1e-9)


def test_metrics_by_definition(pictures, spark):
    row = pictures.select(*[f(R.gray01(F.col("data")), F.reverse(R.gray01(F.col("data")))).alias(n) for n, f in (("psnr", R.psnr), ("cc", R.correlation))], R.ssim(R.gray01(F.col("data")), R.gray01(F.col("data")), F.col("h"), F.col("w")).alias("ssim"), R.entropy(R.gray01(F.col("data"))).alias("entropy"), R.gray01(F.col("data")).alias("d")).collect()[0]
    x = np.array(row["d"])
    assert row["psnr"] == pytest.approx(10 * math.log10(1 / ((x - x[::-1]) ** 2).mean()))
    assert row["cc"] == pytest.approx(np.corrcoef(x, x[::-1])[0, 1], abs=1e-6)
    assert row["ssim"] == pytest.approx(1.0, abs=1e-3)
    p = np.histogram(x, 256, (0, 1))[0] / len(x)
    assert row["entropy"] == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum(), abs=1e-6)
    flat = spark.createDataFrame([([0.5] * 4,)], "d array<double>")
    assert flat.select(R.psnr(F.col("d"), F.col("d"))).first()[0] == 100.0
    assert flat.select(R.correlation(F.col("d"), F.col("d"))).first()[0] == 0.0


@pytest.mark.parametrize("step", [(3, 11), (9, 15), (7, 17), None])
def test_metric_summary_prints_as_sql(spark, tmp_path, step):
    """One image whose average is next to a tie (0.39375, 0.60625) or on it (0.40625); no image."""
    import duckdb

    rows = [(0, [float((i * i * step[0] + i) % step[1]) for i in range(64)], 0)] if step else []
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(db.execute(transform_queries.ORACLE["metric_summary"]).fetchall())
    assert sorted(map(tuple, transform_queries.metric_summary(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("value", [5.69835, 0.00015, 5e-05, 0.09375, 12345.67895, -0.49905, float("nan"), None])
def test_summary_lines_print_as_sql(spark, value):
    import duckdb

    kind = "n long, " + ", ".join(f"{k}_{m} double" for m in transform_queries.METRICS for k in "as")
    rows = transform_queries.summary_lines(spark.createDataFrame([(7, *[value, 1.5] * 5, 1.5, value)], kind)).collect()
    numbers = [(value, 1.5)] * 5 + [(1.5, value)]
    want = [duckdb.execute(f"select printf('- {m:<16}: %8.4f +- %.4f', ?::double, ?::double)", p).fetchone()[0] for m, p in zip(transform_queries.METRICS, numbers, strict=True)]
    assert sorted(map(tuple, rows)) == [(0, "metrics of 7 images"), *enumerate(want, 1)]


def test_pipeline_records_every_image(spark):
    rows = [(0, 4, 4, [float(i) for i in range(16)]), (1, 4, 4, [0.5] * 16), (2, 4, 4, [1.0]), (3, None, None, None)]
    df = spark.createDataFrame(rows, "img long, h int, w int, data array<double>")
    spec = pipeline.with_params(pipeline.default_spec("bm3d", 8), "speckle_filter", window_size=3)
    spec = pipeline.with_params(spec, "histogram_mapping", clahe={"enabled": True, "tile_grid_size": [2, 2]})
    out = {r["img"]: r for r in pipeline.run(df, [*spec, {"name": "no such step", "enabled": True}]).collect()}
    assert [out[i]["status"] for i in range(4)] == ["success", "skipped", "failed", "failed"]
    assert (out[0]["out_h"], out[0]["out_w"], out[0]["channels"], len(out[0]["data"])) == (8, 8, 3, 192)
    assert out[0]["warnings"] and "no such step" not in out[0]["steps"] and max(out[0]["data"]) <= 255


def test_block_matching_library_or_fallback(monkeypatch):
    import sys
    import types

    x, ctx = np.random.default_rng(0).random((16, 16)), {"warnings": []}
    assert np.allclose(kernels.block_matched(x, "auto", ctx), kernels.refined_lee(x, 7, kernels.looks(x))) and len(ctx["warnings"]) == 1
    seen = []
    monkeypatch.setitem(sys.modules, "bm3d", types.SimpleNamespace(bm3d=lambda x, sigma_psd: seen.append(sigma_psd) or x * 0))
    assert not kernels.block_matched(x, "auto", ctx).any() and not kernels.block_matched(x, 0.2, ctx).any()
    assert seen == [pytest.approx(float((x - kernels.box(x, 3)).std())), 0.2] and len(ctx["warnings"]) == 1


def test_spec_edits():
    spec = pipeline.default_spec()
    assert [s["name"] for s in pipeline.moved(spec, 2, -1)][1:3] == ["speckle_filter", "sar_intensity_transform"]
    assert len(pipeline.without(spec, 0)) == len(spec) - 1 and pipeline.moved(spec, 99, 1) == spec
    assert pipeline.built([{"name": "speckle_filter", "enabled": False}]) == []
    assert pipeline.speckle_params("frost") == {"method": "frost", "window_size": 7, "enl": "auto", "damping_factor": 2.0}


def test_resize_keeps_flat_and_mean():
    assert np.allclose(kernels.resized(np.full((7, 5), 0.3), 3, 9), 0.3)
    x = np.random.default_rng(1).random((32, 32))
    assert abs(kernels.resized(x, 8, 8).mean() - x.mean()) < 0.02


def png_with_filters(image: np.ndarray) -> bytes:
    """An 8-bit gray PNG that uses every filter type."""
    h, w = image.shape
    lines, before = [], np.zeros(w, int)
    for y in range(h):
        line, kind = image[y].astype(int), y % 5
        left, corner = np.r_[0, line[:-1]], np.r_[0, before[:-1]]
        p = left + before - corner
        paeth = np.select([(abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), abs(p - before) <= abs(p - corner)], [left, before], corner)
        lines.append(bytes([kind]) + bytes(((line - [0 * line, left, before, (left + before) // 2, paeth][kind]) & 255).tolist()))
        before = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_png(spark, tmp_path):
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 256, (11, 7)), rng.integers(0, 65536, (5, 6)), rng.integers(0, 256, (4, 3, 3))):
        assert (images.decode_png(images.encode_png(x)) == x).all()
    gray = rng.integers(0, 256, (10, 9))
    assert (images.decode_png(png_with_filters(gray)) == gray).all()
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(images.encode_png(gray))
    (tmp_path / "sub" / "b.PNG").write_bytes(images.encode_png(gray))
    (tmp_path / ".h.png").write_bytes(b"")
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "n.txt").write_text("x")
    assert sorted(r["name"] for r in images.listed(spark, str(tmp_path)).collect()) == ["a.png", "b.PNG", "bad.png"]
    assert sorted(r["name"] for r in images.listed(spark, str(tmp_path), recursive=False).collect()) == ["a.png", "bad.png"]
    found = {r["path"].rpartition("/")[2]: r for r in images.read_png(spark, str(tmp_path)).collect()}
    assert found["a.png"]["data"] == gray.ravel().tolist() and found["bad.png"]["error"] and found["bad.png"]["data"] is None


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1, 0.5), ("s2", 1, None)], "signature string, stage int, composite double")
    path = str(tmp_path / "log")
    assert sinks.read_results(spark, path).count() == 0
    sinks.append_results(rows, path)
    sinks.append_results(rows.limit(1), path)
    back = sinks.read_results(spark, path)
    assert back.count() == 3 and back.where("composite is null").count() == 1 and back.schema["stage"].dataType.simpleString() == "int"
    foot = {r["image"]: r["m"] for r in sinks.with_footers(spark.createDataFrame([(1, 2.0), (2, 4.0)], "image long, m double")).collect()}
    assert foot == {"1": 2.0, "2": 4.0, "__AVG__": 3.0, "__STD__": 1.0}
    sinks.save_curve(spark.createDataFrame([(1, 1.0, 1.0), (0, 0.0, 0.25)], "bin int, x double, cdf double"), str(tmp_path / "curve"))
    assert sinks.load_curve(spark, str(tmp_path / "curve")) == [(0.0, 0.25), (1.0, 1.0)]


def test_frechet_of_shifted_gaussians():
    eye = np.eye(3)
    assert distance_queries.frechet(np.zeros(3), eye, np.ones(3), eye) == pytest.approx(3.0)
    assert distance_queries.frechet(np.zeros(3), eye, np.zeros(3), 4 * eye) == pytest.approx(3.0)


def test_grid_sizes(spark):
    assert search_queries.candidates(spark).count() == 120
    grid = search_queries.cross(spark, search_queries.SPACE)
    assert grid.count() == 2304 and search_queries.canonical(grid).count() == 1352


def test_successive_halving(spark):
    cands = search_queries.order_candidates(spark, "").select("signature")
    score = lambda s: lambda df: df.withColumn("composite", F.conv(F.substring(F.md5(F.concat("signature", F.lit(s))), 1, 6), 16, 10).cast("double"))
    best = search_queries.successive_halving(cands, score("1"), score("2"), 5).first()
    top = [r["signature"] for r in search_queries.ranked(score("1")(cands)).limit(5).collect()]
    want = max(score("2")(cands).where(F.col("signature").isin(top)).collect(), key=lambda r: r["composite"])
    assert (best["signature"], best["stage"]) == (want["signature"], 2)


def test_replay_buffer():
    pool = ReplayBuffer(4)
    out = [pool.offer(i) for i in range(200)]
    assert out[:4] == [0, 1, 2, 3] and len(pool.items) == 4
    swapped = sum(a != b for a, b in zip(out, range(200), strict=True))
    assert 60 < swapped < 140 and all(a <= b for a, b in zip(out, range(200), strict=True))
    assert [ReplayBuffer(0).offer(i) for i in range(3)] == [0, 1, 2]


def test_watchdog_stream(spark, tmp_path):
    import time

    source = tmp_path / "in"
    source.mkdir()
    lines = spark.createDataFrame([(1, "(epoch: 1, iters: 5, time: 0.1, data: 0.1) G: 1.0"), (2, "only noise")], "run long, line string")
    lines.withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(str(source / "a"))
    stream = spark.readStream.schema("run long, line string, ts timestamp").option("recursiveFileLookup", "true").parquet(str(source))
    query = stalls(stream, 1.0, most=2).writeStream.format("memory").queryName("watch").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for _ in range(40):
            time.sleep(1)
            found = [(r["run"], r["status"]) for r in spark.table("watch").orderBy("restarts").collect()]
            if (1, "error") in found:
                break
        assert found[0] == (1, "running") and (1, "stalled") in found and found[-1] == (1, "error")
        assert all(run == 1 for run, _ in found), "lines without progress start no clock"
    finally:
        query.stop()


def test_driver_contract(spark):
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 100
    assert entry.entry(spark).count() == 2


def test_regions():
    from tessella.operators import regions

    u = np.zeros((60, 80), int)
    u[5:15, 10:40] = 200
    yy, xx = np.mgrid[:60, :80]
    u[(yy - 40) ** 2 + (xx - 20) ** 2 <= 100] = 180  # a disc is no rectangle
    t = np.radians(30)
    a, b = (xx - 60) * np.cos(t) + (yy - 42) * np.sin(t), -(xx - 60) * np.sin(t) + (yy - 42) * np.cos(t)
    u[(abs(a) <= 14) & (abs(b) <= 6)] = 220
    u[0, 79] = 255  # too small
    found = regions.regions_of(u)
    assert len(found) == 2
    assert (found[0]["cx"], found[0]["cy"], found[0]["area"], found[0]["rectangularity"]) == (25.0, 10.0, 300, 1.0)
    assert sorted((found[0]["width"], found[0]["height"])) == [10.0, 30.0]
    assert min(abs(found[1]["angle_deg"] - x) for x in (30, 120)) < 4 and found[1]["rectangularity"] > 0.85
    assert regions.regions_of(np.zeros((9, 9), int)) == []


def test_otsu_and_parts_by_brute_force():
    from tessella.operators import regions

    rng = np.random.default_rng(4)
    for _ in range(20):
        u = rng.integers(0, 256, (9, 11))
        spread = lambda t, u=u: 0.0 if not (u <= t).any() or not (u > t).any() else (u <= t).sum() * (u > t).sum() * (u[u <= t].mean() - u[u > t].mean()) ** 2
        assert spread(regions.otsu(u)) == pytest.approx(max(map(spread, range(256))))
        mask, label = u > 140, regions.labelled(u > 140)
        assert ((label > 0) == mask).all()
        for y, x in np.argwhere(mask):
            near = label[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
            assert set(near[near > 0]) == {label[y, x]}
        assert len(set(label[mask])) == label.max()
