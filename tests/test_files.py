"""Image files and folders: readers, runs, exports, overlays, results that are read back; numbering over partitions."""

from __future__ import annotations

import csv
import glob
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import preprocess
from tessella.functions import raster as R
from tessella.operators import folder, kernels, pipeline, regions, transforms
from tessella.plans import curation_queries, distance_queries, raster_queries, training_queries
from tessella.sources import images, sinks
from tessella.sources.files import write_files
from tessella.streaming import progress


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(image, bits=8, colour=0, interlaced=False, palette=None):
    """A PNG without filters, of any bit depth, interlaced or not."""
    image = image if image.ndim == 3 else image[..., None]
    h, w, c = image.shape
    body = b""
    for y, x, dy, dx in images.PASSES if interlaced else ((0, 0, 1, 1),):
        part = image[y::dy, x::dx]
        if not part.size:
            continue
        for line in part:
            if bits == 16:
                packed = line.astype(">u2").tobytes()
            else:
                flat = (line.ravel()[:, None] >> np.arange(bits)[::-1] & 1).astype(np.uint8).ravel()
                packed = np.packbits(flat).tobytes()
            body += b"\0" + packed
    head = struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, int(interlaced))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def lzw(data):
    """9-bit codes with a clear before each table of 200 entries: enough to be read by any reader."""
    codes = []
    for i, b in enumerate(data):
        codes += [256] * (i % 200 == 0) + [b]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def packbits(data):
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100))


def tiff(image, order="<", pack=1, rows=None, tile=None, predictor=1, photometric=1, form=1):
    """A TIFF of strips or tiles."""
    image = image if image.ndim == 3 else image[..., None]
    h, w, c = image.shape
    kind = image.dtype.newbyteorder(order)
    squeeze = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}[pack]
    rows = rows or h
    parts = []
    if tile:
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                part = np.zeros((tile, tile, c), image.dtype)
                got = image[y : y + tile, x : x + tile]
                part[: got.shape[0], : got.shape[1]] = got
                parts.append(part)
    else:
        parts = [image[y : y + rows] for y in range(0, h, rows)]
    if predictor == 2:
        parts = [np.concatenate([p[:, :1], np.diff(p, axis=1)], 1).astype(image.dtype) for p in parts]
    data = [squeeze(p.astype(kind).tobytes()) for p in parts]
    out, places = b"\0" * 8, []
    for d in data:
        places.append(len(out))
        out += d
    fields = {256: [w], 257: [h], 258: [image.dtype.itemsize * 8] * c, 259: [pack], 262: [photometric], 277: [c], 317: [predictor], 339: [form] * c}
    fields |= {322: [tile], 323: [tile], 324: places, 325: list(map(len, data))} if tile else {273: places, 278: [rows], 279: list(map(len, data))}
    entries, extra = b"", b""
    base = len(out) + 2 + 12 * len(fields) + 4
    for tag in sorted(fields):
        v = fields[tag]
        packed = struct.pack(f"{order}{len(v)}I", *v)
        value = packed if len(packed) == 4 else struct.pack(order + "I", base + len(extra))
        extra += packed if len(packed) > 4 else b""
        entries += struct.pack(order + "HHI", tag, 4, len(v)) + value
    ifd = struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0" + extra
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, len(out)) + out[8:] + ifd


def test_png_of_any_depth():
    rng = np.random.default_rng(3)
    for interlaced in (False, True):
        for h, w in ((1, 1), (5, 3), (9, 17)):
            for bits in (1, 2, 4, 8, 16):
                x = rng.integers(0, 1 << bits, (h, w))
                want = x * (255 // ((1 << bits) - 1)) if bits < 8 else x
                assert (images.decode_png(png(x, bits, 0, interlaced)) == want).all()
            for bits in (8, 16):
                x = rng.integers(0, 1 << bits, (h, w, 3))
                assert (images.decode_png(png(x, bits, 2, interlaced)) == x).all()
            palette = rng.integers(0, 256, (16, 3))
            x = rng.integers(0, 16, (h, w))
            assert (images.decode_png(png(x, 4, 3, interlaced, palette)) == palette[x]).all()


@pytest.mark.parametrize("pack", [1, 5, 8, 32773])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff(pack, order):
    rng = np.random.default_rng(4)
    for kind in (np.uint8, np.uint16, np.uint32):
        for shape in ((7, 5), (20, 33), (6, 4, 3)):
            x = rng.integers(0, np.iinfo(kind).max, shape).astype(kind)
            for more in ({}, {"rows": 4}, {"tile": 16}, {"predictor": 2, "rows": 3}):
                assert (images.decode_tiff(tiff(x, order, pack, **more)) == x).all(), more
    f = rng.random((8, 9)).astype(np.float32)
    assert (images.decode_tiff(tiff(f, order, pack, form=3)) == f).all()
    g = rng.integers(0, 256, (4, 4)).astype(np.uint8)
    assert (images.decode_tiff(tiff(g, order, pack, photometric=0)) == 255 - g).all()


def test_lzw_with_growing_codes():
    """A code stream as an encoder with a full table writes it: widths of 9 to 12 bits."""
    data = bytes(np.random.default_rng(5).integers(0, 7, 30_000).astype(np.uint8))
    known, bits, width = {bytes([k]): k for k in range(256)}, [f"{256:09b}"], 9
    size, at = 258, b""
    for b in data:
        now = at + bytes([b])
        if now in known:
            at = now
            continue
        bits.append(f"{known[at]:0{width}b}")
        known[now], size, at = size, size + 1, bytes([b])
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
        if size >= 4094:
            bits.append(f"{known[at]:0{width}b}")
            bits.append(f"{256:0{width}b}")
            known, size, width, at = {bytes([k]): k for k in range(256)}, 258, 9, b""
    if at:
        bits.append(f"{known[at]:0{width}b}")
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    bits.append(f"{257:0{width}b}")
    bits = "".join(bits)
    bits += "0" * (-len(bits) % 8)
    assert images._lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == data


def jpeg(spark, x):
    """A JPEG and a BMP of an image by the JVM's writers."""
    jvm, (h, w) = spark._jvm, x.shape
    held = jvm.java.awt.image.BufferedImage(w, h, 10)
    for y in range(h):
        for k in range(w):
            v = int(x[y, k])
            held.getRaster().setSample(k, y, 0, v)
    out = []
    for kind in ("jpg", "bmp"):
        stream = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(held, kind, stream)
        out.append(bytes(stream.toByteArray()))
    return out


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    """A folder of speckled images of each kind, with a bad file, a constant image and equal stems."""
    out, rng = tmp_path_factory.mktemp("pictures"), np.random.default_rng(0)
    made = {}
    for i in range(6):
        x = np.full((24, 24), 0.2)
        x[6:18, 8:15] = 0.6
        made[i] = np.clip(x * rng.gamma(1, 1, (24, 24)) * 120, 0, 255).astype(np.uint8)
    (out / "sub").mkdir()
    (out / "00000.png").write_bytes(images.encode_png(made[0]))
    (out / "sub" / "00000.png").write_bytes(images.encode_png(made[1]))
    (out / "00002.TIF").write_bytes(tiff(made[2].astype(np.uint16) * 200))
    for name, data in zip(("00003.jpg", "00004.bmp"), jpeg(spark, made[3]), strict=True):
        (out / name).write_bytes(data)
    (out / "00005.png").write_bytes(images.encode_png(np.full((8, 8), 7)))
    (out / "bad.png").write_bytes(b"no image")
    (out / "bad.jpeg").write_bytes(b"no image")
    (out / ".hidden.png").write_bytes(images.encode_png(made[5]))
    (out / "notes.txt").write_text("x")
    return str(out), made


def test_images_of_each_kind(spark, pictures):
    path, made = pictures
    found = {r["path"].removeprefix("file:").removeprefix("//").removeprefix(path + "/"): r for r in images.read_images(spark, path).collect()}
    assert set(found) == {"00000.png", "sub/00000.png", "00002.TIF", "00003.jpg", "00004.bmp", "00005.png", "bad.png"} | ({"bad.jpeg"} & set(found))
    data = {k: np.array(r["data"]).reshape(r["h"], r["w"]) for k, r in found.items() if r["data"]}
    assert (data["00000.png"] == made[0]).all() and (data["sub/00000.png"] == made[1]).all() and (data["00002.TIF"] == made[2] * 200.0).all() and (data["00004.bmp"] == made[3]).all()
    assert abs(data["00003.jpg"] - made[3]).mean() < 12 and found["bad.png"]["error"] and found["bad.png"]["data"] is None
    assert sorted(r["path"].rpartition("/")[2] for r in images.read_images(spark, path, recursive=False).collect() if r["data"]) == ["00000.png", "00002.TIF", "00003.jpg", "00004.bmp", "00005.png"]


def test_run_over_a_folder(spark, pictures, tmp_path):
    path, made = pictures
    out = str(tmp_path / "out")
    said = preprocess.main(["--input_dir", path, "--output_dir", out, "--image_size", "32", "--speckle_method", "lee"], spark)
    assert said == f"success 5, skipped 1, failed {1 + len(images.read_images(spark, path).where('path like ' + repr('%bad.jpeg')).collect())}"
    rows = [r for f in glob.glob(f"{out}/manifest.csv/part-*") for r in csv.DictReader(open(f))]
    assert list(rows[0]) == folder.MANIFEST
    state = {r["input_path"].rpartition(path + "/")[2]: r for r in rows}
    assert state["00005.png"]["status"] == "skipped" and state["bad.png"]["status"] == "failed" and "not a PNG" in state["bad.png"]["error"]
    good = [r for r in rows if r["status"] == "success"]
    assert len(glob.glob(f"{out}/images/*.png")) == 5 == len({r["output_path"] for r in good}), "equal stems keep a file each"
    spec = pipeline.with_params(pipeline.with_params(pipeline.default_spec(), "speckle_filter", method="lee"), "resize_or_tile", image_size=32)
    for r in good:
        x = images.decode_png(open(r["output_path"], "rb").read())
        assert x.shape == (32, 32, 3) == (int(r["out_h"]), int(r["out_w"]), 3) and float(r["elapsed_sec"]) >= 0
        if r["input_path"].endswith("00002.TIF"):
            want, _ = pipeline.process(made[2] * 200.0, pipeline.built(spec))
            assert (x == want).all()
    seen = glob.glob(f"{out}/preview/*_ba.png")
    assert len(seen) == 5 and images.decode_png(open(seen[0], "rb").read()).shape == (32, 64, 3)
    config = json.load(open(f"{out}/pipeline_config.resolved.json"))
    assert config["io"]["input_dir"] == path and [s["params"]["method"] for s in config["pipeline"]["steps"] if s["name"] == "speckle_filter"] == ["lee"]
    assert folder.summary(folder.run_folder(spark, folder.overridden(config, output_dir=str(tmp_path / "few"), max_items=2))).startswith("success 2,")


def test_reference_curves(spark, pictures, tmp_path):
    path, made = pictures
    x, cdf = folder.reference_curve(spark, path, 64)
    assert len(x) == 64 and cdf[-1] == pytest.approx(1) and (np.diff(cdf) >= 0).all()
    at = sinks.save_npy_curve(spark, x, cdf, str(tmp_path / "curve.npy"))
    back = sinks.load_npy_curve(spark, at)
    assert (back[0] == x).all() and (back[1] == cdf).all()
    np.save(tmp_path / "flat.npy", cdf)
    np.save(tmp_path / "none.npy", np.empty(0))
    (tmp_path / "bad.npy").write_bytes(b"bad")
    flat = sinks.load_npy_curve(spark, str(tmp_path / "flat.npy"))
    assert (flat[1] == cdf).all() and (flat[0] == np.linspace(0, 1, 64)).all()
    assert [sinks.load_npy_curve(spark, p) for p in (None, str(tmp_path / "no.npy"), str(tmp_path / "bad.npy"), str(tmp_path / "none.npy"))] == [None] * 4
    config = folder.overridden(folder.default_config(), input_dir=path, output_dir=str(tmp_path / "o"), histogram_mode="unpaired_optical_reference", optical_reference_dir=path, image_size=16)
    assert folder._target(spark, config["pipeline"]["steps"])[0][1][-1] == pytest.approx(1)
    lost = folder.overridden(config, optical_reference_dir=str(tmp_path / "nothing"))
    assert folder._target(spark, lost["pipeline"]["steps"]) == (None, ["no reference curve: the built-in one is used"])


@pytest.mark.parametrize("mode", ["link", "copy"])
def test_export(spark, pictures, tmp_path, mode):
    path, _ = pictures
    a = images.listed(spark, path).select("path")
    n, out = a.count(), str(tmp_path / "cut")
    for _ in range(2):  # targets that are there are counted again
        counts = {r["folder"]: r["n"] for r in folder.export_layout(a, out, a, 0.4, mode).collect()}
        assert counts == {"trainA": n - int(n * 0.4), "testA": int(n * 0.4), "trainB": n - int(n * 0.4), "testB": int(n * 0.4)}
    for sub, k in counts.items():
        names = sorted(os.listdir(f"{out}/{sub}"))
        assert [x[:7] for x in names if not x.startswith(".")] == [f"{i:06d}_" for i in range(k)]
        assert all(os.path.islink(f"{out}/{sub}/{x}") == (mode == "link") for x in names if not x.endswith(".crc"))
    with pytest.raises(ValueError):
        write_files(a, out, "move")


def test_overlays_and_label_folders(spark, pictures, tmp_path):
    path, made = pictures
    square = np.zeros((40, 60), np.uint8)
    square[10:30, 20:50] = 250
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.png").write_bytes(images.encode_png(square))
    rows = folder.rectify_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), max_share=0.5).collect()
    assert [(r["image"], r["cx"], r["cy"], sorted((r["width"], r["height"]))) for r in rows] == [("s.png", 35.0, 20.0, [20.0, 30.0])]
    drawn = images.decode_png((tmp_path / "out" / "s.png").read_bytes())
    assert drawn.shape == (40, 60, 3) and (drawn[10, 20:50] == (0, 255, 0)).all(1).any() | (drawn[10, 20:50] == (255, 0, 0)).all(1).any()
    assert glob.glob(str(tmp_path / "out" / "rectangles.csv" / "part-*"))
    one = spark.createDataFrame([("fake_B", "a", 2, 2, 1, [0.0, 300.0, -5.0, 7.0]), ("real_A", "a", 1, 1, 3, [1.0, 2.0, 3.0])], "label string, stem string, h int, w int, channels int, data array<double>")
    folder.save_images(one, str(tmp_path / "res"))
    assert (images.decode_png((tmp_path / "res" / "fake_B" / "a.png").read_bytes()) == [[0, 255], [0, 7]]).all()
    assert images.decode_png((tmp_path / "res" / "real_A" / "a.png").read_bytes()).tolist() == [[[1, 2, 3]]]


def test_listing_follows_links(spark, pictures, tmp_path):
    path, _ = pictures
    (tmp_path / "d").mkdir()
    os.symlink(path, tmp_path / "d" / "linked")
    os.symlink(f"{path}/00005.png", tmp_path / "d" / "one.png")
    names = sorted(r["name"] for r in images.listed(spark, str(tmp_path / "d")).collect())
    assert names == sorted(["one.png", *(r["name"] for r in images.listed(spark, path).collect())])
    assert [r["name"] for r in images.listed(spark, path, limit=2).collect()] == ["00000.png", "00002.TIF"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        images.listed(spark, str(tmp_path / "nothing"))


def test_gallery(spark, tmp_path):
    folder.gallery(spark, str(tmp_path), "runs & more", [("a", [("fake/1.png", "fake <1>")])], refresh=5)
    page = (tmp_path / "index.html").read_text()
    assert "runs &amp; more" in page and 'src="images/fake/1.png"' in page and "fake &lt;1&gt;" in page and 'content="5"' in page


def test_transform_chain(spark):
    x = np.random.default_rng(2).integers(0, 256, (20, 30, 3)).astype(float)
    df = spark.createDataFrame([(i, 20, 30, 3, x.ravel().tolist()) for i in range(12)], "img long, h int, w int, channels int, data array<double>")
    o = transforms.Options
    sizes = {"none": (20, 32), "resize": (24, 24), "scale_width": (16, 24), "scale_shortside": (24, 36), "crop": (12, 12), "patch": (12, 12), "trim": (12, 12), "zoom": None}
    for spec, size in sizes.items():
        for r in transforms.apply(df, o(spec, load_size=24, crop_size=12, convert=False)).collect():
            assert size in (None, (r["h"], r["w"])) and r["h"] % 4 == r["w"] % 4 == 0 and r["channels"] == 3
    assert [n for n, _ in transforms.steps(o("scale_width_and_crop", gray=True))] == ["gray", "scale_width", "crop", "multiple_of_4", "flip", "normalise"]
    flips = set()
    for r in transforms.apply(df, o("crop", crop_size=12, gray=True)).collect():
        y, k = int(transforms.drawn(r["img"], "y") * 9), int(transforms.drawn(r["img"], "x") * 19)
        want = (x[y : y + 12, k : k + 12] @ [0.299, 0.587, 0.114]) / 127.5 - 1
        flip = transforms.drawn(r["img"], "f") > 0.5
        flips.add(flip)
        np.testing.assert_allclose(np.array(r["data"]).reshape(12, 12), want[:, ::-1] if flip else want, atol=1e-9)
    assert flips == {False, True}
    assert np.allclose(transforms.resampled(np.full((7, 5, 1), 9.0), 12, 3), 9)
    with pytest.raises(Exception, match="smaller than a patch"):
        transforms.apply(df, o("patch", crop_size=40)).collect()


def test_pairs_that_do_not_belong_together(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        with pytest.raises(ValueError, match="do not belong together"):
            training_queries.checked_pairs(spark, "/root/testdata/sf0.001")


def test_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "r1.txt").write_text("(epoch: 1, iters: 5, time: 0.1, data: 0.1) G_GAN: 1.5\nnoise\n(epoch: 2, iters: 7, time: 0.1, data: 0.1) G_GAN: 0.5\n")
    query = progress.line_stream(spark, str(tmp_path / "logs")).writeStream.format("memory").queryName("lines").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    assert sorted((r["run"], r["line"][:9]) for r in spark.table("lines").collect()) == [("r1", "(epoch: 1"), ("r1", "(epoch: 2"), ("r1", "noise")]


def test_results_are_read_back(spark, tmp_path):
    best = {"signature": "a>b", "composite": 0.5}
    assert sinks.load_json(spark, sinks.save_json(spark, best, str(tmp_path / "best.json"))) == best
    (tmp_path / "bad.json").write_text("{")
    assert sinks.load_json(spark, str(tmp_path / "bad.json")) is None and sinks.load_json(spark, str(tmp_path / "none.json")) is None and sinks.load_json(spark, None) is None
    text = sinks.options_text({"b": 1, "a": "x"}, {"b": 2, "a": "x"}).split("\n")
    assert text[1].split() == ["a:", "x"] and text[2].split("\t")[1] == "[default: 2]" and sinks.eval_folder("r/", "n") == "r/n/eval_logs"
    manifest = spark.createDataFrame([(1,)], "a int")
    assert sinks.write_manifest(manifest, str(tmp_path / "m.csv")) == str(tmp_path / "m.csv")
    (tmp_path / "file").write_text("x")
    locked = tmp_path / "locked.csv"
    locked.mkdir()
    os.chmod(locked, 0o500)
    other = sinks.write_manifest(manifest, str(locked))  # root may write there anyway
    assert glob.glob(f"{other}/part-*")


def test_numbers_of_a_large_table(spark, tmp_path):
    """Every position once, however the exchanges are coalesced."""
    n = 1_000_000
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
        rows = spark.range(n, numPartitions=16).select(F.md5(F.col("id").cast("string")).alias("key"), "id", F.repeat(F.lit("payload"), 3).alias("extra"))
        curation_queries.numbered(rows, "key", "id").write.parquet(str(tmp_path / "t"))
        groups = rows.withColumn("g", F.when(F.col("id") % 3 == 0, "small").otherwise("large"))
        curation_queries.numbered_within(groups, ("g",), "key", "id").write.parquet(str(tmp_path / "g"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    back = spark.read.parquet(str(tmp_path / "t"))
    got = back.agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
    assert tuple(got) == (n, n, 0, n - 1)
    first = back.orderBy("pos").limit(1000).select("key").collect()
    assert [r["key"] for r in first] == [r["key"] for r in rows.orderBy("key", "id").limit(1000).select("key").collect()]
    for r in spark.read.parquet(str(tmp_path / "g")).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect():
        assert (r["d"], r["lo"], r["hi"]) == (r["n"], 0, r["n"] - 1)


def test_kernels_equal_expressions(spark):
    rng = np.random.default_rng(7)
    rows = [(i, h, w, rng.random(h * w).tolist(), rng.random(h * w).tolist()) for i, (h, w) in enumerate([(9, 9), (8, 12)])]
    df = spark.createDataFrame(rows, "img long, h int, w int, a array<double>, b array<double>")
    h, w, a, b = (F.col(c) for c in ("h", "w", "a", "b"))
    got = df.select("img", R.ssim(a, b, h, w).alias("ssim"), R.saliency(a, h, w).alias("sal"), R.sharpness(a, h, w).alias("sharp"), R.laplacian(a, h, w).alias("lap")).collect()
    for r in got:
        _, hh, ww, x, y = rows[r["img"]]
        x, y = np.array(x).reshape(hh, ww), np.array(y).reshape(hh, ww)
        assert r["ssim"] == pytest.approx(kernels.ssim(x, y), abs=1e-9)
        for name, fn in (("sal", kernels.saliency), ("sharp", kernels.sharpness), ("lap", kernels.laplacian)):
            np.testing.assert_allclose(np.array(r[name]), fn(x).ravel(), atol=1e-9)


def test_discrepancy_by_definition(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (60, 6)), rng.normal(1, 1, (45, 6))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, e array<double>")
    kernel = lambda x, y: (x @ y.T / 6 + 1) ** 3

    def value(x, y):
        inside = lambda k: (k.sum() - np.trace(k)) / (len(k) * (len(k) - 1))
        return inside(kernel(x, x)) + inside(kernel(y, y)) - 2 * kernel(x, y).mean()

    assert distance_queries.kid_of(frame(a), frame(b), 6).first()["kid"] == pytest.approx(value(a, b))
    import hashlib

    pick = lambda x, k, s: x[sorted(range(len(x)), key=lambda i: hashlib.md5(f"{i}:{k}".encode()).hexdigest())[:s]]
    for size in (100, 20):
        s = min(size, 45)
        got = distance_queries.kid_of_subsets(frame(a), frame(b), 10, size).first()
        assert (got["n_a"], got["n_b"]) == (60, 45) and got["kid"] == pytest.approx(np.mean([value(pick(a, k, s), pick(b, k, s)) for k in range(10)]))
    assert np.isnan(distance_queries.kid_of_subsets(frame(a), frame(b[:1])).first()["kid"])
    many = rng.normal(0, 1, (3000, 6))  # beyond the hash bound's size
    got = distance_queries.kid_of_subsets(frame(many), frame(b), 3, 20).first()
    assert got["kid"] == pytest.approx(np.mean([value(pick(many, k, 20), pick(b, k, 20)) for k in range(3)]))


def test_levels_and_otsu_query(spark):
    assert raster_queries.otsu_threshold(spark, "/root/testdata/sf0.001").count() > 0 if os.path.isdir("/root/testdata/sf0.001") else True
    assert (regions.levels(np.array([[-1.0, 0.5], [np.nan, 2.0]])) == [[0, 127], [0, 255]]).all()


def test_entry_tells_missing_libraries_from_removed_folders(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def failing(name):
        def fake(module, *args, **kwargs):
            if module == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(module, *args, **kwargs)

        return fake

    monkeypatch.setattr(builtins, "__import__", failing("corpus_pipeline"))
    assert entry._llm() is None
    monkeypatch.setattr(builtins, "__import__", failing("xxhash"))
    with pytest.raises(ModuleNotFoundError):
        entry._llm()


def test_no_shared_folder_is_an_error_on_a_cluster(tmp_path):
    from tessella import scratch

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = type("C", (), {"master": master})

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            scratch.shared_dir(Session(master))
    assert scratch.shared_dir(Session("local[2]")).startswith("file:")
