"""Image files: listing, a PNG reader and writer of 8 and 16 bits, and DataFrames of decoded images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import Rows, schema_of
from ..plans.curation_queries import IMAGE_EXTENSIONS, is_image


def listed(spark: SparkSession, folder: str, recursive: bool = True, preset: str = "pipeline", limit: int = 0) -> DataFrame:
    """path, name and size of the image files of a folder, hidden ones left out; the content is not read.

    Links are followed. A folder that is not there is an error. limit: the first files by path alone (0: all).
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if not recursive:
        rows = rows.where(F.substring_index("path", "/", -2) == F.concat(F.lit(folder.rstrip("/").rpartition("/")[2] + "/"), F.substring_index("path", "/", -1)))
    rows = rows.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"))
    rows = rows.where(is_image(F.col("name"), preset))
    return rows.orderBy("path").limit(limit) if limit else rows


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Lines (filter byte in front) as bytes; step is the distance of the same byte of the pixel before."""
    out, before = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8), np.zeros(raw.shape[1] - 1, np.uint8)
    for y in range(len(raw)):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            line = line + before
        elif kind in (3, 4):
            for i in range(len(line)):
                a = int(line[i - step]) if i >= step else 0
                b, c = int(before[i]), int(before[i - step]) if i >= step else 0
                guess = (a + b) // 2 if kind == 3 else min((abs(a + b - c - v), k, v) for k, v in enumerate((a, b, c)))[2]
                line[i] = (int(line[i]) + guess) & 255
        out[y] = before = line
    return out


def _samples(lines: np.ndarray, w: int, channels: int, bits: int) -> np.ndarray:
    """Lines of packed samples of 1 to 16 bits, high byte first, as h x w x channels."""
    if bits == 16:
        return np.ascontiguousarray(lines).view(">u2").astype(np.uint16).reshape(len(lines), w, channels)
    if bits < 8:
        parts = np.unpackbits(lines, axis=1).reshape(len(lines), -1, bits)
        lines = (parts * (1 << np.arange(bits)[::-1])).sum(2).astype(np.uint8)[:, : w * channels]
    return lines.reshape(len(lines), w, channels)


#: Fixed values of the format: first row, first column and steps of each pass of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def decode_png(data: bytes) -> np.ndarray:
    """h x w or h x w x channels of a PNG of 1 to 16 bits, gray, colour or palette, interlaced or not."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head, palette = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    w, h, bits, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, at = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8), 0
    image = np.zeros((h, w, channels), np.uint16 if bits == 16 else np.uint8)
    for y, x, dy, dx in PASSES if interlaced else ((0, 0, 1, 1),):
        part = image[y::dy, x::dx]
        if not part.size:
            continue
        width = 1 + (part.shape[1] * channels * bits + 7) // 8
        lines = _unfiltered(raw[at : at + part.shape[0] * width].reshape(-1, width), max(1, channels * bits // 8))
        image[y::dy, x::dx] = _samples(lines, part.shape[1], channels, bits)
        at += part.shape[0] * width
    if colour == 3:
        return palette[image[..., 0]]
    if bits < 8:
        image = (image * (255 // ((1 << bits) - 1))).astype(np.uint8)
    return image[..., 0] if channels == 1 else image


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends."""
    known: list[bytes] = []
    out, held, bits, width, before = bytearray(), 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            known, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        now = known[code] if code < len(known) else before + before[:1]
        out += now
        if before:
            known.append(before + now[:1])
        before = now
        width = 9 + (len(known) >= 511) + (len(known) >= 1023) + (len(known) >= 2047)
    return bytes(out)


#: Fixed values of the format: bytes of a field's value by its type.
FIELD_BYTES = {1: "B", 3: "H", 4: "I", 16: "Q"}


def decode_tiff(data: bytes) -> np.ndarray:
    """h x w or h x w x channels of the first image of a TIFF: strips or tiles, 1 to 32 bits or float; raw, PackBits, LZW or deflate."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    fields: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind in FIELD_BYTES:
            form = f"{order}{count}{FIELD_BYTES[kind]}"
            size = struct.calcsize(form)
            place = 0 if size <= 4 else struct.unpack(order + "I", entry[8:])[0]
            fields[tag] = struct.unpack(form, entry[8 : 8 + size] if size <= 4 else data[place : place + size])
    one = lambda tag, other=None: fields.get(tag, (other,))[0]
    w, h, channels, bits = one(256), one(257), one(277, 1), one(258, 1)
    pack, predictor, planar, form = one(259, 1), one(317, 1), one(284, 1), one(339, 1)
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32773: _packbits, 32946: zlib.decompress}.get(pack)
    if unpack is None or bits not in (1, 2, 4, 8, 16, 32) or planar != 1 and channels > 1:
        raise ValueError("this kind of TIFF is not read")
    tiled = 322 in fields
    tw, th = (one(322), one(323)) if tiled else (w, min(one(278, h), h))
    places, sizes = (fields[324], fields[325]) if tiled else (fields[273], fields[279])
    kind = np.dtype(f"{order}{'f' if form == 3 else 'i' if form == 2 else 'u'}{max(bits, 8) // 8}")
    across = -(-w // tw)
    image = np.zeros((-(-h // th) * th, across * tw, channels), kind.newbyteorder("="))
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        y, x = k // across * th, k % across * tw
        rows = th if tiled else min(th, h - y)
        raw, width = np.frombuffer(unpack(data[place : place + size]), np.uint8), (tw * channels * bits + 7) // 8
        lines = raw[: rows * width].reshape(rows, width)
        part = np.ascontiguousarray(lines).view(kind).reshape(rows, tw, channels) if bits >= 8 else _samples(lines, tw, channels, bits)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("="))
        image[y : y + rows, x : x + tw] = part
    image = image[:h, :w]
    if bits < 8:
        image = image * (255 // ((1 << bits) - 1))
    if one(262) == 0 and form == 1:  # white is zero
        image = (1 << max(bits, 8)) - 1 - image
    if one(262) == 3:
        table = np.array(fields[320], np.uint16).reshape(3, -1).T >> 8
        return table[image[..., 0]].astype(np.uint8)
    return image[..., 0] if channels == 1 else image


def decode(data: bytes) -> np.ndarray:
    """A PNG or a TIFF."""
    return decode_tiff(data) if data[:2] in (b"II", b"MM") else decode_png(data)


def encode_png(image: np.ndarray) -> bytes:
    """A PNG of a gray or RGB image of whole numbers, 8 bits or, beyond 255, 16."""
    image = np.asarray(image)
    deep = image.max(initial=0) > 255
    rows = image.astype(">u2" if deep else np.uint8)
    h, w = image.shape[:2]
    lines = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 16 if deep else 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


PIXELS = "path string, h int, w int, data array<double>, error string"


def _gray(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x.mean(-1) if x.ndim == 3 else x


def _files(spark: SparkSession, folder: str, kind: str, extensions: tuple[str, ...], recursive: bool) -> DataFrame:
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in extensions) + "}"
    return spark.read.format(kind).option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(folder)


def _decoded(rows: DataFrame, read) -> DataFrame:
    """path, h, w, data and error of rows (path, ...); read gets a row's other values. Files that can't be decoded keep a row."""
    schema = schema_of(PIXELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for path, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    x = _gray(read(*rest))
                    row = {"h": x.shape[0], "w": x.shape[1], "data": x}
                except Exception as e:  # recorded, as one bad file must not end a scan
                    row = {"error": f"{type(e).__name__}: {e}"}
                yield from out.add({"path": path, **row})
        yield from out.rest()

    return rows.mapInArrow(run, PIXELS)


def read_png(spark: SparkSession, folder: str) -> DataFrame:
    """img (by path hash), path, h, w, data (gray: plain channel mean) and error of each PNG below a folder."""
    return _decoded(_files(spark, folder, "binaryFile", ("png",), True).select("path", "content"), decode).withColumn("img", F.xxhash64("path"))


def _jvm_image(h: int, w: int, channels: int, data: bytes) -> np.ndarray:
    if h <= 0:
        raise ValueError("image can't be decoded")
    return np.frombuffer(data, np.uint8).reshape(h, w, channels)


def read_images(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Likewise of all images below a folder: PNG and TIFF of up to 16 bits (float TIFF, too) by the decoders
    here, JPEG and BMP by Spark's image source. Hidden files are left out."""
    own = _decoded(_files(spark, folder, "binaryFile", ("png", "tif", "tiff"), recursive).select("path", "content"), decode)
    jvm = _files(spark, folder, "image", ("jpg", "jpeg", "bmp"), recursive).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    both = own.unionByName(_decoded(jvm, _jvm_image))
    return both.where(~F.substring_index("path", "/", -1).startswith(".")).withColumn("img", F.xxhash64("path"))


__all__ = ["IMAGE_EXTENSIONS", "decode", "decode_png", "decode_tiff", "encode_png", "listed", "read_images", "read_png"]
