"""Operator 4, best-fit packing: minimum bin slack over the histogram of piece lengths.

A packing depends on lengths alone, and there are at most ``capacity`` of them.
So the plan is made on the driver from a histogram of at most ``capacity`` rows,
whatever the size of the corpus: per bin, the largest length left is fixed and a
bitset subset-sum dynamic programme over the lengths left finds the fullest
combination, which is removed as often as its lengths last. Every such pattern
uses up a length, so a plan has at most ``capacity`` patterns. Pieces then find
their places by rank within their length; ranks are counted in salted groups, so
a length that a third of the pieces share is dealt over many tasks.

Defined results: null and empty texts have the end id alone; rows with equal or null ids
are packed one by one; very long texts are encoded whole, runs of millions of white-space
characters too; of combinations that are equally full the one of fewest short lengths is
taken, and pieces of equal length take their places by the order in which they were read;
an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, text_batches

CAPACITY, END_ID = 1024, 2
#: Rows of one salted group of a length, about; and the least number of salts.
GROUP_ROWS, SALTS = 50_000, 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The split pattern of byte-level pre-tokenizers, and a text that tells differing engines apart.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's  a probe,\n\n with 12³ numbers; Größe, ñandú \u00a0\u2003 漢字 \U0001f600 <|endoftext|>\t\r\n end  "


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: itself where printable, else the next above 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TextEncoder:
    """Ids of whole texts, as the tokenizers library gives them for a tokenizer file.

    Where the file is a plain byte-level BPE whose ids are its merge ranks, tiktoken's
    engine runs the file's vocabulary, at a third of the time; both must agree on a
    probe, else the library itself encodes. The library also encodes each text that the
    engine fails on (a run of a million white-space characters) or, with ``added``, that
    holds an added token, which is then one id; else its string is ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.fast = self._engine(path)
        self.tok.encode_special_tokens = not added
        strings = [t.content for t in self.tok.get_added_tokens_decoder().values() if added or not t.special]
        self.added = re.compile("|".join(map(re.escape, strings))) if strings else None

    def _engine(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        try:
            letters = byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
            engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            if engine.encode_ordinary(PROBE) == self.tok.encode(PROBE, add_special_tokens=False).ids:
                return engine
        except (KeyError, ValueError, TypeError):  # another kind of vocabulary
            pass
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        if self.fast:
            ids = map(self._ids, texts)
        else:
            ids = (e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False))
        return [np.asarray(i, "<u4").tobytes() for i in ids]

    def _ids(self, text: str) -> list[int]:
        """Ids by the engine where it is able to, else by the library."""
        if not (self.added and self.added.search(text)):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the engine's panics are no Exceptions
                if type(e).__name__ != "PanicException":
                    raise
        return self.tok.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def encoder(path: str) -> TextEncoder:
    """One encoder a worker process, with added tokens as the library's defaults have them; later tasks find it loaded."""
    return TextEncoder(path, added=True)


def pieces_of(count: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``count`` ids; only the first may be short."""
    if count <= capacity:
        return [(0, count)]
    first = count % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, count, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    path = path or default_tokenizer()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 64):
                rows = []
                group = [t or "" for t in texts.slice(lo, 64).to_pylist()]
                for doc, data in zip(ids[lo : lo + 64], enc.encode(group), strict=True):
                    data = memoryview(data + end)
                    for k, (s, n) in enumerate(pieces_of(len(data) // 4, capacity)):
                        rows.append((doc, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of a combination with the largest sum that fits into room: bitset subset sums."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        most = min(counts[length], room // length) if length <= room else 0
        if not most:
            continue
        steps.append((length, most, reach))
        left, chunk = most, 1
        while left:
            take = min(chunk, left)
            reach |= (reach << (length * take)) & full
            left, chunk = left - take, chunk * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for length, most, before in reversed(steps):
        k = next(k for k in range(most + 1) if at >= k * length and before >> (at - k * length) & 1)
        if k:
            out.append((length, k))
            at -= k * length
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, copies)]) patterns that pack the whole histogram."""
    left, out = {n: c for n, c in histogram.items() if c}, []
    while left:
        top = max(left)
        left[top] -= 1
        inside = dict(fullest(left, capacity - top))
        left[top] += 1
        inside[top] = inside.get(top, 0) + 1
        bins = min(left[n] // k for n, k in inside.items())
        for n, k in inside.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
        out.append((bins, sorted(inside.items(), reverse=True)))
    return out


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For runs of ranks of a length: key (length << 44 | first rank), first bin, copies a bin, first offset."""
    rows, used = [], {}
    starts = accumulate((bins for bins, _ in patterns), initial=0)
    for base, (bins, inside) in zip(starts, patterns, strict=False):
        offset = 0
        for n, k in inside:
            first = used.get(n, 0)
            rows.append(((n << 44) | first, base, k, offset, first))
            used[n] = first + bins * k
            offset += n * k
    table_ = np.array(sorted(rows) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    return dict(zip(("key", "base", "copies", "offset", "first"), table_.T, strict=True))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and offset; see the module's docstring."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    made = pieces(docs, path, capacity, end_id).withColumn("uid", F.monotonically_increasing_id())
    made = scratch.save(made, "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(SALTS, -(-sum(histogram.values()) // GROUP_ROWS))
    found = places(plan(histogram, capacity))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = scratch.save(sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "sizes")
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid"))
    ranked = salted.withColumn("nth", nth).join(sizes, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(found["key"], (n << 44) | rank, side="right") - 1
            j, k = rank - found["first"][at], found["copies"][at]
            cols = [*batch.columns[:5], pa.array(found["base"][at] + j // k), pa.array(found["offset"][at] + n * (j % k))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
