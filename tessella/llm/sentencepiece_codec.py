"""Operator 5, SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A model file's pieces and log scores are read with a small protobuf reader. Texts
get a whitespace marker for each blank (and one in front); the best segmentation
maximises the sum of scores over a double-array trie of pieces. A character that
no piece covers costs the least score minus UNKNOWN_PENALTY and becomes its bytes'
pieces. If no piece has a marker behind another character - checked when the model
is loaded - best segmentations of whole texts are those of the words joined, and a
worker remembers words; else whole texts are segmented.

Defined results: null and empty texts have no ids and decode to an empty text;
repeated rows get equal results; of segmentations of equal sums the one whose last piece
starts first is taken; very long texts are encoded whole, in time that grows with their
length; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers.
CACHE = 1_000_000
#: Piece types in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            out.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
    return out


class DoubleArray:
    """A trie in two arrays: the child of state s by byte b is t = base[s] + b + 1 where check[t] == s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in zip(keys, values, strict=True):
            node = 0
            for b in key:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                node = nxt
            ends[node] = value
        size = 2 * len(children) + 1024
        base, check, value_of = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        first_free, hint, todo = 257, 257, [(0, 0)]  # states behind 256 have room for any byte in front
        while todo:
            node, state = todo.pop()
            value_of[state] = ends.get(node, -1)
            if not children[node]:
                continue
            bytes_ = np.array(sorted(children[node]), np.int64)
            while check[first_free] >= 0:
                first_free += 1
            low, lo, at = int(bytes_[0]), max(first_free, hint), -1
            if len(bytes_) == 1:
                at = first_free - low - 1
            while at < 0:
                if lo + 1024 > len(check):
                    base, check, value_of = (np.r_[a, np.full(len(a) + 4096, fill, np.int64)] for a, fill in ((base, 0), (check, -1), (value_of, -1)))
                slots = np.flatnonzero(check[lo : lo + 128] < 0) + lo
                tries = slots - low - 1
                fits = tries[(check[tries[:, None] + bytes_[None, :] + 1] < 0).all(1)]
                lo += 128
                if len(fits):
                    at = int(fits[0])
                    hint = max(hint, at + low + 1 - 256)
            if at + 512 > len(check):
                base, check, value_of = (np.r_[a, np.full(len(a) + 4096, fill, np.int64)] for a, fill in ((base, 0), (check, -1), (value_of, -1)))
            base[state] = at
            check[at + bytes_ + 1] = state
            todo += [(children[node][int(b)], at + int(b) + 1) for b in bytes_]
        # room behind the last state, so that no byte leads out of the arrays
        base, check, value_of = (np.r_[a, np.full(257, fill, np.int64)] for a, fill in ((base, 0), (check, -1), (value_of, -1)))
        # plain lists are read faster, one by one, than arrays
        self.base, self.check, self.value = base.tolist(), check.tolist(), value_of.tolist()

    def prefixes(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of each key that data has at start."""
        base, check, value, s = self.base, self.check, self.value, 0
        for at in range(start, len(data)):
            t = base[s] + data[at] + 1
            if check[t] != s:
                return
            s = t
            if value[s] >= 0:
                yield at + 1, value[s]


class Codec:
    def __init__(self, path: str):
        self.pieces = read_model(path)
        usable = [i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER) and p]
        self.trie = DoubleArray([self.pieces[i][0].encode() for i in usable], usable)
        self.score = [s for _, s, _ in self.pieces]
        self.longest = max((len(self.pieces[i][0].encode()) for i in usable), default=1)
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        self.floor = min((self.score[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", self.pieces[i][0]) for i in usable)
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of a marked text; among equals, the one whose last piece starts first."""
        data = text.encode("utf-8", "replace")
        n = len(data)
        best, came, by = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        # the trie is walked here and not by prefixes(): most of the time of an encoding goes by in this loop
        base, check, value, score, floor, longest = self.trie.base, self.trie.check, self.trie.value, self.score, self.floor, self.longest
        at = 0
        while at < n:
            b = data[at]
            after = at + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            here, single, state, end = best[at], False, 0, at
            for b in data[at : at + longest]:
                t = base[state] + b + 1
                if check[t] != state:
                    break
                state = t
                end += 1
                i = value[t]
                if i >= 0:
                    total = here + score[i]
                    if total > best[end]:
                        best[end], came[end], by[end] = total, at, i
                    if end == after:
                        single = True
            if not single and here + floor > best[after]:
                best[after], came[after], by[after] = here + floor, at, -1
            at = after
        out: list[int] = []
        while n:
            at, i = came[n], by[n]
            if i >= 0:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in reversed(data[at:n])]
            else:
                out.append(self.unknown)
            n = at
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        if not text:
            return b""
        if not self.by_word:
            return np.asarray(self.viterbi(MARK + text.replace(" ", MARK)), "<u4").tobytes()
        # words are cut in front of a run of markers; the dummy prefix marks the first
        words = text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text else None
        if words is None:
            words = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        else:
            words = [MARK + w for w in words]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            ids = self.viterbi(w)
            known[w] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, words))

    def decode(self, ids) -> str:
        """Text of ids: bytes are joined before they are read, markers become blanks, the dummy prefix goes."""
        out = bytearray()
        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                out.append(int(piece[3:5], 16))
            elif kind == UNKNOWN:
                out += " ⁇ ".encode()
            elif kind != CONTROL:
                out += piece.encode()
        return out.decode("utf-8", "replace").replace(MARK, " ")[1:]


@lru_cache(maxsize=1)
def loaded(path: str) -> Codec:
    """One codec a worker process: what it remembers serves later tasks."""
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of ints) of each whole text."""
    return _mapped(docs, path or default_model(), "doc_id long, ids array<int>", lambda c, ids: [pa.array(ids, pa.list_(pa.int32()))])


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of doc_id, ids."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return text_batches(rows).select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, n_bytes (ids of byte pieces), ids_crc32 and whether the ids decode to the text."""
    kinds = "doc_id long, n_ids long, n_bytes long, ids_crc32 long, round_trip boolean"
    return _mapped(docs, path or default_model(), kinds, None)


def _mapped(docs: DataFrame, path: str, schema: str, columns) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        is_byte = np.array([kind == BYTE for _, _, kind in codec.pieces], bool)
        text_of = np.array([p.encode() if kind != BYTE else bytes([int(p[3:5], 16)]) for p, _, kind in codec.pieces], object)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            packed = [codec.packed(t) for t in texts]
            ids = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
            if columns:
                made = columns(codec, ids)
            else:
                back = [b"".join(text_of[i].tolist()).decode("utf-8", "replace").replace(MARK, " ")[1:] == t for i, t in zip(ids, texts, strict=True)]
                made = [pa.array([len(i) for i in ids], pa.int64()), pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()), pa.array([zlib.crc32(p) for p in packed], pa.int64()), pa.array(back, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[f.split()[0] for f in schema.split(", ")])

    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
