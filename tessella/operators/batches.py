"""Arrow batches of images as numpy views: no Python object per pixel, and output in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Pixels of an output batch, about.
PIXELS = 1 << 20


def views(column: pa.Array) -> list[np.ndarray | None]:
    """The arrays of a list column; null elements are NaN, null lists None."""
    flat, ends = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), np.asarray(column.offsets)
    there = column.is_valid().to_pylist()
    return [flat[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], there, strict=True)]


def lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """A list column of arrays, None as null."""
    ends = np.cumsum([0, *(0 if a is None else a.size for a in arrays)]).astype(np.int32)
    flat = np.concatenate([a.ravel() for a in arrays if a is not None] or [np.empty(0)]).astype(np.float64, copy=False)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([a is None for a in arrays], pa.bool_()) if len(arrays) else None)


def schema_of(kind: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(kind))


class Rows:
    """Rows (dicts) that become batches as soon as their arrays hold PIXELS numbers."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: dict) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += sum(v.size for v in row.values() if isinstance(v, np.ndarray)) + 64
        if self.held >= PIXELS:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        cols = []
        for f in self.schema:
            values = [r.get(f.name) for r in self.rows]
            cols.append(lists(values) if any(isinstance(v, np.ndarray) for v in values) else pa.array(values, f.type))
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays(cols, schema=self.schema)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield self.batch()


def mapped(images: DataFrame, key: str, arrays: tuple[str, ...], fn: Callable, kind: str) -> DataFrame:
    """fn(*arrays as h x w) of each row (key, h, w, arrays), one pass and no shuffle; its dict and the key make a row of kind.

    Rows whose arrays do not have h * w numbers give no row.
    """

    schema = schema_of(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            keys, hs, ws = (batch.column(k).to_pylist() for k in range(3))
            data = [views(batch.column(3 + k)) for k in range(len(arrays))]
            for img, h, w, *xs in zip(keys, hs, ws, *data, strict=True):
                if h and w and all(x is not None and x.size == h * w for x in xs):
                    yield from out.add({key: img, **fn(*(x.reshape(h, w) for x in xs))})
        yield from out.rest()

    cols = [F.col(key).cast("long"), F.col("h").cast("int"), F.col("w").cast("int"), *[F.col(a).cast("array<double>") for a in arrays]]
    return images.select(*cols).mapInArrow(run, kind)
