"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a folder of our own is taken on a local master only: on a cluster
    each executor would write to its own disk, and a later read would find a part of the rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = getattr(spark, "_tessella_scratch", None)
        if not found:
            found = spark._tessella_scratch = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return found.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    Writing a table cuts its lineage: a lost executor costs the tasks it ran,
    never a recomputation of earlier stages, and no copy is machine-local.

    A result that is returned lazily still reads some of its tables. They go when the
    enclosing ``owned`` block ends, when ``close`` is called, or when the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._path, self._conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        _open.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _remove(self, path: str) -> None:
        found = self._path(path)
        found.getFileSystem(self._conf).delete(found, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def close(self) -> None:
        """Removes all tables; what was returned lazily over them can no longer be read."""
        self._remove(self.root)
        if self in _open:
            _open.remove(self)


#: Scratches whose tables are still there.
_open: list[Scratch] = []


@contextlib.contextmanager
def owned() -> Iterator[None]:
    """Whatever scratch tables the block makes are removed at its end: write what is needed of its results inside it."""
    before = len(_open)
    try:
        yield
    finally:
        for scratch in _open[before:]:
            scratch.close()


@atexit.register
def _leave() -> None:
    for scratch in list(_open):
        with contextlib.suppress(Exception):  # the JVM may be gone
            scratch.close()
