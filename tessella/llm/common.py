"""Shared helpers: table reads, scratch tables in the cluster's shared folder, bounded samples and broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, owned

__all__ = ["Scratch", "crc_mod", "labelled_ids", "least_by_hash", "let", "once", "owned", "sized", "table", "text_batches"]

#: Bytes of a side that is broadcast, as Spark holds its rows; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Bytes of a row in a broadcast relation besides its fields (header, pointers, hash slot), about.
ROW_BYTES = 40

#: Rows and bytes of an Arrow batch of whole texts: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded for rows that hold whole texts or token sets.

    The default of 10,000 rows would put gigabytes of long texts into one batch. Spark reads
    these settings when a plan runs, so they stay in the session; they change no result.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH_ROWS, int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")))))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def sized(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it takes at most BROADCAST_BYTES, by count; as it is otherwise (the join then shuffles).

    df has to be cheap to count: a scratch table or a bounded sample. Strings and arrays count by their lengths.
    """
    lengths = [F.octet_length(f.name) if f.dataType.simpleString() in ("string", "binary") else F.size(f.name) * 16 for f in df.schema if f.dataType.simpleString()[:5] in ("strin", "binar", "array")]
    row, most = ROW_BYTES + 8 * len(df.columns), BROADCAST_BYTES
    some = df.limit(most // row + 1)  # what is larger need not be counted to its end
    held = sum((F.coalesce(n, F.lit(0)) for n in lengths), F.lit(row)).cast("long")
    return F.broadcast(df) if (some.agg(F.sum(held)).first()[0] or 0) <= most else df


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, whatever the optimizer does with projections."""
    return F.transform(F.array(value), body)[0]


def least_by_hash(rows: DataFrame, key: Column, n: int, *ties: str) -> DataFrame:
    """The n rows with the least key, a 64-bit hash.

    Rows are counted first and filtered by a bound of the hash that about 2n of them pass,
    so a task sends its share of those on, not n rows each. Where too few pass (equal hashes
    of repeated rows), all rows are ordered.
    """
    total = rows.count()
    if total > 4 * n:
        some = rows.where(key < F.lit(-(2**63) + 2**64 * 2 * n // total))
        if some.limit(n).count() == n:
            rows = some
    return rows.orderBy(key, *ties).limit(n)


def labelled_ids(labels: DataFrame, label: str, limit: int, keep: Column | None = None) -> DataFrame:
    """At most ``limit`` (doc_id, label) rows, the smallest by a hash of the id: the documented bound of every fit here.

    Null ids and labels are left out; an id labelled more than once takes its largest label.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return least_by_hash(rows, F.xxhash64("doc_id"), limit, "doc_id")


def once(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per doc_id (the least by the columns), so that repeated ids cannot widen a bounded sample."""
    return rows.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("_r")).select("doc_id", "_r.*")
