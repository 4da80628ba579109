"""Operator 6, exact top-k search: norm-sorted inner products with rotated partial sums.

Vectors become integers (floor(scale * x)). Candidates are dealt into partitions by
descending length and written with their lengths. JOB_QUERIES queries are answered at
once, in blocks of QUERY_BLOCK: first against the FIRST partitions, the longest vectors,
which sets their thresholds (the k-th score so far); then against the others, of which the
scan reads those only that are long enough for a query to reach its threshold - a filter
that Parquet's statistics answer. Within a partition, a query is done with once its length
times the longest length left stays under its threshold; other pairs run through partial
sums over coordinates rotated by the eigenvectors of the Gram matrix of all vectors (largest
first), and are dropped when the sum so far plus the product of both residual lengths
(Cauchy-Schwarz) stays under the threshold. Only pairs that pass get their exact integer
product. Every bound has a slack above rounding errors, so results are exact.

What a task or the driver holds is bounded by JOB_QUERIES and the dimension.

Defined results: rows with null ids, null vectors, or null or non-finite components
take no part, nor those that scaling makes infinite; an id that is repeated counts once,
with the least of its vectors; empty vectors are zero vectors; vectors of fewer components
are filled up with zeros; ties go to the smaller id; with fewer candidates than k a query
has as many rows; products that do not fit into 64 bits are ranked and given as the end of
their range; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K, SCALE = 20, 64
#: Queries of a job and of a block; partitions that set a job's thresholds.
JOB_QUERIES, QUERY_BLOCK, FIRST = 32_768, 4096, 4
#: Rows of candidates that are multiplied at once, and pairs of a block that wait before they are cut to the best k.
ROWS, WAITING = 1024, 250_000
#: Candidates of a partition, about.
PARTITION_ROWS = 20_000
_FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (whole numbers as doubles) and norm of the rows that take part."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(scale)
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # beyond, doubles are whole

    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.transform("embedding", whole).alias("v"))
    odd = F.exists("v", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    one = rows.where(~F.coalesce(odd, F.lit(True))).groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets)
    flat, n = np.asarray(column.flatten(), np.float64), len(column)
    if n and (np.diff(ends) == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim))
    for i, (a, b) in enumerate(zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix of all vectors, by falling eigenvalue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim)
            gram += m.T @ m
        at = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(gram.ravel())], names=["at", "x"])

    parts = vectors.select("v").mapInArrow(run, "at long, x double")
    rows = parts.groupBy("at").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(dim * dim)
    for r in rows:
        gram[r["at"]] = r["x"]
    gram = gram.reshape(dim, dim)
    if not np.isfinite(gram).all():
        return np.eye(dim)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


class Best:
    """The best k (score, id) of each query so far, with thresholds."""

    def __init__(self, n: int, k: int):
        self.k, self.q, self.id, self.s = k, [], [], []
        self.least, self.last, self.waiting = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max), 0

    def add(self, q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        self.q.append(q)
        self.id.append(ids)
        self.s.append(s)
        self.waiting += len(q)
        if self.waiting > WAITING:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, s = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.q, self.id, self.s))
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.searchsorted(q, q, side="left")
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        q, ids, s, rank = q[keep], ids[keep], s[keep], rank[keep]
        full = rank == self.k - 1
        better = s[full] >= self.least[q[full]]
        at = q[full][better]
        self.least[at], self.last[at] = s[full][better], ids[full][better]
        self.q, self.id, self.s, self.waiting = [q], [ids], [s], 0
        return q, ids, s


class Queries:
    def __init__(self, ids: np.ndarray, m: np.ndarray, turn: np.ndarray):
        self.ids, self.m = ids, m
        self.turned = m @ turn
        self.levels = sorted({max(1, len(turn) * i // 4) for i in (1, 2, 3)} - {len(turn)})
        self.rest = {d: np.sqrt((self.turned[:, d:] ** 2).sum(1)) for d in self.levels}
        self.norm = np.sqrt((m**2).sum(1))


def _exact(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer products of rows of c with the same rows of q, beyond what doubles hold exactly."""
    if len(c) and np.sqrt((c**2).sum(1)).max() * np.sqrt((q**2).sum(1)).max() < 2**62:
        return np.einsum("ij,ij->i", c.astype(np.int64), q.astype(np.int64))
    top = 2**63 - 1
    return np.array([max(-top, min(top, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for x, y in zip(c, q, strict=True)], np.int64)


def search(bests: list[Best], blocks: list[Queries], turn: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
    """Offers the candidates m, sorted by falling length, to the best of each block of queries."""
    for lo in range(0, len(m), ROWS):
        c, cid = m[lo : lo + ROWS], ids[lo : lo + ROWS]
        with np.errstate(over="ignore"):
            longest = float(np.sqrt((c**2).sum(1)).max())
        turned = c @ turn if np.isfinite(longest) else None
        for best, queries in zip(bests, blocks, strict=True):
            _offer(best, queries, c, cid, longest, turned)


def _offer(best: Best, queries: Queries, c: np.ndarray, cid: np.ndarray, longest: float, turned: np.ndarray | None) -> None:
    slack = 1e-9 * queries.norm * longest + 1e-6
    if turned is None or not np.isfinite(slack).all():  # lengths beyond doubles have no bounds
        for i in range(len(c)):
            s = _exact(np.broadcast_to(c[i], queries.m.shape), queries.m)
            j = np.flatnonzero(queries.ids != cid[i])
            best.add(j, np.full(len(j), cid[i]), s[j])
        return
    live = np.flatnonzero(queries.norm * longest + slack >= best.least)
    if not len(live):
        return
    exact = float(queries.norm[live].max()) * longest < 2**52
    least = (best.least - slack)[live]
    done, total, open_ = 0, np.zeros((len(c), len(live))), None
    for d in queries.levels:
        total += turned[:, done:d] @ queries.turned[live, done:d].T
        done = d
        rest = np.sqrt((turned[:, d:] ** 2).sum(1))
        open_ = total + rest[:, None] * queries.rest[d][live][None, :] >= least[None, :]
        used = open_.any(0)
        if not used.all():  # queries that no candidate of this block can serve
            live, least, total, open_ = live[used], least[used], total[:, used], open_[:, used]
        if not len(live):
            return
        if open_.sum() * 16 < open_.size:
            break
    if exact and (open_ is None or open_.sum() * 8 > open_.size):
        s = c @ queries.m[live].T
        hit = (s > best.least[live]) | ((s == best.least[live]) & (cid[:, None] <= best.last[live]))
        i, j = np.nonzero(hit & (cid[:, None] != queries.ids[live][None, :]))
        best.add(live[j], cid[i], s[i, j].astype(np.int64))
        return
    i, j = np.nonzero(open_) if open_ is not None else np.nonzero(np.ones((len(c), len(live)), bool))
    for at in range(0, len(i), 65536):
        a, b = i[at : at + 65536], live[j[at : at + 65536]]
        if exact:
            s = np.einsum("ij,ij->i", c[a], queries.m[b])
            hit = (s > best.least[b]) | ((s == best.least[b]) & (cid[a] <= best.last[b]))
        else:  # thresholds are rounded here, so ties with them stay in
            s = _exact(c[a], queries.m[b])
            hit = s >= best.least[b] - slack[b]
        hit &= cid[a] != queries.ids[b]
        best.add(b[hit], cid[a][hit], s[hit].astype(np.int64))


def _answered(rows: DataFrame, ids: np.ndarray, m: np.ndarray, turn: np.ndarray, k: int, least: np.ndarray, last: np.ndarray) -> DataFrame:
    """(query_id, vec_id, score) of the best k of each partition of rows (vec_id, v) that reach the thresholds."""
    dim = m.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = [slice(lo, lo + QUERY_BLOCK) for lo in range(0, len(ids), QUERY_BLOCK)]
        blocks, bests = [Queries(ids[c], m[c], turn) for c in cuts], []
        for c, queries in zip(cuts, blocks, strict=True):
            bests.append(Best(len(queries.ids), k))
            bests[-1].least, bests[-1].last = least[c].copy(), last[c].copy()
        for batch in batches:
            search(bests, blocks, turn, np.asarray(batch.column(0), np.int64), _matrix(batch.column(1), dim))
        for best, queries in zip(bests, blocks, strict=True):
            q, vec, s = best.cut()
            for lo in range(0, len(q), 100_000):
                cols = [queries.ids[q[lo : lo + 100_000]], vec[lo : lo + 100_000], s[lo : lo + 100_000]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["query_id", "vec_id", "score"])

    return rows.select("vec_id", "v").mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    whole = scratch.save(integers(vectors, scale), "integers")
    size = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.count_if(is_query).alias("asked")).first()
    n, dim = size["n"], max(1, size["dim"] or 0)
    turn = rotation(whole, dim)
    # longest first; equal lengths are told apart by id, so a common vector is dealt over many partitions
    parts = max(1, -(-n // PARTITION_ROWS))
    dealt = whole.repartitionByRange(parts, F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("norm").desc(), "vec_id")
    dealt = scratch.save(dealt.withColumn("part", F.spark_partition_id()), "dealt")
    # queries by a hash into jobs that have half their bound on average; a job's queries lie together
    jobs = 1 if size["asked"] <= JOB_QUERIES else -(-2 * size["asked"] // JOB_QUERIES)
    asked = whole.where(is_query).select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(jobs)).alias("job"))
    asked = scratch.save(asked if jobs == 1 else asked.repartitionByRange(jobs, "job").sortWithinPartitions("job"), "asked")
    for job in range(jobs):
        rows = asked.where(F.col("job") == job).select("vec_id", "v").toArrow()
        if not len(rows):
            continue
        ids, m = np.asarray(rows["vec_id"], np.int64), _matrix(rows["v"], dim)
        least, last = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
        first = scratch.save(_answered(dealt.where(F.col("part") < FIRST), ids, m, turn, k, least, last), f"found/{job}-first")
        if parts <= FIRST and dealt.where(F.col("part") >= FIRST).isEmpty():
            continue
        place = {int(q): i for i, q in enumerate(ids)}
        for r in _ranked(first, k).where(F.col("rank") == k).select("query_id", "vec_id", "score").toArrow().to_pylist():
            least[place[r["query_id"]]], last[place[r["query_id"]]] = r["score"], r["vec_id"]
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((m**2).sum(1))
            reach = np.where(norm > 0, (least - 1e-6) / np.maximum(norm, 1e-300), 0)
        low = float(np.min(reach)) * (1 - 1e-6) if np.isfinite(reach).all() else -1.0
        rest = dealt.where((F.col("part") >= FIRST) & (F.col("norm") >= (low if low > 0 else -1.0)))
        scratch.save(_answered(rest, ids, m, turn, k, least, last), f"found/{job}-rest")
    if size["asked"]:
        found = spark.read.schema(_FOUND).option("recursiveFileLookup", "true").parquet(f"{scratch.root}/found")
    else:
        found = spark.createDataFrame([], _FOUND)
    scratch.drop("integers", "dealt", "asked")
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = {
    "op6_topk_search": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
                   where embedding is not null and list_count(embedding) = len(embedding)
                     and len(list_filter(embedding, lambda x: not isfinite(cast(x as double)))) = 0),
        s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
        r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as "rank", vec_id, score from s)
        select query_id, "rank", vec_id, score from r where "rank" <= 20
    """
}
