"""Distances between feature sets and contrastive losses, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import let, r6, total
from ..operators.batches import lists, views
from ..sources.views import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))


def dot(a, b):
    return total(F.zip_with(a, b, lambda x, y: x * y))


def powers(rows: DataFrame, dim: int) -> DataFrame:
    """i, j, the sum of x_i x_j and the array of sums of x_i x_j x_k over all rows' vectors x = e / sqrt(dim).

    A task sums its vectors in Arrow batches and sends dim * dim rows on, however many vectors it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, three = np.zeros(dim * dim), np.zeros((dim * dim, dim))
        for batch in batches:
            for x in np.array_split(np.array(views(batch.column(0))).reshape(-1, dim) / dim**0.5, max(1, len(batch) // 512)):
                both = (x[:, :, None] * x[:, None, :]).reshape(len(x), dim * dim)
                two += both.sum(0)
                three += both.T @ x
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(two), lists(list(three))], names=["i", "j", "p2", "p3"])

    parts = rows.where(F.size("e") == dim).select("e").mapInArrow(run, "i int, j int, p2 double, p3 array<double>")
    return parts.groupBy("i", "j").agg(F.sum("p2").alias("p2"), F.array(*[F.sum(F.get("p3", F.lit(k))) for k in range(dim)]).alias("p3"))


def kid_of(x: DataFrame, y: DataFrame, dim: int) -> DataFrame:
    """Unbiased squared discrepancy of two sets (e) under the cubic kernel, without pairs.

    (x.y / d + 1)^3 is a sum over tensor powers, so the sums over all pairs are squared
    norms of summed powers: one aggregation of d^3 numbers, not n * m kernel values.
    """

    def sums(rows: DataFrame, s: str) -> DataFrame:
        return powers(rows, dim).select("i", "j", F.col("p2").alias(f"{s}2"), F.col("p3").alias(f"{s}3"))

    def singles(rows: DataFrame, s: str) -> DataFrame:
        norm = dot(F.col("e"), F.col("e")) / dim + 1
        means = [F.sum(F.get("e", F.lit(k))) for k in range(dim)]
        return rows.agg(F.count("*").cast("double").alias(f"n_{s}"), F.sum(F.pow(norm, F.lit(3.0))).alias(f"d_{s}"), F.array(*means).alias(f"m_{s}"))

    both = sums(x, "x").join(sums(y, "y"), ["i", "j"])
    inner = lambda a, b: dot(F.col(a), F.col(b))
    cubes = both.agg(*[F.sum(inner(f"{a}3", f"{b}3")).alias(f"c3_{a}{b}") for a, b in ("xx", "yy", "xy")], *[F.sum(F.col(f"{a}2") * F.col(f"{b}2")).alias(f"c2_{a}{b}") for a, b in ("xx", "yy", "xy")])
    rows = cubes.join(F.broadcast(singles(x, "x"))).join(F.broadcast(singles(y, "y")))  # one row each
    n, m = F.col("n_x"), F.col("n_y")

    def kernel_sum(a: str, b: str):
        return F.col(f"c3_{a}{b}") + 3 * F.col(f"c2_{a}{b}") + 3 * dot(F.col(f"m_{a}"), F.col(f"m_{b}")) / dim + F.col(f"n_{a}") * F.col(f"n_{b}")

    value = (kernel_sum("x", "x") - F.col("d_x")) / (n * (n - 1)) + (kernel_sum("y", "y") - F.col("d_y")) / (m * (m - 1)) - 2 * kernel_sum("x", "y") / (n * m)
    return rows.select(value.alias("kid"), n.cast("long").alias("n_a"), m.cast("long").alias("n_b"))


#: Subsets of the estimator, and vectors of a subset at most.
SUBSETS, SUBSET_SIZE = 10, 100


def kid_of_subsets(x: DataFrame, y: DataFrame, subsets: int = SUBSETS, size: int = SUBSET_SIZE) -> DataFrame:
    """kid, n_a, n_b: the mean discrepancy of subsets of both sets (vec_id, e), NaN if one has fewer than two vectors.

    A subset is the first vectors by a hash of id and subset, in any engine the same. A bound of
    the hash is passed by a few times as many as are needed; those are ranked.
    """
    spark, n, m = x.sparkSession, x.count(), y.count()
    s = min(size, n, m)
    if s < 2:
        return spark.createDataFrame([(float("nan"), n, m)], "kid double, n_a long, n_b long")

    def chosen(rows: DataFrame, total: int, side: int) -> DataFrame:
        keyed = rows.select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(subsets - 1))).alias("subset"))
        keyed = keyed.withColumn("key", F.md5(F.concat_ws(":", F.col("vec_id").cast("string"), F.col("subset").cast("string"))))
        if total > 8 * s + 200:  # so many more pass than are needed that fewer than s are out of the question
            keyed = keyed.where(F.col("key") < f"{int((4 * s + 100) / total * 2**32):08x}")
        rank = F.row_number().over(Window.partitionBy("subset").orderBy("key", "vec_id"))
        return keyed.withColumn("rank", rank).where(F.col("rank") <= s).select("subset", F.lit(side).alias("side"), "rank", "e")

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("rank", "ascending")])
        e = np.array(views(rows["e"].combine_chunks()))
        k = (e @ e.T / e.shape[1] + 1) ** 3
        inside = [(b.sum() - np.trace(b)) / (s * (s - 1)) for b in (k[:s, :s], k[s:, s:])]
        return pa.table({"v": pa.array([sum(inside) - 2 * k[:s, s:].mean()])})

    both = chosen(x, n, 0).unionByName(chosen(y, m, 1))
    values = both.groupBy("subset").applyInArrow(one, "v double")
    return values.agg(F.avg("v").alias("kid"), F.lit(n).cast("long").alias("n_a"), F.lit(m).cast("long").alias("n_b"))


@query(
    "kid",
    """with f as (select vec_id, label, list_transform(embedding, lambda v: v::double) as e from embeddings where label in (0, 1)),
    k as (select a.label as la, b.label as lb, a.vec_id = b.vec_id as same, pow(list_dot_product(a.e, b.e) / 64 + 1, 3) as k from f a, f b),
    n as (select count(*) filter (label = 0) as n, count(*) filter (label = 1) as m from f)
    select round(sum(k) filter (la = 0 and lb = 0 and not same) / any_value(n * (n - 1)) + sum(k) filter (la = 1 and lb = 1 and not same) / any_value(m * (m - 1))
      - 2 * sum(k) filter (la = 0 and lb = 1) / any_value(n * m), 6) + 0.0 as kid, any_value(n) as n_a, any_value(m) as n_b from k, n""",
)
def kid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return kid_of(rows.where("label = 0"), rows.where("label = 1"), 64).select(r6(F.col("kid")).alias("kid"), "n_a", "n_b")


@query(
    "kid_subsets",
    """with f as (select vec_id, label, list_transform(embedding, lambda v: v::double) as e from embeddings where label in (0, 1)),
    n as (select count(*) filter (label = 0) as n, count(*) filter (label = 1) as m, least(100, count(*) filter (label = 0), count(*) filter (label = 1)) as s from f),
    k as (select r, label, vec_id, e, row_number() over (partition by r, label order by md5(vec_id || ':' || r), vec_id) as pos from f, range(10) t(r)),
    c as (select r, label, vec_id, e from k, n where pos <= s),
    p as (select a.r, a.label as la, b.label as lb, a.vec_id = b.vec_id as same, pow(list_dot_product(a.e, b.e) / 64 + 1, 3) as k from c a join c b using (r)),
    v as (select r, sum(k) filter (la = 0 and lb = 0 and not same) / any_value(s * (s - 1)) + sum(k) filter (la = 1 and lb = 1 and not same) / any_value(s * (s - 1)) - 2 * sum(k) filter (la = 0 and lb = 1) / any_value(s * s) as v from p, n group by r)
    select round(avg(v), 6) + 0.0 as kid, (select n from n) as n_a, (select m from n) as n_b from v""",
)
def kid_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return kid_of_subsets(rows.where("label = 0"), rows.where("label = 1")).select(r6(F.col("kid")).alias("kid"), "n_a", "n_b")


def moments(rows: DataFrame) -> DataFrame:
    """i, j, sample covariance of all dimension pairs i <= j, and the mean of i, per label."""
    one = rows.select("label", F.posexplode("e").alias("i", "v"), "e")
    two = one.select("label", "i", "v", F.posexplode("e").alias("j", "u")).where("i <= j")
    return two.groupBy("label", "i", "j").agg(F.covar_samp("v", "u").alias("cov"), F.avg("v").alias("mean"))


PAIRS = """with f as (select vec_id, label::int as label, unnest(embedding)::double as v, (generate_subscripts(embedding, 1) - 1)::int as i from embeddings where label in (0, 1))"""


@query("fid_moments", PAIRS + " select a.label, a.i, b.i as j, round(covar_samp(a.v, b.v), 6) + 0.0 as cov, round(avg(a.v), 6) + 0.0 as mean from f a join f b on a.vec_id = b.vec_id and a.i <= b.i group by 1, 2, 3")
def fid_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = moments(features(spark, sf_dir).where("label in (0, 1)"))
    return out.select("label", "i", "j", r6(F.col("cov")).alias("cov"), r6(F.col("mean")).alias("mean"))


@query(
    "fid_diag",
    PAIRS + """, m as (select label, i, avg(v) as mu, var_samp(v) as s from f group by 1, 2)
    select round(sum((a.mu - b.mu) * (a.mu - b.mu) + a.s + b.s - 2 * sqrt(a.s * b.s)), 6) as fid_diag from m a join m b on a.i = b.i and a.label = 0 and b.label = 1""",
)
def fid_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frechet distance of the diagonal parts alone."""
    one = features(spark, sf_dir).where("label in (0, 1)").select("label", F.posexplode("e").alias("i", "v"))
    m = one.groupBy("label", "i").agg(F.avg("v").alias("mu"), F.var_samp("v").alias("s"))
    side = lambda k, n: m.where(F.col("label") == k).select("i", F.col("mu").alias(f"mu{n}"), F.col("s").alias(f"s{n}"))
    gap = F.pow(F.col("mu0") - F.col("mu1"), F.lit(2.0)) + F.col("s0") + F.col("s1") - 2 * F.sqrt(F.col("s0") * F.col("s1"))
    return side(0, 0).join(side(1, 1), "i").agg(r6(F.sum(gap)).alias("fid_diag"))


def frechet(mu1, cov1, mu2, cov2) -> float:
    """Frechet distance of two Gaussians, by symmetric eigendecompositions."""

    def root(m):
        w, v = np.linalg.eigh((m + m.T) / 2)
        return (v * np.sqrt(np.clip(w, 0, None))) @ v.T

    r = root(cov1)
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(r @ cov2 @ r), 0, None)).sum()
    return float(((mu1 - mu2) ** 2).sum() + np.trace(cov1) + np.trace(cov2) - 2 * cross)


def fid_of(rows: DataFrame, dim: int = 64) -> float:
    """The full distance of labels 0 and 1: moments are aggregated by Spark, dim * dim numbers a set reach the driver."""
    mu, cov = np.zeros((2, dim)), np.zeros((2, dim, dim))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return float("nan")
    for r in moments(rows).collect():
        cov[r["label"], r["i"], r["j"]] = cov[r["label"], r["j"], r["i"]] = r["cov"]
        mu[r["label"], r["i"]] = r["mean"]
    return frechet(mu[0], cov[0], mu[1], cov[1])


@query("fid_full")
def fid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(fid_of(features(spark, sf_dir).where("label in (0, 1)")),)], "fid double")


@query("fid_kid")
def fid_kid(spark: SparkSession, sf_dir: str, max_items: int = 500) -> DataFrame:
    """Both distances of the first max_items vectors (0: all) of two labels, with the sizes of both sets."""
    rows = features(spark, sf_dir)
    sides = [rows.where(F.col("label") == k) for k in (0, 1)]
    if max_items:
        sides = [r.orderBy("vec_id").limit(max_items) for r in sides]
    fid = fid_of(sides[0].unionByName(sides[1]))
    return kid_of_subsets(*sides).select(F.lit(fid).alias("fid"), "kid", "n_a", "n_b")


@query(
    "l2_normalize",
    """with f as (select vec_id, list_transform(embedding, lambda v: v::double) as e from embeddings), n as (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from f)
    select vec_id, (generate_subscripts(e, 1) - 1)::int as i, round(unnest(e) / (norm + 1e-7), 6) + 0.0 as v from n""",
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = let(F.sqrt(dot(F.col("e"), F.col("e"))), lambda n: F.transform("e", lambda v: v / (n + 1e-7)))
    return features(spark, sf_dir).select("vec_id", F.posexplode(unit).alias("i", "v")).select("vec_id", "i", r6(F.col("v")).alias("v"))


@query(
    "patch_nce",
    """with f as (select vec_id, vec_id // 32 as grp, list_transform(embedding, lambda v: v::double) as e from embeddings),
    u as (select vec_id, grp, list_transform(e, lambda v: v / (sqrt(list_dot_product(e, e)) + 1e-7)) as q, list_transform(e, lambda v: v * v * v) as c from f),
    k as (select vec_id, grp, q, list_transform(c, lambda v: v / (sqrt(list_dot_product(c, c)) + 1e-7)) as k from u),
    l as (select a.vec_id, list_dot_product(a.q, a.k) / 0.07 as pos, case when a.vec_id = b.vec_id then -10 / 0.07 else list_dot_product(a.q, b.k) / 0.07 end as l from k a join k b using (grp)),
    m as (select vec_id, any_value(pos) as pos, greatest(max(l), any_value(pos)) as top from l group by 1)
    select l.vec_id, round(ln(sum(exp(l - top)) + exp(any_value(m.pos) - any_value(top))) + any_value(top) - any_value(m.pos), 6) + 0.0 as loss from l join m using (vec_id) group by 1""",
)
def patch_nce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrastive loss of each query patch against the keys of its image (32 patches an image)."""
    rows = features(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 32).alias("grp"), "e")
    unit = lambda e: let(e, lambda d: let(F.sqrt(dot(d, d)), lambda n: F.transform(d, lambda v: v / (n + 1e-7))))
    both = rows.select("vec_id", "grp", unit(F.col("e")).alias("q"), unit(F.transform("e", lambda v: v * v * v)).alias("k"))
    keys = both.groupBy("grp").agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "k")).alias("keys"))
    pos = dot(F.col("q"), F.col("k")) / 0.07
    logits = F.transform("keys", lambda s: F.when(s["id"] == F.col("vec_id"), -10 / 0.07).otherwise(dot(F.col("q"), s["k"]) / 0.07))
    joined = both.join(keys, "grp").select("vec_id", pos.alias("pos"), logits.alias("l"))
    loss = let(F.greatest(F.array_max("l"), F.col("pos")), lambda t: F.ln(total(F.transform("l", lambda v: F.exp(v - t))) + F.exp(F.col("pos") - t)) + t - F.col("pos"))
    return joined.select("vec_id", r6(loss).alias("loss"))


Z = "z as (select event_type, (value - avg(value) over ()) / stddev_pop(value) over () as p from events where value is not null)"


@query(
    "gan_losses",
    f"""with {Z} select event_type, round(avg((p - 1) * (p - 1)), 5) as lsgan_real, round(avg(p * p), 5) as lsgan_fake, round(avg(ln(1 + exp(-abs(p))) + greatest(-p, 0)), 5) as vanilla_real,
    round(avg(ln(1 + exp(-abs(p))) + greatest(p, 0)), 5) as vanilla_fake, round(-avg(p), 5) + 0.0 as wgan_real, round(avg(p), 5) + 0.0 as wgan_fake,
    round(avg(ln(1 + exp(-abs(p))) + greatest(-p, 0)), 5) as softplus_real, round(avg(ln(1 + exp(-abs(p))) + greatest(p, 0)), 5) as softplus_fake from z group by event_type""",
)
def gan_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adversarial criteria over standardised predictions, per event type."""
    rows = table(spark, sf_dir, "events").where("value is not null").select("event_type", "value")
    whole = rows.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    p = F.col("p")
    soft = lambda v: F.log1p(F.exp(-F.abs(v))) + F.greatest(v, F.lit(0.0))
    kinds = {"lsgan_real": (p - 1) * (p - 1), "lsgan_fake": p * p, "vanilla_real": soft(-p), "vanilla_fake": soft(p), "wgan_real": -p, "wgan_fake": p, "softplus_real": soft(-p), "softplus_fake": soft(p)}
    z = rows.join(F.broadcast(whole)).select("event_type", ((F.col("value") - F.col("m")) / F.col("s")).alias("p"))
    return z.groupBy("event_type").agg(*[(F.round(F.avg(c), 5) + 0.0).alias(n) for n, c in kinds.items()])
