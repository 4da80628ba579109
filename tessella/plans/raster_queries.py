"""Queries over grids: steps, quality metrics and losses, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster as R
from ..operators import kernels as K
from ..operators import regions
from ..operators.batches import mapped
from ..functions.columns import let, mean, percentile, r6, variance
from ..sources.views import GRIDS_SQL, grids, mirrored_sql, tall, window_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

def H() -> Column:
    return F.col("h")


def W() -> Column:
    return F.col("w")


def D() -> Column:
    return F.col("data")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _mapped(name: str, column: Callable[[], Column], sql: str) -> None:
    """A query that maps each image to an image, in long form."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tall(grids(spark, sf_dir).select("img", "w", column().alias("data")))

    QUERIES[name] = run
    ORACLE[name] = f"with {GRIDS_SQL}, {sql}"


def _filtered(name: str, fn: Callable, sql: str) -> None:
    """Likewise by the numpy plan: fn of the image as h x w."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tall(mapped(grids(spark, sf_dir), "img", ("data",), lambda x: {"w": x.shape[1], "data": fn(x)}, "img long, w int, data array<double>"))

    QUERIES[name] = run
    ORACLE[name] = f"with {GRIDS_SQL}, {sql}"


OUT = "select img, y, x, round(o, 6) + 0.0 as v from"
CLIP = "least(greatest({}, 0.0), 1.0)"


def stats_sql(r: int, source: str = "g") -> str:
    """CTE st(img, y, x, v, m, s2): local mean and variance."""
    return window_sql("win", source, r) + ", st as (select img, y, x, any_value(v) as v, avg(nv) as m, greatest(avg(nv * nv) - avg(nv) * avg(nv), 0.0) as s2 from win group by img, y, x)"


ENL = "enl as (select img, least(greatest(avg(v) * avg(v) / (var_pop(v) + 1e-6), 1.0), 64.0) as enl from g group by img)"
LEE = "m + least(greatest((s2 / (m * m + 1e-6) - 1.0 / enl) / (s2 / (m * m + 1e-6) + 1e-6), 0.0), 1.0) * (v - m)"

_mapped("to_gray01", lambda: R.gray01(F.transform(D(), lambda v: v * 200.0)), f"s as (select img, y, x, v * 200.0 as v from g) {OUT} (select *, case when max(v) over (partition by img) > 1 then v / max(v) over (partition by img) else v end as o from s)")
_mapped("intensity_log1p", lambda: R.intensity(D(), "log1p"), f"s as (select img, y, x, ln(1 + v / 1e-6) as v from g) {OUT} (select *, (v - min(v) over (partition by img)) / (max(v) over (partition by img) - min(v) over (partition by img)) as o from s)")
_mapped("intensity_db", lambda: R.intensity(D(), "db"), f"s as (select img, y, x, 10 * log10(v + 1e-6) as v from g) {OUT} (select *, (v - min(v) over (partition by img)) / (max(v) over (partition by img) - min(v) over (partition by img)) as o from s)")
_mapped("box_mean", lambda: R.box_mean(D(), H(), W(), 7), f"{stats_sql(3)} {OUT} (select *, m as o from st)")
_mapped("box_mean_even", lambda: R.box_mean(D(), H(), W(), 2), f"{stats_sql(1)} {OUT} (select *, m as o from st)")
_mapped("local_variance", lambda: F.transform(R.local_stats(D(), H(), W(), 7), lambda s: s["s2"]), f"{stats_sql(3)} {OUT} (select *, s2 as o from st)")
_mapped("speckle_lee", lambda: R.lee(D(), H(), W(), 7), f"{stats_sql(3)}, {ENL} {OUT} (select *, {CLIP.format(LEE)} as o from st join enl using (img))")
GRAD = f"""ng as (select c.img, c.y, c.x, abs(case when c.x = 0 then r.v - c.v when c.x = 7 then c.v - l.v else (r.v - l.v) / 2 end)
      + abs(case when c.y = 0 then d.v - c.v when c.y = 7 then c.v - u.v else (d.v - u.v) / 2 end) as gr
      from g c left join g l on l.img = c.img and l.y = c.y and l.x = c.x - 1 left join g r on r.img = c.img and r.y = c.y and r.x = c.x + 1
      left join g u on u.img = c.img and u.x = c.x and u.y = c.y - 1 left join g d on d.img = c.img and d.x = c.x and d.y = c.y + 1),
    q as (select img, quantile_cont(gr, 0.95) as p, max(gr) as top from ng group by img)"""
REFINED = f"""{ENL}, {GRAD}, b as (select st.*, enl, case when top > 1e-6 then least(greatest(gr / (p + 1e-6), 0.0), 1.0) else 0.0 end as ed
    from st join enl using (img) join ng using (img, y, x) join q using (img)) {OUT} (select *, {CLIP.format(f"ed * v + (1 - ed) * ({LEE})")} as o from b)"""
_mapped("speckle_refined_lee", lambda: R.refined_lee(D(), H(), W(), 7), f"{stats_sql(3)}, {REFINED}")
_mapped("speckle_bm3d_fallback", lambda: R.refined_lee(D(), H(), W(), 7), f"{stats_sql(3)}, {REFINED}")
_mapped(
    "speckle_gamma_map",
    lambda: R.gamma_map(D(), H(), W(), 7),
    f"""{stats_sql(3)}, {ENL}, a as (select *, s2 / (m * m + 1e-6) as ci, 1.0 / enl as cu from st join enl using (img)),
    b as (select *, (1 + cu) / greatest(ci - cu, 1e-6) as al from a), c as (select *, al - enl - 1 as bb from b)
    {OUT} (select *, {CLIP.format("case when ci > cu * 6 then v when ci > cu then (bb * m + sqrt(greatest(bb * bb * m * m + 4 * al * enl * m * v, 0.0))) / (2 * al + 1e-6) else m end")} as o from c)""",
)
_mapped(
    "speckle_frost",
    lambda: R.frost(D(), H(), W(), 3, 2.0),
    f"""{stats_sql(1)}, f as (select win.img, win.y, win.x, sum(exp(-2.0 * s2 / (m * m + 1e-6) * sqrt(dy * dy + dx * dx)) * nv) / (sum(exp(-2.0 * s2 / (m * m + 1e-6) * sqrt(dy * dy + dx * dx))) + 1e-6) as o
    from win join st using (img, y, x) group by win.img, win.y, win.x) {OUT} (select *, o as oo from f)""",
)
_mapped(
    "outlier_clip",
    lambda: R.clip_outliers(D(), 0.2, 99.8),
    f"""q as (select img, quantile_cont(v, 0.002) as lo, quantile_cont(v, 0.998) as hi from g where v > 0 group by img)
    {OUT} (select *, case when hi - lo < 1e-6 then v else {CLIP.format("(v - lo) / (hi - lo)")} end as o from g join q using (img))""",
)
TONE = """tc as (select i, i / {n}.0 as tx, 1 - pow(1 - pow(i / {n}.0, 0.75), 1.15) as raw from (select range::int as i from range({m}))),
    tone as (select i, tx, (max(raw) over (order by i) - (select min(raw) from tc)) / ((select max(raw) from tc) - (select min(raw) from tc) + 1e-8) as ty from tc)"""


@query("tone_curve", f"with {TONE.format(n=1023, m=1024)} select i, round(tx, 6) as x, round(ty, 6) + 0.0 as y from tone")
def tone_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = spark.range(1).select(R.tone_curve(1024).alias("c")).select(F.posexplode(F.arrays_zip("c.x", "c.y")).alias("i", "p"))
    return both.select("i", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


_mapped(
    "histogram_map",
    lambda: R.map_histogram(D(), 64, R.tone_curve(64)),
    f"""{TONE.format(n=63, m=64)}, hb as (select img, least(floor(v * 64), 63)::int as b, count(*) as c from g group by 1, 2),
    dense as (select i.img, r.range::int as b, coalesce(c, 0) as c from (select distinct img from g) i cross join range(64) r left join hb on hb.img = i.img and hb.b = r.range),
    cdf as (select img, b, sum(c) over (partition by img order by b) / (sum(c) over (partition by img) + 1e-6) as p from dense),
    t as (select *, least(greatest(v * 64 - 0.5, 0.0), 63.0) as t from g), tb as (select *, least(floor(t), 62)::int as b from t),
    rk as (select tb.img, tb.y, tb.x, c0.p + (c1.p - c0.p) * (tb.t - tb.b) as p from tb join cdf c0 on c0.img = tb.img and c0.b = tb.b join cdf c1 on c1.img = tb.img and c1.b = tb.b + 1),
    sg as (select i, tx as x0, ty as y0, lead(tx) over (order by i) as x1, lead(ty) over (order by i) as y1 from tone),
    mp as (select rk.img, rk.y, rk.x, case when p < (select min(ty) from tone) then 0.0 when p >= (select max(ty) from tone) then 1.0 else x0 + (x1 - x0) * (p - y0) / (y1 - y0) end as o
           from rk left join sg on p >= y0 and p < y1)
    {OUT} (select *, o as oo from mp)""",
)
_mapped("normalize_u8", lambda: R.to_u8(D()), f"s as (select * from g) {OUT} (select *, trunc(least(greatest(v, 0.0), 1.0) * 255) as o from s)")
_filtered("laplacian_map", K.laplacian, window_sql("win", "g", 1) + f", l as (select img, y, x, sum(case when abs(dy) + abs(dx) = 1 then nv when dy = 0 and dx = 0 then -4 * nv else 0 end) as o from win group by img, y, x) {OUT} (select *, o as oo from l)")
SAL = window_sql("wz", "g", 2, pad="zero") + """, con as (select img, y, x, greatest(any_value(v) - sum(nv) / 25, 0.0) as c from wz group by img, y, x),
    qs as (select img, greatest(quantile_cont(c, 0.995), 1e-5) as top from con group by img), sal as (select img, y, x, 1 + 3.0 * least(greatest(c / top, 0.0), 1.0) as wt from con join qs using (img))"""
_filtered("saliency_map", K.saliency, f"{SAL} {OUT} (select *, wt as o from sal)")
SHARP = window_sql("w3", "g", 1) + """, sob as (select img, y, x, sum(nv * (case dx when -1 then -1 when 1 then 1 else 0 end) * (case dy when 0 then 2 else 1 end)) as gx,
      sum(nv * (case dy when -1 then -1 when 1 then 1 else 0 end) * (case dx when 0 then 2 else 1 end)) as gy from w3 group by img, y, x),
    sj as (select a.img, a.y, a.x, sum(b.gx * b.gx) / 25 as xx, sum(b.gy * b.gy) / 25 as yy, sum(b.gx * b.gy) / 25 as xy
      from sob a join sob b on a.img = b.img and abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 group by a.img, a.y, a.x),
    shp as (select img, y, x, least(greatest((xx + yy) / (xx + yy + 1.0), 0.0), 1.0) * least(greatest(sqrt((xx - yy) * (xx - yy) + 4 * xy * xy + 1e-12) / (xx + yy + 1e-5), 0.0), 1.0) as sh from sj)"""
_filtered("sharpness_map", K.sharpness, f"{SHARP} {OUT} (select *, sh as o from shp)")
_mapped("flip_horizontal", lambda: R.pixels(H(), W(), lambda y, x, i: F.get(D(), y * W() + (W() - 1 - x))), f"s as (select img, y, 7 - x as x, v from g) {OUT} (select *, v as o from s)")


@query("crop_center", f"with {GRIDS_SQL} select img, y - 2 as y, x - 2 as x, round(v, 6) + 0.0 as v from g where y between 2 and 5 and x between 2 and 5")
def crop_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tall(grids(spark, sf_dir)).where("y between 2 and 5 and x between 2 and 5")
    return rows.select("img", (F.col("y") - 2).alias("y"), (F.col("x") - 2).alias("x"), "v")


@query("side_by_side", f"""with {GRIDS_SQL} select img // 2 as pair, y, x + 8 * (img % 2)::int as x, round(v, 6) + 0.0 as v from g""")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tall(grids(spark, sf_dir))
    return rows.select(F.floor(F.col("img") / 2).alias("pair"), "y", (F.col("x") + 8 * (F.col("img") % 2).cast("int")).alias("x"), "v")


def bad_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grids with planted NaN (img % 7 = 0), infinities (img % 11 = 0) and constant images (img % 13 = 0)."""
    img = F.col("img")
    data = F.transform(D(), lambda v, i: F.when((img % 7 == 0) & (i == 3), float("nan")).when((img % 11 == 0) & (i == 5), float("inf")).when(img % 13 == 0, 0.25).otherwise(v))
    return grids(spark, sf_dir).withColumn("data", data)


BAD = f"""with {GRIDS_SQL}, b0 as (select img, y, x, y * 8 + x as i, v from g),
    b as (select img, y, x, case when img % 7 = 0 and i = 3 then 'nan'::double when img % 11 = 0 and i = 5 then 'inf'::double when img % 13 = 0 then 0.25 else v end as v from b0),
    s as (select *, max(case when isnan(v) then 1 else 0 end) over (partition by img) = 1 as nan, max(v) over (partition by img) as mx from b),
    n as (select img, y, x, nan, case when not nan and mx > 1 then v / mx else v end as v from s),
    f as (select img, y, x, case when isnan(v) then 0.0 when isinf(v) and v > 0 then (case when nan then 3.4028234663852886e38 else 1.0 end) else v end as v from n)"""


@query("nan_guard", BAD + " select img, y, x, v from f where v < 2")
def nan_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels after validation, without those that became the largest float."""
    rows = bad_grids(spark, sf_dir).select("img", "w", R.validated(D()).alias("data")).select("img", "w", F.posexplode("data").alias("i", "v"))
    return rows.where("v < 2").select("img", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), "v")


@query("validate_status", BAD + ", z as (select img, case when sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) < 1e-6 then 'skipped' else 'success' end as status from f where img % 7 <> 0 group by img) select status, count(*) as n from z group by status")
def validate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(R.is_constant(R.validated(D())), "skipped").otherwise("success")
    return bad_grids(spark, sf_dir).where("img % 7 <> 0").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def quality(images: DataFrame) -> DataFrame:
    """img and its six quality metrics."""
    both = F.struct(mean(D()).alias("m"), F.sqrt(variance(D())).alias("s"))
    rows = images.withColumn("q", let(both, lambda q: F.struct(q["m"].alias("mean"), q["s"].alias("std"), (q["s"] / (q["m"] + 1e-8)).alias("speckle_index"), (q["m"] * q["m"] / (q["s"] * q["s"] + 1e-8)).alias("enl"))))
    change = (mean(F.transform(R.differences(D(), H(), W(), 1), F.abs)) + mean(F.transform(R.differences(D(), H(), W(), 0), F.abs))) / 2.0
    return rows.select("img", "q.*", change.alias("avg_gradient"), R.entropy(D()).alias("entropy"))


METRICS = ("mean", "std", "speckle_index", "enl", "avg_gradient", "entropy")
QUALITY = f"""with {GRIDS_SQL}, ms as (select img, avg(v) as mean, stddev_pop(v) as std from g group by img),
    d as (select img, lead(v) over (partition by img, y order by x) - v as dx, lead(v) over (partition by img, x order by y) - v as dy from g),
    gr as (select img, (avg(abs(dx)) + avg(abs(dy))) / 2 as avg_gradient from d group by img),
    hb as (select img, least(floor(v * 256), 255) as b, count(*) as c from g group by 1, 2),
    en as (select img, -sum(c / (t + 1e-8) * log2(c / (t + 1e-8))) as entropy from (select *, sum(c) over (partition by img) as t from hb) group by img),
    im as (select img, mean, std, std / (mean + 1e-8) as speckle_index, mean * mean / (std * std + 1e-8) as enl, avg_gradient, entropy from ms join gr using (img) join en using (img))"""


@query("img_quality", QUALITY + " select img, " + ", ".join(f"round({m}, 6) as {m}" for m in METRICS) + " from im")
def img_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(grids(spark, sf_dir)).select("img", *[r6(F.col(m)).alias(m) for m in METRICS])


@query(
    "dataset_quality",
    QUALITY + " ".join(f"{u} select '{n}' as image, " + ", ".join(f"round({f}({m}), 6) as {m}" for m in METRICS) + ", count(*) as n from im" for u, n, f in (("", "__AVG__", "avg"), ("union all", "__STD__", "stddev_pop"))),
)
def dataset_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average and population deviation of every per-image metric, in one pass."""
    rows = quality(grids(spark, sf_dir))
    both = rows.agg(F.count("*").alias("n"), *[f(m).alias(f"{k}_{m}") for k, f in (("a", F.avg), ("s", F.stddev_pop)) for m in METRICS])
    kinds = F.array(*[F.struct(F.lit(n).alias("image"), *[r6(F.col(f"{k}_{m}")).alias(m) for m in METRICS], "n") for k, n in (("a", "__AVG__"), ("s", "__STD__"))])
    return both.select(F.explode(kinds).alias("r")).select("r.*")


@query(
    "output_stats",
    f"""with {GRIDS_SQL} select img, round(quantile_cont(v, 0.01), 3) as p01, round(quantile_cont(v, 0.5), 3) as p50, round(quantile_cont(v, 0.99), 3) as p99,
    round(quantile_cont(v, 0.998), 3) as p998, round(avg(case when v <= 1e-4 then 1.0::double else 0.0 end), 4) as zero_ratio from g group by img""",
)
def output_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = {"p01": 1, "p50": 50, "p99": 99, "p998": 99.8}
    zero = F.size(F.filter(D(), lambda v: v <= 1e-4)) / F.size(D())
    return grids(spark, sf_dir).select("img", *[F.round(percentile(D(), p), 3).alias(n) for n, p in ps.items()], F.round(zero, 4).alias("zero_ratio"))


@query(
    "reference_cdf",
    f"""with {GRIDS_SQL}, hb as (select least(floor(v * 64), 63)::int as b, count(*) as c from g where label = 0 group by 1),
    d as (select range::int as bin, coalesce(c, 0) as c from range(64) left join hb on b = range)
    select bin, round(bin / 63.0, 6) as x, round(sum(c) over (order by bin) / sum(c) over ()::double, 6) as cdf from d""",
)
def reference_cdf(spark: SparkSession, sf_dir: str, bins: int = 64) -> DataFrame:
    """Cumulative histogram of a set of images: counts are pre-aggregated, then at most ``bins`` rows are summed up."""
    counts = grids(spark, sf_dir).where("label = 0").select(F.explode("data").alias("v")).groupBy(R.bin_of(F.col("v"), bins).alias("bin")).agg(F.count("*").alias("c"))
    rows = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"), F.sum("c").alias("t"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)))
    curve = let(dense, lambda d: F.transform(d, lambda c, b: F.struct(b.alias("bin"), F.round(b / float(bins - 1), 6).alias("x"), (F.aggregate(F.slice(d, 1, b + 1), F.lit(0).cast("long"), lambda a, v: a + v)).alias("s"))))
    return rows.select(F.explode(curve).alias("r"), "t").select("r.bin", "r.x", F.round(F.col("r.s") / F.col("t"), 6).alias("cdf"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images 2k and 2k + 1 as pair k: pair, h, w, a, b."""
    rows = grids(spark, sf_dir).withColumn("pair", F.floor(F.col("img") / 2))
    side = lambda k, n: rows.where(F.col("img") % 2 == k).select("pair", "h", "w", F.col("data").alias(n))
    return side(0, "a").join(side(1, "b").drop("h", "w"), "pair")


def measured(spark: SparkSession, sf_dir: str, name: str, fn: Callable) -> DataFrame:
    """fn(a, b) of each pair, by the numpy plan: neighbourhoods cost one pass over an image."""
    out = mapped(pairs(spark, sf_dir), "pair", ("a", "b"), lambda a, b: {name: fn(a, b)}, f"pair long, {name} double")
    return out.select("pair", r6(F.col(name)).alias(name))


def A() -> Column:
    return F.col("a")


def B() -> Column:
    return F.col("b")


PAIR = f"""with {GRIDS_SQL}, {window_sql("win", "g", 1)},
    lp as (select img, y, x, any_value(v) as v, sum(case when abs(dy) + abs(dx) = 1 then nv when dy = 0 and dx = 0 then -4 * nv else 0 end) as l from win group by img, y, x),
    pr as (select a.img // 2 as pair, a.y, a.x, a.v as a, b.v as b, a.l as la, b.l as lb from lp a join lp b on b.img = a.img + 1 and a.img % 2 = 0 and a.y = b.y and a.x = b.x),
    mm as (select *, avg(a) over w as ma, avg(b) over w as mb, avg(la) over w as mla, avg(lb) over w as mlb from pr window w as (partition by pair)),
    pm as (select pair, case when avg((a - b) * (a - b)) <= 1e-8 then 100.0 else 10 * log10(1 / avg((a - b) * (a - b))) end as psnr,
      sum((a - ma) * (b - mb)) / (sqrt(sum((a - ma) * (a - ma)) * sum((b - mb) * (b - mb))) + 1e-8) as cc,
      sum((la - mla) * (lb - mlb)) / (sqrt(sum((la - mla) * (la - mla)) * sum((lb - mlb) * (lb - mlb))) + 1e-8) as epi from mm group by pair)"""


def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("pair", R.psnr(A(), B()).alias("psnr"), R.correlation(A(), B()).alias("cc"), R.edge_preservation(A(), B(), H(), W()).alias("epi"))


@query("pair_metrics", PAIR + " select pair, round(psnr, 6) as psnr, round(cc, 6) as cc, round(epi, 6) as epi, round((epi + cc + psnr / 40) / 3, 6) as composite from pm")
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pair_table(spark, sf_dir)
    composite = (F.coalesce("epi", F.lit(0.0)) + F.coalesce("cc", F.lit(0.0)) + F.coalesce("psnr", F.lit(0.0)) / 40.0) / 3.0
    return rows.select("pair", *[r6(F.col(c)).alias(c) for c in ("psnr", "cc", "epi")], r6(composite).alias("composite"))


@query("structure_means", PAIR + " select round(avg(epi), 6) as epi, round(avg(cc), 6) as cc, round(avg(psnr), 6) as psnr, count(*) as n_pairs from pm")
def structure_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_table(spark, sf_dir).agg(*[r6(F.avg(c)).alias(c) for c in ("epi", "cc", "psnr")], F.count("*").alias("n_pairs"))


@query(
    "pair_ssim",
    f"""with {GRIDS_SQL}, pr as (select a.img // 2 as img, a.y, a.x, a.v as a, b.v as b from g a join g b on b.img = a.img + 1 and a.img % 2 = 0 and a.y = b.y and a.x = b.x),
    o as (select dy.range::int as dy, dx.range::int as dx from range(-3, 4) dy, range(-3, 4) dx),
    st as (select c.img, c.y, c.x, avg(n.a) as mx, avg(n.b) as my, avg(n.a * n.a) as xx, avg(n.b * n.b) as yy, avg(n.a * n.b) as xy from pr c, o join pr n on n.img = c.img
      and n.y = {mirrored_sql("c.y + o.dy")} and n.x = {mirrored_sql("c.x + o.dx")} group by c.img, c.y, c.x)
    select img as pair, round(avg((2 * mx * my + 1e-4) * (2 * (xy - mx * my) + 9e-4) / ((mx * mx + my * my + 1e-4) * ((xx - mx * mx) + (yy - my * my) + 9e-4) + 1e-8)), 6) as ssim from st group by img""",
)
def pair_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir, "ssim", K.ssim)


DIFFS = f"""with {GRIDS_SQL}, d as (select img, y, x, v, lead(v) over (partition by img, y order by x) - v as dx, lead(v) over (partition by img, x order by y) - v as dy from g)"""


@query("grad_loss", DIFFS + " select a.img // 2 as pair, round(avg(abs(a.dx - b.dx)) + avg(abs(a.dy - b.dy)), 6) as loss from d a join d b on b.img = a.img + 1 and a.img % 2 = 0 and a.y = b.y and a.x = b.x group by 1")
def grad_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir, "loss", K.gradient_loss)


@query("lap_loss", PAIR + " select pair, round(avg(abs(la - lb)), 6) as loss from pr group by pair")
def lap_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir, "loss", lambda a, b: float(np.abs(K.laplacian(a) - K.laplacian(b)).mean()))


@query("coherence_loss", f"with {GRIDS_SQL}, {SAL}, {SHARP} select s.img // 2 as pair, round(avg((1 - sh) * wt), 6) as loss from sal s join shp on shp.img = s.img + 1 and s.img % 2 = 0 and s.y = shp.y and s.x = shp.x group by 1")
def coherence_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How little the generated image (b) is sharp where the source (a) shines."""
    return measured(spark, sf_dir, "loss", lambda a, b: float(((1 - K.sharpness(b)) * K.saliency(a)).mean()))


@query("l1_loss", PAIR + " select pair, round(avg(abs(a - b)), 6) as loss from pr group by pair")
def l1_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("pair", r6(mean(F.zip_with(A(), B(), lambda p, q: F.abs(p - q)))).alias("loss"))


@query(
    "color_moment",
    f"""with {GRIDS_SQL}, m as (select img // 6 as pair, (img // 3) % 2 as side, img % 3 as c, avg(v) as m, sqrt(var_pop(v) + 1e-5) as s from g group by 1, 2, 3)
    select a.pair, round(avg(abs(a.m - b.m)) + avg(abs(a.s - b.s)), 6) as loss from m a join m b on a.pair = b.pair and a.c = b.c and a.side = 0 and b.side = 1 group by a.pair""",
)
def color_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three consecutive images are the channels of one; images 2k and 2k + 1 of these are a pair."""
    img = F.col("img")
    rows = grids(spark, sf_dir).select(F.floor(img / 6).alias("pair"), F.floor(img / 3) % 2, (img % 3).alias("c"), mean(D()).alias("m"), F.sqrt(variance(D()) + 1e-5).alias("s")).toDF("pair", "side", "c", "m", "s")
    side = lambda k, n: rows.where(F.col("side") == k).select("pair", "c", F.col("m").alias(f"m{n}"), F.col("s").alias(f"s{n}"))
    both = side(0, "a").join(side(1, "b"), ["pair", "c"])
    return both.groupBy("pair").agg(r6(F.avg(F.abs(F.col("ma") - F.col("mb"))) + F.avg(F.abs(F.col("sa") - F.col("sb")))).alias("loss"))


@query("luminance", f"""with {GRIDS_SQL} select img // 3 as img, y, x, round(least(greatest(sum(v * case img % 3 when 0 then 0.299 when 1 then 0.587 else 0.114 end::double), 0.0), 1.0), 6) as v from g group by 1, 2, 3 having count(*) = 3""")
def luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.element_at(F.array(F.lit(0.299), F.lit(0.587), F.lit(0.114)), (F.col("img") % 3).cast("int") + 1)
    parts = grids(spark, sf_dir).select(F.floor(F.col("img") / 3).alias("rgb"), F.transform("data", lambda v: v * weight).alias("c"))
    rows = parts.groupBy("rgb").agg(F.collect_list("c").alias("cs")).where("size(cs) = 3").withColumnRenamed("rgb", "img")
    lum = F.zip_with(F.zip_with(F.get("cs", F.lit(0)), F.get("cs", F.lit(1)), lambda p, q: p + q), F.get("cs", F.lit(2)), lambda p, q: F.least(F.greatest(p + q, F.lit(0.0)), F.lit(1.0)))
    return tall(rows.select("img", F.lit(8).alias("w"), lum.alias("data")))


@query(
    "otsu_threshold",
    f"""with {GRIDS_SQL}, u as (select img, trunc(v * 255)::int as u from g), h as (select img, u, count(*) as c from u group by 1, 2),
    t as (select i.img, r.range::int as t from (select distinct img from u) i cross join range(256) r),
    s as (select t.img, t.t, sum(case when u <= t.t then c else 0 end) as w0, sum(case when u > t.t then c else 0 end) as w1, sum(case when u <= t.t then c * u else 0 end) as s0, sum(case when u > t.t then c * u else 0 end) as s1
      from t join h using (img) group by 1, 2),
    b as (select img, t, case when w0 = 0 or w1 = 0 then 0 else w0::double * w1 * (s0 / w0 - s1 / w1) * (s0 / w0 - s1 / w1) end as var from s)
    select img, min(t)::int as threshold from (select *, max(round(var, 3)) over (partition by img) as top from b) where round(var, 3) = top group by img""",
)
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that separates an image's histogram best; the lowest among equals."""
    return mapped(grids(spark, sf_dir), "img", ("data",), lambda x: {"threshold": regions.otsu(regions.levels(x))}, "img long, threshold int")


@query("array_summary", f"with {GRIDS_SQL} select img, round(avg(v), 6) as mean, min(v) as low, max(v) as high, round(quantile_cont(v, 0.5), 6) as median, round(stddev_pop(v), 6) as std from g group by img")
def array_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("img", r6(mean(D())).alias("mean"), F.array_min(D()).alias("low"), F.array_max(D()).alias("high"), r6(percentile(D(), 50)).alias("median"), r6(F.sqrt(variance(D()))).alias("std"))


@query("pipeline_manifest")
def pipeline_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default pipeline over grids with planted bad images, as its manifest."""
    from ..operators import pipeline

    return pipeline.manifest(pipeline.run(bad_grids(spark, sf_dir), pipeline.default_spec(size=16)))


@query(
    "pipeline_sizes",
    f"""{BAD}, z as (select img, any_value(img % 7 <> 0 and (img % 13 = 0 or img % 11 = 0)) as c from b group by img)
    select img, case when c then 'skipped' else 'success' end as status, case when c then 'empty/constant image' end as error, 8::int as orig_h, 8::int as orig_w, case when not c then 16 end::int as out_h, case when not c then 16 end::int as out_w, case when not c then 3 end::int as channels,
      'validate_image|sar_intensity_transform|speckle_filter|outlier_clipping|histogram_mapping|resize_or_tile|channel_adapter|normalize_for_cut' as steps from z""",
)
def pipeline_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's columns that no pixel decides."""
    return pipeline_manifest(spark, sf_dir).select("img", "status", "error", "orig_h", "orig_w", "out_h", "out_w", "channels", "steps")


@query("pipeline_status", f"""{BAD}, z as (select img, any_value(img % 7 <> 0 and (img % 13 = 0 or img % 11 = 0)) as c from b group by img) select case when c then 'skipped' else 'success' end as status, count(*) as n from z group by 1""")
def pipeline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline_manifest(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def _fast(name: str, step: str, **params) -> None:
    """The numpy plan of a step that has an expression plan, held to the same equivalent."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..operators import pipeline

        out = pipeline.run(grids(spark, sf_dir), [{"name": step, "params": params}])
        return tall(out.select("img", F.col("out_w").alias("w"), "data"))

    QUERIES[f"fast_{name}"] = run
    ORACLE[f"fast_{name}"] = ORACLE[name]


_fast("intensity_log1p", "sar_intensity_transform", mode="log1p")
_fast("intensity_db", "sar_intensity_transform", mode="db")
_fast("speckle_lee", "speckle_filter", method="lee", window_size=7)
_fast("speckle_refined_lee", "speckle_filter", method="refined_lee", window_size=7)
_fast("speckle_bm3d_fallback", "speckle_filter", method="bm3d")
_fast("speckle_gamma_map", "speckle_filter", method="gamma_map", window_size=7)
_fast("speckle_frost", "speckle_filter", method="frost", window_size=3)
_fast("outlier_clip", "outlier_clipping")
_fast("histogram_map", "histogram_mapping", bins=64)
