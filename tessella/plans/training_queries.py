"""Transform chains, gradient magnitudes, batch statistics and checks of pairs and sizes; with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import mean, r6
from ..operators import transforms
from ..sources.views import GRIDS_SQL, grids, table, tall
from .curation_queries import NUM, numbered, sides
from .transform_queries import SIZES, U, half_even, sizes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return add


def _u(name: str) -> str:
    return U.format(name).replace("id ||", "img ||")


@query(
    "transform_chain",
    f"""with {GRIDS_SQL}, c as (select distinct img, floor(({_u("x")}) * 5)::int as x0, floor(({_u("y")}) * 5)::int as y0, ({_u("f")}) > 0.5 as f from g)
    select img, (y - y0)::int as y, (case when f then 3 - (x - x0) else x - x0 end)::int as x, round(v * 2 - 1, 6) + 0.0 as v from g join c using (img) where y between y0 and y0 + 3 and x between x0 and x0 + 3""",
)
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop, sizes by four, mirror and -1..1 in one chain: a square of four at a hashed place of each image."""
    rows = grids(spark, sf_dir).select("img", "h", "w", F.lit(1).alias("channels"), F.transform("data", lambda v: v * 255.0).alias("data"))
    return tall(transforms.apply(rows, transforms.Options("crop", crop_size=4)).select("img", "w", "data"))


@query(
    "grad_magnitude",
    "select label::int as network, round(avg(list_avg(list_transform(embedding, lambda v: abs(v::double)))), 6) as mean_abs, sum(len(embedding))::bigint as n_values, count(*) as n_params from embeddings where embedding is not null group by 1",
)
def grad_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over a network's parameters of the mean absolute gradient of each, and how many numbers they hold."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    size = mean(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    return rows.groupBy(F.col("label").cast("int").alias("network")).agg(r6(F.avg(size)).alias("mean_abs"), F.sum(F.size("embedding")).alias("n_values"), F.count("*").alias("n_params"))


@query(
    "minibatch_std",
    """with e as (select vec_id // 32 as batch, (vec_id % 2)::int as member, unnest(embedding)::double as v, (generate_subscripts(embedding, 1) - 1)::int as i from embeddings),
    s as (select batch, member, i, sqrt(var_pop(v) + 1e-8) as s from e group by 1, 2, 3) select batch, member, round(avg(s), 6) as std from s group by 1, 2""",
)
def minibatch_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of each feature over the sixteen of a group (batches of 32 have two, by turns), then the mean over features."""
    one = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 32).alias("batch"), (F.col("vec_id") % 2).cast("int").alias("member"), F.posexplode("embedding").alias("i", "v"))
    each = one.groupBy("batch", "member", "i").agg(F.sqrt(F.var_pop(F.col("v").cast("double")) + 1e-8).alias("s"))
    return each.groupBy("batch", "member").agg(r6(F.avg("s")).alias("std"))


@query(
    "aspect_sizes",
    f"with {SIZES}, r as (select *, case id % 3 when 0 then 1.0 when 1 then 2.0 else 0.5 end::double as ratio from sz) select id, case when ratio > 1 then h when ratio < 1 then trunc(h / ratio)::int else w end as w, case when ratio > 1 then trunc(w * ratio)::int when ratio < 1 then w else h end as h from r",
)
def aspect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of a saved image by its aspect ratio: beyond one the height is stretched, below it the width (both with the sides changed over)."""
    w, h, ratio = F.col("w"), F.col("h"), F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)), (F.col("id") % 3).cast("int") + 1)
    wide, high = F.floor(h / ratio).cast("int"), F.floor(w * ratio).cast("int")
    return sizes(spark, sf_dir).select("id", F.when(ratio > 1, h).when(ratio < 1, wide).otherwise(w).alias("w"), F.when(ratio > 1, high).when(ratio < 1, w).otherwise(h).alias("h"))


@query(
    "size_warnings",
    f"with {SIZES}, o as (select id, w, h, (round_even(w / 4, 0) * 4)::int as nw, (round_even(h / 4, 0) * 4)::int as nh from sz) select min_by('size (' || w || ', ' || h || ') becomes (' || nw || ', ' || nh || ')', id) as warning, count(*) as n from o where w <> nw or h <> nh",
)
def size_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One warning for all images whose sides are no multiples of four: that of the first, with their number."""
    side = lambda c: half_even(F.col(c) / 4) * 4
    rows = sizes(spark, sf_dir).withColumn("nw", side("w")).withColumn("nh", side("h")).where("w <> nw or h <> nh")
    text = F.format_string("size (%d, %d) becomes (%d, %d)", "w", "h", "nw", "nh")
    return rows.agg(F.min_by(text, "id").alias("warning"), F.count("*").alias("n"))


@query("zip_mismatches", NUM + " select i::bigint as i, path_a, path_b from na join nb using (i) where regexp_extract(path_a, '_([0-9]+)[.]', 1)::bigint // 3 <> regexp_extract(path_b, '_([0-9]+)[.]', 1)::bigint // 3")
def zip_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by position whose identifiers differ."""
    a, b = sides(spark, sf_dir)
    return mismatched(numbered(a, "path_a", name="i"), numbered(b, "path_b", name="i")).select("i", "path_a", "path_b")


def mismatched(a: DataFrame, b: DataFrame) -> DataFrame:
    key = lambda c: F.floor(F.regexp_extract(c, "_([0-9]+)[.]", 1).cast("long") / 3)
    return a.drop("stem").join(b.drop("stem"), "i").where(key("path_a") != key("path_b")).select(F.col("i").cast("long").alias("i"), "path_a", "path_b")


def checked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by position; raises if identifiers differ, naming the first pair that does."""
    from .curation_queries import zip_pairs

    first = zip_mismatches(spark, sf_dir).orderBy("i").first()
    if first:
        raise ValueError(f"pair {first['i']}: {first['path_a']} and {first['path_b']} do not belong together")
    return zip_pairs(spark, sf_dir)


@query(
    "written_images",
    f"""with {GRIDS_SQL}, u as (select img, trunc(case when img % 13 = 0 then 0.25 else v end * 255) as u from g), m as (select img, u, max(u) over (partition by img) as top, img % 13 = 0 as flat from u)
    select img, case when flat then 'skipped' else 'success' end as status, case when flat then 'empty/constant image' end as error, 8::int as orig_h, 8::int as orig_w, case when not flat then 8 end::int as out_h,
      sum(case when not flat then trunc(u / top * 255) end)::bigint as total from m group by img, flat""",
)
def written_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a folder of PNG files, from the files that are written for it to those that it writes: status, sizes, and the sum of the pixels read back."""
    from ..operators import folder
    from ..scratch import Scratch
    from ..sources.files import write_files
    from ..sources.images import read_images

    scratch = Scratch(spark)
    flat = F.col("img") % 13 == 0
    rows = grids(spark, sf_dir).select("img", "h", "w", F.transform("data", lambda v: F.floor(F.when(flat, 0.25).otherwise(v) * 255.0).cast("double")).alias("data"))
    write_files(folder.as_files(rows.select(F.concat(F.col("img").cast("string"), F.lit(".png")).alias("name"), "h", "w", F.lit(1).alias("channels"), "data")), f"{scratch.root}/in")
    steps = [{"name": n, "params": {}} for n in ("validate_image", "channel_adapter", "normalize_for_cut")]
    done = folder.run_folder(spark, {"io": {"input_dir": f"{scratch.root}/in", "output_dir": f"{scratch.root}/out", "previews": 0}, "pipeline": {"steps": steps}})
    done = done.select(folder.stem(F.col("input_path")).cast("long").alias("img"), "status", "error", "orig_h", "orig_w", "out_h")
    back = read_images(spark, f"{scratch.root}/out/images").select(folder.stem(F.col("path")).cast("long").alias("img"), F.aggregate("data", F.lit(0.0), lambda a, v: a + v).cast("long").alias("total"))
    return done.join(back, "img", "left")
