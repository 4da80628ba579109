"""Views of the driver's tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import let


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 image per embedding: img, label, h, w, data in 0..1."""
    rows = table(spark, sf_dir, "embeddings")
    data = F.transform("embedding", lambda v: v.cast("double"))
    scaled = let(data, lambda d: let(F.struct(F.array_min(d).alias("lo"), F.array_max(d).alias("hi")), lambda b: F.transform(d, lambda v: (v - b["lo"]) / (b["hi"] - b["lo"]))))
    return rows.select(F.col("vec_id").alias("img"), F.col("label").cast("int").alias("label"), F.lit(8).alias("h"), F.lit(8).alias("w"), scaled.alias("data"))


def tall(images: DataFrame, data: str = "data") -> DataFrame:
    """img, y, x, v of every pixel, v rounded to six places."""
    rows = images.select("img", "w", F.posexplode(data).alias("i", "v"))
    return rows.select("img", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), (F.round(F.col("v").cast("double"), 6) + 0.0).alias("v"))


#: DuckDB twins of grids() in long form: g(img, label, y, x, v).
GRIDS_SQL = """
    e as (select vec_id, label, unnest(embedding)::double as e, (generate_subscripts(embedding, 1) - 1)::int as p from embeddings),
    g as (select vec_id as img, label::int as label, (p // 8)::int as y, (p % 8)::int as x,
                 (e - min(e) over (partition by vec_id)) / (max(e) over (partition by vec_id) - min(e) over (partition by vec_id)) as v from e)
"""


def mirrored_sql(i: str) -> str:
    return f"(case when {i} < 0 then -({i}) when {i} > 7 then 14 - ({i}) else {i} end)"


def window_sql(name: str, source: str, r: int, value: str = "v", pad: str = "reflect") -> str:
    """CTE ``name``(img, y, x, v, dy, dx, nv): each pixel of source with its window's pixels."""
    offsets = f"(select range::int as dy from range({-r}, {r + 1})), (select range::int as dx from range({-r}, {r + 1}))"
    if pad == "reflect":
        on = f"n.y = {mirrored_sql('c.y + o.dy')} and n.x = {mirrored_sql('c.x + o.dx')}"
    else:
        on = "n.y = c.y + o.dy and n.x = c.x + o.dx"
    return f"{name} as (select c.img, c.y, c.x, c.{value} as v, o.dy, o.dx, n.{value} as nv from {source} c, (select * from {offsets}) o join {source} n on n.img = c.img and {on})"


#: Extensions of the synthetic listing, by doc_id % 5 (fixed values of the fixtures).
EXTENSIONS = (".png", ".jpg", ".TIF", ".txt", ".x.png")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic file listing: id, path, name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    k = (F.col("doc_id") % 5).cast("int")
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    name = F.when(k == 4, F.concat(F.lit("."), stem, F.lit(".x.png"))).otherwise(F.concat(stem, F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), k + 1)))
    return docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", name).alias("path"), name.alias("name"))


FILES_SQL = """
    n as (select doc_id as id, source, lang, case doc_id % 5 when 0 then 'doc_' || doc_id || '.png' when 1 then 'doc_' || doc_id || '.jpg' when 2 then 'doc_' || doc_id || '.TIF'
                 when 3 then 'doc_' || doc_id || '.txt' else '.doc_' || doc_id || '.x.png' end as name from documents),
    fl as (select id, source || '/' || lang || '/' || name as path, name from n)
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic training log: run, seq (from 1 within the run), ts, line."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"))
    e, i = F.col("event_id") % 20 + 1, F.col("event_id") % 1000
    a = F.format_string("%.3f", F.round(F.col("value"), 2))
    step = F.concat(F.lit("(epoch: "), e.cast("string"), F.lit(", iters: "), i.cast("string"), F.lit(", time: 0.1, data: 0.2) G_GAN: "), a, F.lit(" NCE: "), F.format_string("%.4f", F.round(F.col("value"), 2) / 2))
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("End of epoch "), e.cast("string"))).when(F.col("event_type") == "error", F.lit("warning: loader is slow")).otherwise(step)
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(F.col("user_id").alias("run"), F.row_number().over(order).alias("seq"), "ts", line.alias("line"), "event_id")


LOG_SQL = """
    ev as (select event_id, ts, user_id, event_type, coalesce(value, 0.0) as value from events),
    lg as (select user_id as run, (row_number() over (partition by user_id order by ts, event_id))::int as seq, ts, event_id,
           case when event_type = 'signup' then 'End of epoch ' || (event_id % 20 + 1) when event_type = 'error' then 'warning: loader is slow'
           else '(epoch: ' || (event_id % 20 + 1) || ', iters: ' || (event_id % 1000) || ', time: 0.1, data: 0.2) G_GAN: ' || printf('%.3f', round(value, 2)) || ' NCE: ' || printf('%.4f', round(value, 2) / 2) end as line from ev)
"""
