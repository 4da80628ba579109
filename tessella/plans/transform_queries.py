"""Size and index arithmetic of training transforms, configuration overlays and aggregates of losses; with DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster as R
from ..functions.columns import let, mean, r6
from ..sources.views import GRIDS_SQL, grids, table, tall, window_sql
from .raster_queries import METRICS, QUALITY, dataset_quality

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


SIZES = "sz as (select page_id as id, (length(url) * 7 % 500 + 40)::int as w, (page_id * 13 % 400 + 30)::int as h from pages)"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes made of the pages: id, w, h."""
    rows = table(spark, sf_dir, "pages")
    return rows.select(F.col("page_id").alias("id"), (F.length("url") * 7 % 500 + 40).cast("int").alias("w"), (F.col("page_id") * 13 % 400 + 30).cast("int").alias("h"))


def half_even(v: Column) -> Column:
    return F.bround(v, 0).cast("int")


@query("size_multiple_of_4", f"with {SIZES} select id, (round_even(w / 4, 0) * 4)::int as w, (round_even(h / 4, 0) * 4)::int as h from sz")
def size_multiple_of_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda c: (half_even(F.col(c) / 4) * 4).alias(c)
    return sizes(spark, sf_dir).select("id", side("w"), side("h"))


@query("size_scale_width", f"with {SIZES} select id, case when w = 286 and h >= 256 then w else 286 end as w, case when w = 286 and h >= 256 then h else trunc(greatest(286 * h / w, 256))::int end as h from sz")
def size_scale_width(spark: SparkSession, sf_dir: str, width: int = 286, crop: int = 256) -> DataFrame:
    same = (F.col("w") == width) & (F.col("h") >= crop)
    tall_ = F.floor(F.greatest(width * F.col("h") / F.col("w"), F.lit(float(crop)))).cast("int")
    return sizes(spark, sf_dir).select("id", F.when(same, F.col("w")).otherwise(width).alias("w"), F.when(same, F.col("h")).otherwise(tall_).alias("h"))


@query("size_scale_shortside", f"with {SIZES} select id, case when least(w, h) >= 286 then w else round_even(w * (286 / least(w, h)), 0)::int end as w, case when least(w, h) >= 286 then h else round_even(h * (286 / least(w, h)), 0)::int end as h from sz")
def size_scale_shortside(spark: SparkSession, sf_dir: str, width: int = 286) -> DataFrame:
    short = F.least("w", "h")
    side = lambda c: F.when(short >= width, F.col(c)).otherwise(half_even(F.col(c) * (F.lit(width) / short))).alias(c)
    return sizes(spark, sf_dir).select("id", side("w"), side("h"))


U = "('0x' || substr(md5(id || ':{}'), 1, 7))::bigint / 268435456.0"


def uniform(name: str) -> Column:
    """A number in 0..1 made of the id, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{name}"))), 1, 7), 16, 10).cast("long") / 268435456.0


@query(
    "random_zoom",
    f"with {SIZES} select id, round_even(greatest(256, w * (0.8::double + 0.2 * ({U.format('zw')}))), 0)::int as w, round_even(greatest(256, h * (0.8::double + 0.2 * ({U.format('zh')}))), 0)::int as h from sz",
)
def random_zoom(spark: SparkSession, sf_dir: str, crop: int = 256) -> DataFrame:
    side = lambda c: half_even(F.greatest(F.lit(float(crop)), F.col(c) * (0.8 + 0.2 * uniform(f"z{c}")))).alias(c)
    return sizes(spark, sf_dir).select("id", side("w"), side("h"))


@query(
    "random_crop",
    f"with {SIZES} select id, floor(({U.format('x')}) * (greatest(0, w - 256) + 1))::int as x, floor(({U.format('y')}) * (greatest(0, h - 256) + 1))::int as y, ({U.format('f')}) > 0.5 as flip from sz",
)
def random_crop(spark: SparkSession, sf_dir: str, crop: int = 256) -> DataFrame:
    """Place of a crop and whether it is mirrored."""
    at = lambda c, n: F.floor(uniform(n) * (F.greatest(F.lit(0), F.col(c) - crop) + 1)).cast("int").alias(n)
    return sizes(spark, sf_dir).select("id", at("w", "x"), at("h", "y"), (uniform("f") > 0.5).alias("flip"))


@query("patch_grid", f"with {SIZES} select id, i::int as patch, ((i % (w // 64)) * 64 + (w % 64) // 2)::int as x, ((i // (w // 64)) * 64 + (h % 64) // 2)::int as y from sz, range(0, 64) r(i) where w >= 64 and h >= 64 and i < (w // 64) * (h // 64)")
def patch_grid(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """Corners of the whole patches that fit, in the middle of the image."""
    across, down = F.floor(F.col("w") / size).cast("int"), F.floor(F.col("h") / size).cast("int")
    rows = sizes(spark, sf_dir).where((F.col("w") >= size) & (F.col("h") >= size))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), across * down - 1)).alias("patch"))
    x = (F.col("patch") % across) * size + F.floor((F.col("w") % size) / 2)
    y = F.floor(F.col("patch") / across) * size + F.floor((F.col("h") % size) / 2)
    return rows.select("id", "patch", x.cast("int").alias("x"), y.cast("int").alias("y"))


BLUR = "(case abs(dy) when 0 then 2 else 1 end) * (case abs(dx) when 0 then 2 else 1 end) / 16.0"


@query("blur_downsample", f"with {GRIDS_SQL}, {window_sql('win', 'g', 1)} select img, y // 2 as y, x // 2 as x, round(sum(nv * {BLUR}::double), 6) + 0.0 as v from win where y % 2 = 0 and x % 2 = 0 group by img, win.y, win.x")
def blur_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second pixel of a binomially blurred image."""
    weights = {(dy, dx): (2 - abs(dy)) * (2 - abs(dx)) / 16 for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    rows = tall(grids(spark, sf_dir).select("img", "w", R.convolve(F.col("data"), F.col("h"), F.col("w"), weights).alias("data"))).where("y % 2 = 0 and x % 2 = 0")
    return rows.select("img", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), "v")


@query("channel_stack", f"with {GRIDS_SQL} select img, c::int as c, round(avg(v), 6) as mean, count(*) as n from g, range(3) t(c) group by 1, 2")
def channel_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grids(spark, sf_dir).select("img", F.posexplode(R.channels(F.col("data"), 3)).alias("c", "d"))
    return rows.select("img", "c", r6(mean(F.col("d"))).alias("mean"), F.size("d").cast("long").alias("n"))


@query("to_unit_range", f"with {GRIDS_SQL} select img, y, x, round((v - 0.5) / 0.5, 6) + 0.0 as v from g")
def to_unit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0..1 to -1..1."""
    return tall(grids(spark, sf_dir).select("img", "w", F.transform("data", lambda v: (v - 0.5) / 0.5).alias("data")))


@query("from_unit_range", f"with {GRIDS_SQL} select img, y, x, trunc(least(greatest(((v * 3 - 1.5) + 1) / 2 * 255, 0), 255)) as v from g")
def from_unit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network output (here beyond -1..1) to whole numbers 0..255."""
    back = F.transform("data", lambda v: F.floor(F.least(F.greatest(((v * 3 - 1.5) + 1) / 2 * 255, F.lit(0.0)), F.lit(255.0))))
    return tall(grids(spark, sf_dir).select("img", "w", back.alias("data")))


LAYERS = "ly as (select event_id % 500 as step, user_id % 5 as layer, coalesce(value, 0.0) as v from events)"


@query("layer_mean", f"with {LAYERS}, m as (select step, layer, avg(v) as m from ly group by 1, 2) select step, round(avg(m), 5) as loss, count(*) as layers from m group by 1")
def layer_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers weigh alike, however many rows they have."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("step"), (F.col("user_id") % 5).alias("layer"), F.coalesce("value", F.lit(0.0)).alias("v"))
    return rows.groupBy("step", "layer").agg(F.avg("v").alias("m")).groupBy("step").agg(F.round(F.avg("m"), 5).alias("loss"), F.count("*").alias("layers"))


#: Weights of the terms of the total loss; a term of weight zero is not in it.
TERMS = {"click": 1.0, "view": 10.0, "purchase": 0.5, "error": 0.0, "signup": 2.0}


@query("weighted_loss", "select event_id % 500 as step, round(sum(coalesce(value, 0.0) * case event_type when 'click' then 1.0 when 'view' then 10.0 when 'purchase' then 0.5 when 'error' then 0.0 when 'signup' then 2.0 else 0.0 end::double), 4) as total from events group by 1")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in TERMS.items() if v for x in (k, v)]), F.col("event_type")), F.lit(0.0))
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("step"), (F.coalesce("value", F.lit(0.0)) * weight).alias("v"))
    return rows.groupBy("step").agg(F.round(F.sum("v"), 4).alias("total"))


@query("config_overlay", "select event_id, coalesce(nullif(event_type, 'view'), 'default') as mode, case when event_id % 3 = 0 then coalesce(value, 1.0) else 1.0 end as lr from events")
def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults overlaid by what a run sets; later maps win."""
    base = F.create_map(F.lit("mode"), F.lit("default"), F.lit("lr"), F.lit("1.0"))
    own = F.create_map(F.lit("mode"), F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("lr"), F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")))
    set_ = F.map_filter(own, lambda k, v: v.isNotNull())
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(set_, k)), set_)
    return table(spark, sf_dir, "events").select("event_id", F.element_at(merged, "mode").alias("mode"), F.element_at(merged, "lr").cast("double").alias("lr"))


@query(
    "strip_prefix",
    "with k as (select doc_id % 50 as grp, case when doc_id % 50 < 20 and doc_id % 3 = 0 then 'module.' || source else source end as key from documents), a as (select grp, max(starts_with(key, 'module.')::int) = 1 as any_ from k group by 1) select k.grp, case when any_ then regexp_replace(key, '^module\\.', '') else key end as key, count(*) as n from k join a using (grp) group by 1, 2",
)
def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys lose a wrapper's prefix in groups where any key has it."""
    grp = F.col("doc_id") % 50
    key = F.when((grp < 20) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("module."), F.col("source"))).otherwise(F.col("source"))
    rows = table(spark, sf_dir, "documents").select(grp.alias("grp"), key.alias("key"))
    some = rows.groupBy("grp").agg(F.max(F.col("key").startswith("module.")).alias("any_"))
    plain = F.when(F.col("any_"), F.regexp_replace("key", r"^module\.", "")).otherwise(F.col("key"))
    return rows.join(some, "grp").groupBy("grp", plain.alias("key")).agg(F.count("*").alias("n"))


@query("valid_taps", "with t as (select event_id, [event_id % 7, event_id % 13 - 2, event_id % 5 + 4] as taps, (event_id % 4 + 3)::bigint as n from events), f as (select event_id, n, list_filter(taps, lambda i: i >= 0 and i < n) as ok from t) select event_id, case when len(ok) = 0 then '0' else array_to_string(ok, ',') end as taps from f")
def valid_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tap indices within range; the default where none is."""
    e = F.col("event_id")
    ok = F.filter(F.array(e % 7, e % 13 - 2, e % 5 + 4), lambda i: (i >= 0) & (i < e % 4 + 3))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.size(ok) == 0, "0").otherwise(F.array_join(ok.cast("array<string>"), ",")).alias("taps"))


def tap_indices(blocks: Column, attention: Column, antialias: Column) -> Column:
    """Layer numbers of the default taps of a residual generator, in closed form."""
    extra = attention.cast("int")
    stage = 3 + antialias.cast("int") + extra
    first = 4 + extra
    res = first + 2 * stage
    return F.array(F.lit(0), first, first + stage, res, res + F.least(F.lit(4), blocks - 1))


@query(
    "layer_taps",
    "select b as blocks, a as attention, n as antialias, [0, 4 + a, 4 + a + 3 + n + a, 4 + a + 2 * (3 + n + a), 4 + a + 2 * (3 + n + a) + least(4, b - 1)]::varchar as taps from (values (9), (6), (4)) t(b), (values (0), (1)) u(a), (values (0), (1)) v(n)",
)
def layer_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search_queries import cross

    rows = cross(spark, {"blocks": (9, 6, 4), "attention": (0, 1), "antialias": (0, 1)})
    taps = tap_indices(F.col("blocks"), F.col("attention"), F.col("antialias"))
    return rows.select("blocks", "attention", "antialias", F.concat(F.lit("["), F.array_join(taps.cast("array<string>"), ", "), F.lit("]")).alias("taps"))


@query(
    "plateau_lr",
    """with recursive v as (select user_id as run, row_number() over (partition by user_id order by ts, event_id) as k, coalesce(value, 0.0) as m from events),
    s(run, k, best, bad, lr) as (select run, 0::bigint, 1e300::double, 0, 1.0::double from (select distinct run from v) union all
      select s.run, v.k, case when v.m < s.best * 0.99::double then v.m else s.best end, case when v.m < s.best * 0.99::double or s.bad + 1 > 5 then 0 else s.bad + 1 end,
        case when v.m >= s.best * 0.99::double and s.bad + 1 > 5 then s.lr * 0.2::double else s.lr end from s join v on v.run = s.run and v.k = s.k + 1)
    select run, round(arg_max(lr, k), 9) as lr from s group by run""",
)
def plateau_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate falls to a fifth after more than five values in a row that are no better.

    Each step needs the one before, so a run is read in order by one task: sorted rows stream
    through, and what is held is the state of a run, not the run.
    """
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", "event_id", F.coalesce("value", F.lit(0.0)).alias("m"))
    rows = rows.repartition("run").sortWithinPartitions("run", "ts", "event_id").select("run", "m")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, bad, lr = None, 1e300, 0, 1.0
        put = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([lr])], names=["run", "lr"])
        for batch in batches:
            for run, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if run != at:
                    if at is not None:
                        yield put()
                    at, best, bad, lr = run, 1e300, 0, 1.0
                if m < best * 0.99:
                    best, bad = m, 0
                elif bad + 1 > 5:
                    bad, lr = 0, lr * 0.2
                else:
                    bad += 1
        if at is not None:
            yield put()

    return rows.where("run is not null").mapInArrow(fold, "run long, lr double").select("run", F.round("lr", 9).alias("lr"))


@query(
    "candidate_scores",
    f"""with {GRIDS_SQL}, pr as (select a.img // 2 as pair, a.v as a, b.v as b from g a join g b on b.img = a.img + 1 and a.img % 2 = 0 and a.y = b.y and a.x = b.x),
    c(gamma) as (values (0.5), (1.0), (2.0)), q as (select gamma::double as gamma, pair, avg((a - pow(b, gamma)) * (a - pow(b, gamma))) as mse from pr, c group by 1, 2)
    select gamma, round(avg(case when mse <= 1e-8 then 100.0 else 10 * log10(1 / mse) end), 6) as psnr, count(*) as n from q group by gamma""",
)
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each candidate transform over all pairs; candidates are exploded per pair, not joined."""
    from .raster_queries import pairs

    rows = pairs(spark, sf_dir).select("a", "b", F.explode(F.array(*[F.lit(g) for g in (0.5, 1.0, 2.0)])).alias("gamma"))
    changed = let(F.col("gamma"), lambda g: F.transform("b", lambda v: F.pow(v, g)))
    return rows.groupBy("gamma").agg(r6(F.avg(R.psnr(F.col("a"), changed))).alias("psnr"), F.count("*").alias("n"))


@query("bright_regions")
def bright_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the grids with their smallest rectangles."""
    from ..operators import regions

    return regions.find(grids(spark, sf_dir), min_area=2, max_share=0.5, rectangular=0.5).drop("polygon")


@query(
    "object_boxes",
    f"""with {SIZES}, b as (select *, (w // 3) as x, (h // 4) as y, (w // 2) as bw, (h // 2) as bh from sz)
    select id, trunc(greatest(0, x - bw * 0.25::double))::int as x1, trunc(least(w, x + bw * 1.25::double))::int as x2, trunc(greatest(0, y - bh * 0.25::double))::int as y1, trunc(least(h, y + bh * 1.25::double))::int as y2 from b""",
)
def object_boxes(spark: SparkSession, sf_dir: str, border: float = 0.25) -> DataFrame:
    """Found boxes with a border around them, kept within the image."""
    part = lambda c, n: F.floor(F.col(c) / n)
    rows = sizes(spark, sf_dir).select("*", part("w", 3).alias("x"), part("h", 4).alias("y"), part("w", 2).alias("bw"), part("h", 2).alias("bh"))
    low = lambda at, size: F.floor(F.greatest(F.lit(0.0), F.col(at) - F.col(size) * border)).cast("int")
    high = lambda at, size, end: F.floor(F.least(F.col(end).cast("double"), F.col(at) + F.col(size) * (1 + border))).cast("int")
    return rows.select("id", low("x", "bw").alias("x1"), high("x", "bw", "w").alias("x2"), low("y", "bh").alias("y1"), high("y", "bh", "h").alias("y2"))


@query(
    "single_image_crops",
    f"""with n as (select range as id from range(2000)), m as (select id, id // 16 as batch from n)
    select m.id, round(0.25::double + 0.75 * (('0x' || substr(md5((batch)::varchar || ':zx'), 1, 7))::bigint / 268435456.0), 6) as zoom_x, round(0.25::double + 0.75 * (('0x' || substr(md5((batch)::varchar || ':zy'), 1, 7))::bigint / 268435456.0), 6) as zoom_y,
      (row_number() over (order by md5(m.id || ':a'), m.id) - 1)::bigint as patch_a, (row_number() over (order by md5(m.id || ':b'), m.id) - 1)::bigint as patch_b from m""",
)
def single_image_crops(spark: SparkSession, sf_dir: str, n: int = 2000, batch: int = 16, most: float = 4.0) -> DataFrame:
    """Zoom (equal within a minibatch) and two permutations of patch numbers for training on one image."""
    from .curation_queries import numbered

    zoom = lambda name: F.round(1 / most + (1 - 1 / most) * (F.conv(F.substring(F.md5(F.concat(F.floor(F.col("id") / batch).cast("string"), F.lit(f":{name}"))), 1, 7), 16, 10).cast("long") / 268435456.0), 6)
    rows = spark.range(n)
    out = rows.select("id", zoom("zx").alias("zoom_x"), zoom("zy").alias("zoom_y"))
    for side in ("a", "b"):
        keyed = rows.withColumn("key", F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{side}"))))
        out = out.join(numbered(keyed, "key", "id", name=f"patch_{side}").select("id", F.col(f"patch_{side}").cast("long").alias(f"patch_{side}")), "id")
    return out


@query(
    "ema_features",
    """with f as (select label::int as label, row_number() over (partition by label order by vec_id) as k, count(*) over (partition by label) as n, unnest(embedding)::double as v, (generate_subscripts(embedding, 1) - 1)::int as i from embeddings)
    select label, i, round(sum(0.001::double * pow(0.999, n - k) * v), 6) + 0.0 as ema from f group by 1, 2""",
)
def ema_features(spark: SparkSession, sf_dir: str, keep: float = 0.999) -> DataFrame:
    """Exponential moving average of a label's vectors in id order, in closed form: a sum that is pre-aggregated."""
    from .curation_queries import numbered_within

    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label"), "vec_id", "embedding")
    last = rows.groupBy("label").agg(F.count("*").alias("n"))
    place = numbered_within(rows, ("label",), "vec_id", name="k")
    weight = (1 - keep) * F.pow(F.lit(keep), F.col("n") - F.col("k") - 1)
    weighed = place.join(last, "label").select("label", weight.alias("wt"), F.posexplode("embedding").alias("i", "v"))
    return weighed.groupBy("label", "i").agg(r6(F.sum(F.col("wt") * F.col("v").cast("double"))).alias("ema"))


@query(
    "common_start",
    """with s as (select source, list(source || '_' || lang || '_run' order by doc_id) as l, min(source || '_' || lang || '_run') as lo, max(source || '_' || lang || '_run') as hi from documents group by source),
    c as (select source, lo, coalesce((select min(i) - 1 from range(1, 100) t(i) where substr(lo, i, 1) <> substr(hi, i, 1) or i > length(lo)), 0) as n from s)
    select source, substr(lo, 1, greatest(1, n - 4)::int) as start from c""",
)
def common_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common start of a group's labels, less four letters: that of the least and the greatest."""
    name = F.concat_ws("_", "source", "lang", F.lit("run"))
    ends = table(spark, sf_dir, "documents").groupBy("source").agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
    same = F.filter(F.sequence(F.lit(1), F.length("lo")), lambda i: F.substring(F.col("lo"), F.lit(1), i) == F.substring(F.col("hi"), F.lit(1), i))
    return ends.select("source", F.substring("lo", F.lit(1), F.greatest(F.lit(1), F.size(same) - 4)).alias("start"))




@query(
    "saliency_resample",
    f"""with {GRIDS_SQL}, o as (select range::int as k, greatest((range + 0.5) * 8 / 5.0 - 0.5, 0)::double as c from range(5)),
    t as (select k, floor(c)::int as i, least(floor(c)::int + 1, 7) as j, c - floor(c) as f from o)
    select a.img, ty.k as y, tx.k as x, round(greatest((1 - ty.f) * ((1 - tx.f) * a.v + tx.f * b.v) + ty.f * ((1 - tx.f) * c.v + tx.f * d.v), 1e-6), 6) as v
    from t ty, t tx join g a on a.y = ty.i and a.x = tx.i join g b on b.img = a.img and b.y = ty.i and b.x = tx.j join g c on c.img = a.img and c.y = ty.j and c.x = tx.i join g d on d.img = a.img and d.y = ty.j and d.x = tx.j""",
)
def saliency_resample(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    """A weight map resampled bilinearly (pixel centres, no aligned corners) to a layer's shape, floored above zero."""
    h, w, d = F.col("h"), F.col("w"), F.col("data")

    def axis(k: Column, n: Column) -> Column:
        c = F.greatest((k + 0.5) * n / size - 0.5, F.lit(0.0))
        i = F.floor(c).cast("int")
        return F.struct(i.alias("i"), F.least(i + 1, n - 1).alias("j"), (c - i).alias("f"))

    def at(p: Column) -> Column:
        def blend(s: Column) -> Column:
            y, x = s["y"], s["x"]
            v = lambda a, b: F.get(d, a * w + b)
            top = (1 - x["f"]) * v(y["i"], x["i"]) + x["f"] * v(y["i"], x["j"])
            low = (1 - x["f"]) * v(y["j"], x["i"]) + x["f"] * v(y["j"], x["j"])
            return F.greatest((1 - y["f"]) * top + y["f"] * low, F.lit(1e-6))

        return let(F.struct(axis(F.floor(p / size), h).alias("y"), axis(p % size, w).alias("x")), blend)

    out = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), at)
    return tall(grids(spark, sf_dir).select("img", out.alias("data"), F.lit(size).alias("w")))


@query("batch_concat", f"with {GRIDS_SQL} select 'real_a' as part, count(*) as n, round(avg(v), 6) as mean from g where label = 0 union all select 'real_b', count(*), round(avg(v), 6) from g where label = 1")
def batch_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a batch in one table, told apart by a tag."""
    rows = grids(spark, sf_dir)
    side = lambda k, n: rows.where(F.col("label") == k).select(F.lit(n).alias("part"), F.explode("data").alias("v"))
    return side(0, "real_a").unionByName(side(1, "real_b")).groupBy("part").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"))


@query(
    "metric_summary",
    QUALITY + ", a as (select count(*) as n, " + ", ".join(f"round(avg({m}), 6) as a_{m}, round(stddev_pop({m}), 6) as s_{m}" for m in METRICS) + " from im) select 0::int as line, 'metrics of ' || n || ' images' as text from a"
    + "".join(f" union all select {k}::int, printf('- {m:<16}: %8.4f +- %.4f', a_{m}, s_{m}) from a" for k, m in enumerate(METRICS, 1)),
)
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data set's metrics as lines of text."""
    rows = dataset_quality(spark, sf_dir)
    wide = rows.where("image = '__AVG__'").select(*[F.col(m).alias(f"a_{m}") for m in METRICS], "n").join(F.broadcast(rows.where("image = '__STD__'").select(*[F.col(m).alias(f"s_{m}") for m in METRICS])))
    return summary_lines(wide)


def summary_lines(wide: DataFrame) -> DataFrame:
    """The lines of a row of n, a_ and s_ metrics; the text is null where a metric is.

    Numbers are printed by Python, which rounds the exact value of a double as printf does. Java's formatter rounds
    its shortest decimal half up: 5.69835, a little less than that, becomes 5.6984 and not 5.6983.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                both = [(m, r[f"a_{m}"], r[f"s_{m}"]) for m in METRICS]
                text = [f"metrics of {r['n']} images", *(None if a is None or s is None else f"- {m:<16}: {a:8.4f} +- {s:.4f}" for m, a, s in both)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(text)), pa.int32()), pa.array(text, pa.string())], names=["line", "text"])

    return wide.mapInArrow(run, "line int, text string")
