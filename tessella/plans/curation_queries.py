"""Listing, classifying, splitting, pairing and sampling of file collections, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import kept_distinct, let
from ..scratch import Scratch
from ..sources.views import FILES_SQL, GRIDS_SQL, files, grids

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Extension presets (fixed values): the pipeline's, the trainer's (which also takes ppm), and the flat listing's.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
PRESETS = {"pipeline": IMAGE_EXTENSIONS, "training": (*IMAGE_EXTENSIONS, "ppm")}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def is_image(name: Column, preset: str = "pipeline") -> Column:
    """Extension test in any case; hidden files are out."""
    return F.lower(name).rlike(r"\.(" + "|".join(PRESETS[preset]) + ")$") & ~name.startswith(".")


IMG = f"with {FILES_SQL}, im as (select * from fl where regexp_matches(lower(name), '\\.(png|jpg|jpeg|bmp|tif|tiff)$') and not starts_with(name, '.'))"
DOMAIN = """dm as (select id, path, name, case when contains(lower(path), 'src0') or contains(lower(path), 'src1/') then 'A' else 'B' end as domain,
    case when contains(lower(path), '/fr/') then 'test' else 'train' end as split from im)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(is_image(F.col("name")))


def numbered(rows: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """rows with a number from 0 over a total order of the whole table, without one task for all.

    Rows are range-partitioned, sorted and written once, each with its partition and its place
    there; only what is written tells the sizes of the partitions, so a task that runs again or
    an exchange that is coalesced otherwise cannot move a row.
    """
    parts = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the partition
    parts = Scratch(rows.sparkSession).save(parts.withColumn("_p", F.spark_partition_id()).withColumn("_i", place), "numbered")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return parts.join(before, "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def numbered_within(rows: DataFrame, by: tuple[str, ...], *order: str, name: str = "pos") -> DataFrame:
    """Likewise from 0 within each group of ``by``, however large a group is; there are few groups."""
    out = numbered(rows, *by, *order, name="_at")
    first = out.groupBy(*by).agg(F.min("_at").alias("_first"))
    return out.join(first, list(by)).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first")


@query("list_files", IMG + " select path from im")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("path")


@query("list_hidden", f"with {FILES_SQL} select path from fl where starts_with(name, '.') or not regexp_matches(lower(name), '\\.(png|jpg|jpeg|bmp|tif|tiff|ppm)$')")
def list_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(~is_image(F.col("name"), "training")).select("path")


@query("first_files", IMG + " select path from im order by path limit 50")
def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("path").orderBy("path").limit(50)


@query("seeded_shuffle", IMG + " select path, (row_number() over (order by md5(path || ':42'), path) - 1)::bigint as pos from im")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).select("path", kept_distinct("path", "42").alias("key"))
    return numbered(rows, "key", "path").select("path", F.col("pos").cast("long").alias("pos"))


@query("batches", IMG + ", o as (select path, row_number() over (order by path) - 1 as i from im), b as (select path, i // 16 as batch from o) select path, batch::bigint as batch from b where batch < (select count(*) // 16 from im)")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full batches of sixteen in path order; the last, smaller one is dropped."""
    rows = numbered(images(spark, sf_dir).select("path"), "path").withColumn("batch", F.floor(F.col("pos") / 16))
    full = rows.groupBy("batch").agg(F.count("*").alias("n")).where("n = 16").select("batch")
    return rows.join(full, "batch", "left_semi").select("path", "batch")


@query("paths_split", f"with {FILES_SQL} select path, regexp_replace(name, '\\.[^.]*$', '') as stem, lower(regexp_extract(name, '\\.([^.]*)$', 1)) as ext, len(path) - len(replace(path, '/', '')) as depth from fl")
def paths_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return files(spark, sf_dir).select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), (F.size(F.split("path", "/")) - 1).cast("long").alias("depth"))


@query("depth_limited", f"with {FILES_SQL} select source_dir as dir, count(*) as n from (select split_part(path, '/', 1) as source_dir from fl where len(path) - len(replace(path, '/', '')) <= 2) group by 1")
def depth_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).where(F.size(F.split("path", "/")) <= 3)
    return rows.groupBy(F.substring_index("path", "/", 1).alias("dir")).agg(F.count("*").alias("n"))


@query("classify_domain", IMG + f", {DOMAIN} select path, domain, split from dm")
def classify_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains(spark, sf_dir).select("path", "domain", "split")


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword rules, the first that matches wins; then the split by keyword."""
    hay = F.lower(F.col("path"))
    first = F.when(hay.contains("src0") | hay.contains("src1/"), "A").otherwise("B")
    return images(spark, sf_dir).withColumn("domain", first).withColumn("split", F.when(hay.contains("/fr/"), "test").otherwise("train"))


SPLIT = IMG + f", {DOMAIN}, r as (select *, row_number() over (partition by domain order by md5(path || ':7'), path) as k, count(*) over (partition by domain) as n from dm), sp as (select path, name, domain, case when k <= floor(n * 0.1) then 'test' else 'train' end as split from r)"


def split_rows(spark: SparkSession, sf_dir: str, ratio: float = 0.1) -> DataFrame:
    """Each domain's first floor(n * ratio) files in hash order become the test split.

    Hashes are counted in 4,096 slots a domain. A slot lies before the bound or behind it as a
    whole, but for one a domain: only that one's rows are ranked, a 4,096th of the domain.
    """
    rows = domains(spark, sf_dir).withColumn("key", kept_distinct("path", "7")).withColumn("slot", F.substring("key", 1, 3))
    by = Window.partitionBy("domain")
    slots = rows.groupBy("domain", "slot").agg(F.count("*").alias("n"))
    slots = slots.withColumn("k", F.floor(F.sum("n").over(by) * ratio)).withColumn("before", F.sum("n").over(by.orderBy("slot")) - F.col("n"))
    side = F.when(F.col("before") + F.col("n") <= F.col("k"), "test").when(F.col("before") >= F.col("k"), "train")
    rows = rows.join(F.broadcast(slots.select("domain", "slot", "k", "before", side.alias("split_"))), ["domain", "slot"])  # 4,096 rows a domain at most
    rank = F.row_number().over(Window.partitionBy("domain", "slot").orderBy("key", "path")) + F.col("before")
    near = rows.where("split_ is null").withColumn("split_", F.when(rank <= F.col("k"), "test").otherwise("train"))
    return rows.where("split_ is not null").unionByName(near).withColumn("split", F.col("split_")).drop("split_", "k", "before", "slot", "key")


@query("split_dataset", SPLIT + " select path, domain, split from sp")
def split_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(spark, sf_dir).select("path", "domain", "split")


@query("split_counts", SPLIT + " select split, domain, count(*) as n from sp group by 1, 2")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(spark, sf_dir).groupBy("split", "domain").agg(F.count("*").alias("n"))


@query("export_plan", SPLIT + " select path as src, split || domain || '/' || lpad((row_number() over (partition by split, domain order by path) - 1)::varchar, 6, '0') || '_' || name as dst from sp")
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered_within(split_rows(spark, sf_dir).select("path", "name", "split", "domain"), ("split", "domain"), "path", name="i")
    return rows.select(F.col("path").alias("src"), F.concat(F.col("split"), F.col("domain"), F.lit("/"), F.lpad(F.col("i").cast("string"), 6, "0"), F.lit("_"), F.col("name")).alias("dst"))


@query("dir_summary", f"with {FILES_SQL} select regexp_replace(path, '/[^/]*$', '') as dir, count(*) as total, count(*) filter (regexp_matches(lower(name), '\\.(png|jpg|jpeg|bmp|tif|tiff)$') and not starts_with(name, '.')) as images from fl group by 1")
def dir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.count("*").alias("total"), F.count_if(is_image(F.col("name"))).alias("images"))


@query("folder_counts", IMG + f", {DOMAIN} select f.k as folder, count(path) as n from (values ('trainA'), ('trainB'), ('testA'), ('testB'), ('valA')) f(k) left join dm on split || domain = f.k group by 1")
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per expected folder, empty ones with zero."""
    counts = domains(spark, sf_dir).groupBy(F.concat("split", "domain").alias("folder")).agg(F.count("*").alias("n"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("trainA", "trainB", "testA", "testB", "valA")])).alias("folder"))
    return names.join(counts, "folder", "left").select("folder", F.coalesce("n", F.lit(0)).alias("n"))


TWO = IMG + """, a as (select 'doc_' || (id // 3) as stem, path as path_a from im where id % 2 = 0), b as (select 'doc_' || (id // 3) as stem, path as path_b from im where id % 2 = 1)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = images(spark, sf_dir).withColumn("stem", F.concat(F.lit("doc_"), F.floor(F.col("id") / 3).cast("string")))
    return rows.where("id % 2 = 0").select("stem", F.col("path").alias("path_a")), rows.where("id % 2 = 1").select("stem", F.col("path").alias("path_b"))


@query("pair_by_stem", TWO + " select stem, path_a, path_b from (select stem, max(path_a) as path_a from a group by 1) join (select stem, max(path_b) as path_b from b group by 1) using (stem)")
def pair_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of both sides with one stem; of several, the last by path."""
    a, b = sides(spark, sf_dir)
    return a.groupBy("stem").agg(F.max("path_a").alias("path_a")).join(b.groupBy("stem").agg(F.max("path_b").alias("path_b")), "stem")


@query("common_stems", TWO + " select stem from a intersect select stem from b")
def common_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    return a.select("stem").intersect(b.select("stem"))


@query("pair_by_rewrite", IMG + ", t as (select case when id % 2 = 0 then 'x' || (id // 2) || '_A.png' else 'x' || (id // 2) || '_B.png' end as name, id from im) select a.name as name_a, b.name as name_b from t a join t b on b.name = replace(a.name, '_A.', '_B.') and a.id % 2 = 0 and b.id % 2 = 1")
def pair_by_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("x"), F.floor(F.col("id") / 2).cast("string"), F.when(F.col("id") % 2 == 0, "_A.png").otherwise("_B.png"))
    rows = images(spark, sf_dir).select("id", name.alias("name"))
    a = rows.where("id % 2 = 0").select(F.col("name").alias("name_a"), F.regexp_replace("name", r"_A\.", "_B.").alias("name_b"))
    return a.join(rows.where("id % 2 = 1").select(F.col("name").alias("name_b")), "name_b").select("name_a", "name_b")


NUM = TWO + ", na as (select path_a, row_number() over (order by path_a) - 1 as i from a), nb as (select path_b, row_number() over (order by path_b) - 1 as i from b), c as (select (select count(*) from a) as na, (select count(*) from b) as nb)"


@query("zip_pairs", NUM + " select i::bigint as i, path_a, path_b from na join nb using (i)")
def zip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    return numbered(a, "path_a", name="i").join(numbered(b, "path_b", name="i"), "i").select(F.col("i").cast("long").alias("i"), "path_a", "path_b")


@query("cyclic_pairs", NUM + ", r as (select unnest(range(greatest(na, nb))) as i, na, nb from c) select r.i::bigint as i, path_a, path_b from r join na on na.i = r.i % r.na join nb on nb.i = r.i % r.nb")
def cyclic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many pairs as the longer side has files; the shorter one starts over."""
    return paired(spark, sf_dir, lambda n: F.col("i") % n)


@query("hashed_pairs", NUM + ", r as (select unnest(range(greatest(na, nb))) as i, na, nb from c) select r.i::bigint as i, path_a, path_b from r join na on na.i = r.i % r.na join nb on nb.i = ('0x' || substr(md5(r.i || ':9'), 1, 7))::bigint % r.nb")
def hashed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of the second side for each of the first, chosen by a hash."""
    return paired(spark, sf_dir, lambda n: F.conv(F.substring(kept_distinct("i", "9"), 1, 7), 16, 10).cast("long") % n)


def paired(spark: SparkSession, sf_dir: str, other) -> DataFrame:
    a, b = sides(spark, sf_dir)
    na, nb = a.count(), b.count()
    if not na or not nb:
        return spark.createDataFrame([], "i long, path_a string, path_b string")
    rows = spark.range(max(na, nb)).withColumnRenamed("id", "i").select("i", (F.col("i") % na).alias("ia"), other(nb).alias("ib"))
    out = rows.join(numbered(a, "path_a", name="ia"), "ia").join(numbered(b, "path_b", name="ib"), "ib")
    return out.select("i", "path_a", "path_b")


@query("direction_swap", TWO + " select stem, case when stem < 'doc_2' then path_b else path_a end as source, case when stem < 'doc_2' then path_a else path_b end as target from (select stem, max(path_a) as path_a from a group by 1) join (select stem, max(path_b) as path_b from b group by 1) using (stem)")
def direction_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    swap = F.col("stem") < "doc_2"
    rows = pair_by_stem(spark, sf_dir)
    return rows.select("stem", F.when(swap, F.col("path_b")).otherwise(F.col("path_a")).alias("source"), F.when(swap, F.col("path_a")).otherwise(F.col("path_b")).alias("target"))


@query("resolve_first", f"with {FILES_SQL} select id // 5 as grp, min_by(path, case when ends_with(name, '.jpg') then 0 when ends_with(name, '.TIF') then 1 else 2 end * 1000000 + id) as path from fl where not starts_with(name, '.') group by 1")
def resolve_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several candidate files, the first that exists in the order of preference."""
    rank = F.when(F.col("name").endswith(".jpg"), 0).when(F.col("name").endswith(".TIF"), 1).otherwise(2) * 1000000 + F.col("id")
    return files(spark, sf_dir).where(~F.col("name").startswith(".")).groupBy(F.floor(F.col("id") / 5).alias("grp")).agg(F.min_by("path", rank).alias("path"))


SAMPLE = f"with {GRIDS_SQL}, k as (select img, y, x, v, ('0x' || substr(md5(img || '-' || y || '-' || x || ':3'), 1, 7))::bigint as hx from g), u as (select *, (hx + 1) / 268435457.0 as u from k)"


@query("uniform_sample", SAMPLE + " select img, y, x from (select *, row_number() over (partition by img order by hx, y, x) as r from u) where r <= 8")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight positions of each image without replacement."""
    return sampled(spark, sf_dir, lambda s: F.struct(s["hx"].cast("double").alias("key"), s["y"].alias("y"), s["x"].alias("x")))


@query("weighted_sample", SAMPLE + " select img, y, x from (select *, row_number() over (partition by img order by round(-ln(u) / (v + 1e-6), 9), y, x) as r from u) where r <= 8")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight positions of each image without replacement, likelier where the image is bright (exponential keys)."""
    return sampled(spark, sf_dir, lambda s: F.struct(F.round(-F.ln((s["hx"] + 1) / 268435457.0) / (s["v"] + 1e-6), 9).alias("key"), s["y"].alias("y"), s["x"].alias("x")))


def sampled(spark: SparkSession, sf_dir: str, key) -> DataFrame:
    def one(v: Column, i: Column) -> Column:
        y, x = F.floor(i / 8).cast("int"), (i % 8).cast("int")
        name = F.concat_ws("-", F.col("img").cast("string"), y.cast("string"), x.cast("string"))
        hx = F.conv(F.substring(F.md5(F.concat(name, F.lit(":3"))), 1, 7), 16, 10).cast("long")
        return let(F.struct(v.alias("v"), y.alias("y"), x.alias("x"), hx.alias("hx")), key)

    best = F.slice(F.sort_array(F.transform("data", one)), 1, 8)
    return grids(spark, sf_dir).select("img", F.explode(best).alias("r")).select("img", "r.y", "r.x")
