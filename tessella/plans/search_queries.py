"""Resumable configuration searches: candidates, signatures, append-only logs, ranking; with DuckDB equivalents."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The steps whose order is searched, and the speckle filters.
STEPS = ("sar_intensity_transform", "speckle_filter", "outlier_clipping", "histogram_mapping")
SPECKLE = ("lee", "refined_lee", "gamma_map", "frost", "bm3d")
#: The parameter grid.
SPACE = {
    "attention_type": ("none", "coord", "cbam"),
    "attention_positions": ("enc", "enc+res", "enc+res+dec"),
    "attention_reduction": (8, 16),
    "lambda_grad": (0.0, 1.0),
    "lambda_lap": (0.0, 0.5),
    "lambda_coherence": (0.0, 0.5),
    "lambda_color": (0.0, 1.0),
    "reflector_boost": (3.0, 5.0),
    "reflector_weighted": (False, True),
    "saliency_patch_sampling": (False, True),
}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def cross(spark: SparkSession, lists: dict) -> DataFrame:
    """All combinations of a few literal lists, as one row exploded list by list (no join)."""
    out = spark.range(1)
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id")


def _values(name: str, values) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v).lower()
    return f"(values {', '.join(f'({lit(v)})' for v in values)}) t_{name}({name})"


STEP_LIST = ", ".join(f"('{s}')" for s in STEPS)
CAND = f"""st(s) as (values {STEP_LIST}), cand as (select a.s || '>' || b.s || '>' || c.s || '>' || d.s as "order", speckle
    from st a, st b, st c, st d, {_values("speckle", SPECKLE)} where a.s not in (b.s, c.s, d.s) and b.s not in (c.s, d.s) and c.s <> d.s)"""


def signature(order: Column, speckle: Column, stage: int, n: int) -> Column:
    return F.concat(order, F.lit("|speckle="), speckle, F.lit(f"|stage={stage}|n={n}"))


def candidates(spark: SparkSession) -> DataFrame:
    return cross(spark, {"order": [">".join(p) for p in permutations(STEPS)], "speckle": SPECKLE})


@query("order_candidates", f"""with {CAND} select "order", speckle, "order" || '|speckle=' || speckle || '|stage=1|n=200' as signature from cand""")
def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark).withColumn("signature", signature(F.col("order"), F.col("speckle"), 1, 200))


GRID = "grid as (select * from " + ", ".join(_values(k, v) for k, v in SPACE.items()) + ")"


@query("param_grid", f"with {GRID} select attention_type, count(*) as n from grid group by 1")
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross(spark, SPACE).groupBy("attention_type").agg(F.count("*").alias("n"))


#: Keys of a canonical configuration in the order of its signature.
KEYS = ("attention_decoder", "attention_encoder", "attention_reduction", "attention_resblocks", "attention_type", "lambda_coherence", "lambda_color", "lambda_grad", "lambda_lap", "reflector_boost", "reflector_weighted", "saliency_patch_sampling")


def canonical(grid: DataFrame) -> DataFrame:
    """Settings that nothing reads take one value, so equal configurations are equal rows; with signature."""
    off = F.col("attention_type") == "none"
    pos = F.col("attention_positions")
    weighted = F.col("reflector_weighted") & ~((F.col("lambda_grad") == 0) & (F.col("lambda_lap") == 0))
    out = grid.withColumn("attention_encoder", ~off).withColumn("attention_resblocks", ~off & pos.isin("enc+res", "enc+res+dec")).withColumn("attention_decoder", ~off & (pos == "enc+res+dec"))
    out = out.withColumn("attention_reduction", F.when(off, 16).otherwise(F.col("attention_reduction"))).withColumn("reflector_weighted", weighted)
    unread = ~F.col("reflector_weighted") & ~F.col("saliency_patch_sampling") & (F.col("lambda_coherence") == 0)
    out = out.withColumn("reflector_boost", F.when(unread, 3.0).otherwise(F.col("reflector_boost"))).select(*KEYS).distinct()
    quoted = lambda k: F.concat(F.lit('"'), F.col(k), F.lit('"')) if k == "attention_type" else F.col(k).cast("string")
    json = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), quoted(k)) for k in KEYS]), F.lit("}"))
    return out.withColumn("signature", F.substring(F.md5(json), 1, 10))


def _json_sql(k: str) -> str:
    if k == "attention_type":
        return f"""'"{k}": "' || {k} || '"'"""
    return f"""'"{k}": ' || {f"printf('%.1f', {k})" if k.startswith(("lambda", "reflector_boost")) else f"{k}::varchar"}"""


CANON = f"""{GRID}, c1 as (select *, attention_type <> 'none' as attention_encoder, attention_type <> 'none' and attention_positions in ('enc+res', 'enc+res+dec') as attention_resblocks,
    attention_type <> 'none' and attention_positions = 'enc+res+dec' as attention_decoder, case when attention_type = 'none' then 16 else attention_reduction end as red,
    reflector_weighted and not (lambda_grad = 0 and lambda_lap = 0) as rw from grid),
    c2 as (select * replace (red as attention_reduction, rw as reflector_weighted, case when not rw and not saliency_patch_sampling and lambda_coherence = 0 then 3.0::double else reflector_boost end as reflector_boost) from c1),
    c3 as (select distinct {", ".join(KEYS)} from c2), canon as (select *, substr(md5('{{' || {" || ', ' || ".join(_json_sql(k) for k in KEYS)} || '}}'), 1, 10) as signature from c3)"""


@query("canonical_trials", f"with {CANON} select signature, attention_type, attention_reduction, reflector_boost, reflector_weighted from canon")
def canonical_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(cross(spark, SPACE)).select("signature", "attention_type", "attention_reduction", "reflector_boost", "reflector_weighted")


@query("trial_draws", f"with {CANON} select signature from canon order by md5(signature || ':42'), signature limit 12")
def trial_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve distinct configurations, drawn by a hash order."""
    rows = canonical(cross(spark, SPACE)).select("signature")
    return rows.orderBy(F.md5(F.concat("signature", F.lit(":42"))), "signature").limit(12)


@query(
    "override_label",
    f"""with {CANON} select signature, array_to_string(list_filter([case when attention_type = 'none' then 'attn=none' else 'attn=' || attention_type || '/' || case when attention_encoder then 'E' else '' end
      || case when attention_resblocks then 'R' else '' end || case when attention_decoder then 'D' else '' end || '/r' || attention_reduction end,
      case when lambda_grad > 0 then 'grad=' || trim(trailing '.' from trim(trailing '0' from lambda_grad::varchar)) end, case when lambda_lap > 0 then 'lap=' || trim(trailing '.' from trim(trailing '0' from lambda_lap::varchar)) end,
      case when lambda_coherence > 0 then 'coh=' || trim(trailing '.' from trim(trailing '0' from lambda_coherence::varchar)) end, case when lambda_color > 0 then 'col=' || trim(trailing '.' from trim(trailing '0' from lambda_color::varchar)) end,
      case when reflector_weighted then 'rw' end, case when saliency_patch_sampling then 'sps' end,
      case when reflector_weighted or saliency_patch_sampling or lambda_coherence > 0 then 'b' || trim(trailing '.' from trim(trailing '0' from reflector_boost::varchar)) end], lambda x: x is not null), ' ') as label from canon""",
)
def override_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.?0*$", "")
    parts = ("E", "attention_encoder"), ("R", "attention_resblocks"), ("D", "attention_decoder")
    letters = F.concat(*[F.when(F.col(c), n).otherwise("") for n, c in parts])
    attention = F.when(F.col("attention_type") == "none", "attn=none").otherwise(F.concat(F.lit("attn="), F.col("attention_type"), F.lit("/"), letters, F.lit("/r"), F.col("attention_reduction").cast("string")))
    losses = [F.when(F.col(c) > 0, F.concat(F.lit(f"{t}="), short(c))) for c, t in (("lambda_grad", "grad"), ("lambda_lap", "lap"), ("lambda_coherence", "coh"), ("lambda_color", "col"))]
    flags = [F.when(F.col("reflector_weighted"), "rw"), F.when(F.col("saliency_patch_sampling"), "sps")]
    boost = F.when(F.col("reflector_weighted") | F.col("saliency_patch_sampling") | (F.col("lambda_coherence") > 0), F.concat(F.lit("b"), short("reflector_boost")))
    return canonical(cross(spark, SPACE)).select("signature", F.concat_ws(" ", attention, *losses, *flags, boost).alias("label"))


TRIALS = f"""{CAND}, stg(stage, n) as (values (1, 200), (2, 1000)), base as (select "order", speckle, stage, "order" || '|speckle=' || speckle || '|stage=' || stage || '|n=' || n as signature from cand, stg),
    hashed as (select *, md5(signature) as h from base), tr as (select signature, "order", speckle, stage, seq, case when substr(h, 7, 1) = '0' then null else (('0x' || substr(md5(signature || ':' || seq), 1, 6))::bigint % 100000) / 100000.0::double end as composite
      from hashed, (values (1), (2)) s(seq) where (seq = 1 and substr(h, 8, 1) < 'c') or (seq = 2 and substr(h, 8, 1) < '4'))"""


def trials(spark: SparkSession) -> DataFrame:
    """An append-only results log: some candidates are missing, some repeated later, some have no metric."""
    base = cross(spark, {"order": [">".join(p) for p in permutations(STEPS)], "speckle": SPECKLE, "stage": (1, 2), "seq": (1, 2)})
    n = F.when(F.col("stage") == 1, "200").otherwise("1000")
    sig = F.concat("order", F.lit("|speckle="), "speckle", F.lit("|stage="), F.col("stage").cast("string"), F.lit("|n="), n)
    rows = base.withColumn("signature", sig).withColumn("h", F.md5("signature"))
    rows = rows.where(((F.col("seq") == 1) & (F.substring("h", 8, 1) < "c")) | ((F.col("seq") == 2) & (F.substring("h", 8, 1) < "4")))
    value = F.conv(F.substring(F.md5(F.concat_ws(":", "signature", F.col("seq").cast("string"))), 1, 6), 16, 10).cast("long") % 100000 / 100000.0
    return rows.withColumn("composite", F.when(F.substring("h", 7, 1) != "0", value)).drop("h")


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each signature; a partial aggregate, no window."""
    return rows.groupBy("signature").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "signature"]), "seq").alias("r")).select("signature", "r.*")


LATEST = TRIALS + ", la as (select * from (select *, row_number() over (partition by signature order by seq desc) as k from tr) where k = 1)"


@query("latest_results", f"with {LATEST} select signature, seq, composite from la")
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(trials(spark)).select("signature", "seq", "composite")


@query("pending_work", f"""with {LATEST} select "order", speckle from cand where "order" || '|speckle=' || speckle || '|stage=1|n=200' not in (select signature from la)""")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = candidates(spark).withColumn("signature", signature(F.col("order"), F.col("speckle"), 1, 200))
    return todo.join(latest(trials(spark)), "signature", "left_anti").select("order", "speckle")


RANK = "composite desc nulls last, signature"


def ranked(rows: DataFrame, direction: int = 1) -> DataFrame:
    """Best first by a metric that is better high (1) or low (-1); missing ones last, ties by signature."""
    return rows.orderBy((F.lit(direction) * F.col("composite")).desc_nulls_last(), "signature")


@query("stage1_topk", f"with {LATEST} select signature, composite from la where stage = 1 order by {RANK} limit 10")
def stage1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(latest(trials(spark)).where("stage = 1")).limit(10).select("signature", "composite")


@query("stage1_worst", f"with {LATEST} select signature, composite from la where stage = 1 order by -composite desc nulls last, signature limit 10")
def stage1_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order for a metric that is better low."""
    return ranked(latest(trials(spark)).where("stage = 1"), -1).limit(10).select("signature", "composite")


@query(
    "best_config",
    f"""with {LATEST}, top as (select "order", speckle, signature, composite from la where stage = 1 order by {RANK} limit 10),
    s2 as (select la."order", la.speckle, 2 as stage, la.composite, la.signature from la join top using ("order", speckle) where la.stage = 2), al as (select * from s2 union all select "order", speckle, 1, composite, signature from top)
    select "order", speckle, stage, composite from al order by stage desc, {RANK} limit 1""",
)
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner of stage two among the promoted; of stage one where stage two has none."""
    rows = latest(trials(spark))
    top = ranked(rows.where("stage = 1")).limit(10)
    second = rows.where("stage = 2").join(F.broadcast(top.select("order", "speckle")), ["order", "speckle"], "left_semi")
    both = second.select(*rows.columns).unionByName(top.select(*rows.columns))
    best = both.orderBy(F.col("stage").desc(), F.col("composite").desc_nulls_last(), "signature").limit(1)
    return best.select("order", "speckle", "stage", "composite")


@query("stage2_skips", f"""with {LATEST} select signature, composite is not null as reused from la where stage = 2""")
def stage2_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which recorded stage-two trials a resumed search takes over: those that have the metric it needs."""
    return latest(trials(spark)).where("stage = 2").select("signature", F.col("composite").isNotNull().alias("reused"))


@query("search_progress", f"with {LATEST} select stage, count(*) as done, count(composite) as scored, round(avg(composite), 6) as mean from la group by stage")
def search_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(trials(spark)).groupBy("stage").agg(F.count("*").alias("done"), F.count("composite").alias("scored"), F.round(F.avg("composite"), 6).alias("mean"))


def successive_halving(candidates_: DataFrame, first, second, k: int) -> DataFrame:
    """Two-stage search: all candidates by ``first``, the k best of them by ``second``; the winner's row.

    first and second take a table of candidates (signature) and return it with composite.
    """
    top = ranked(first(candidates_)).limit(k)
    final = second(top.drop("composite")).withColumn("stage", F.lit(2))
    both = final.unionByName(top.withColumn("stage", F.lit(1)), allowMissingColumns=True)
    return both.orderBy(F.col("stage").desc(), F.col("composite").desc_nulls_last(), "signature").limit(1)


def row_numbers(rows: DataFrame, by: str, *order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
