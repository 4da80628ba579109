"""Training-log analytics: parsing, progress, stalls, smoothing, schedules; with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.views import FILES_SQL, LOG_SQL, files, log_lines, table
from .curation_queries import numbered

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The patterns of the log format.
ITERATION = r"epoch:\s*(\d+),\s*iters:\s*(\d+)"
LEARNING_RATE = r"learning rate.*?=\s*([0-9.eE+-]+)"
LOSS = r"(\w+):\s*(-?\d+\.\d+)"
#: Parts of a run that are ranked apart.
SALTS = 64


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


LG = f"with {LOG_SQL}"


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with epoch, iters (null on other lines), losses behind the bracket, and whether an epoch ends."""
    step = F.col("line").rlike(ITERATION)
    rest = F.element_at(F.split("line", r"\)", 2), -1)
    names, values = F.regexp_extract_all(rest, F.lit(LOSS), 1), F.regexp_extract_all(rest, F.lit(LOSS), 2)
    return (
        lines.withColumn("epoch", F.when(step, F.regexp_extract("line", ITERATION, 1).try_cast("int")))
        .withColumn("iters", F.when(step, F.regexp_extract("line", ITERATION, 2).try_cast("int")))
        .withColumn("losses", F.when(step, F.map_from_arrays(names, F.transform(values, lambda v: v.cast("double")))))
        .withColumn("epoch_end", F.col("line").contains("End of epoch"))
    )


PARSED = LG + """, ps as (select run, seq, ts, event_id, line, nullif(regexp_extract(line, 'epoch:\\s*(\\d+),\\s*iters:\\s*(\\d+)', 1), '')::int as epoch, nullif(regexp_extract(line, 'epoch:\\s*(\\d+),\\s*iters:\\s*(\\d+)', 2), '')::int as iters,
    nullif(regexp_extract(line, 'G_GAN: (-?\\d+\\.\\d+)', 1), '')::double as gan, nullif(regexp_extract(line, 'NCE: (-?\\d+\\.\\d+)', 1), '')::double as nce, contains(line, 'End of epoch') as epoch_end from lg)"""


@query("parse_log", PARSED + " select run, seq, epoch, iters, gan, nce, epoch_end from ps")
def parse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(log_lines(spark, sf_dir))
    return rows.select("run", "seq", "epoch", "iters", F.try_element_at("losses", F.lit("G_GAN")).alias("gan"), F.try_element_at("losses", F.lit("NCE")).alias("nce"), "epoch_end")


@query("loss_series", PARSED + ", l as (select run, epoch, 'G_GAN' as name, gan as v from ps where epoch is not null union all select run, epoch, 'NCE', nce from ps where epoch is not null) select run, epoch, name, count(*) as n, round(avg(v), 5) + 0.0 as mean from l group by 1, 2, 3")
def loss_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(log_lines(spark, sf_dir)).where("epoch is not null").select("run", "epoch", F.explode("losses").alias("name", "v"))
    return rows.groupBy("run", "epoch", "name").agg(F.count("*").alias("n"), (F.round(F.avg("v"), 5) + 0.0).alias("mean"))


@query("latest_state", PARSED + ", r as (select *, row_number() over (partition by run order by seq desc) as k from ps where epoch is not null) select run, epoch, iters, gan from r where k = 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last iteration line of each run."""
    rows = parsed(log_lines(spark, sf_dir)).where("epoch is not null")
    best = rows.groupBy("run").agg(F.max_by(F.struct("epoch", "iters", F.element_at("losses", "G_GAN").alias("gan")), "seq").alias("s"))
    return best.select("run", "s.*")


GAP = PARSED + ", pr as (select run, seq, ts, epoch_us(ts) - lag(epoch_us(ts)) over (partition by run order by ts, event_id) as gap from ps where epoch is not null or epoch_end)"


@query("stall_gaps", GAP + " select run, seq, gap // 1000000 as gap_s from pr where gap > 43200 * 1000000::bigint")
def stall_gaps(spark: SparkSession, sf_dir: str, seconds: int = 43200) -> DataFrame:
    """Progress lines (iterations and epoch ends; other lines do not count) that follow a longer silence.

    Lines are numbered over all runs and meet the line before by number, so no run is sorted in one task.
    """
    rows = parsed(log_lines(spark, sf_dir)).where("epoch is not null or epoch_end").select("run", "seq", "ts", "event_id")
    rows = numbered(rows, "run", "ts", "event_id")
    before = rows.select(F.col("run"), (F.col("pos") + 1).alias("pos"), F.col("ts").alias("since"))
    gap = F.timestamp_diff("MICROSECOND", F.col("since"), F.col("ts"))
    return rows.join(before, ["run", "pos"]).where(gap > seconds * 1_000_000).select("run", "seq", F.floor(gap / 1_000_000).alias("gap_s"))


@query("ema_step_time", LG + ", x as (select run, seq, count(*) over (partition by run) as n, event_id % 1000 / 1000.0 as v from lg) select run, round(sum(0.005 * pow(0.995, n - seq) * v), 6) as ema from x group by run")
def ema_step_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential smoothing (0.995 old, 0.005 new) in closed form: a sum that is pre-aggregated, however long a run is."""
    rows = log_lines(spark, sf_dir).select("run", "seq", (F.col("event_id") % 1000 / 1000.0).alias("v"))
    last = rows.groupBy("run").agg(F.max("seq").alias("n"))
    weight = 0.005 * F.pow(F.lit(0.995), F.col("n") - F.col("seq"))
    return rows.join(last, "run").groupBy("run").agg(F.round(F.sum(weight * F.col("v")), 6).alias("ema"))


@query("log_tail", LG + ", r as (select run, seq, line, count(*) over (partition by run) as n from lg) select run, seq, line from r where seq > n - 5")
def log_tail(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    rows = log_lines(spark, sf_dir)
    last = rows.groupBy("run").agg(F.max("seq").alias("n"))
    return rows.join(last, "run").where(F.col("seq") > F.col("n") - k).select("run", "seq", "line")


@query("progress_rows", LG + ", r as (select run, seq, count(*) over (partition by run) as n from lg) select run, seq from r where seq % 10 = 0 or seq = 1 or seq = n")
def progress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, every tenth and the last line of each run."""
    rows = log_lines(spark, sf_dir).select("run", "seq")
    last = rows.groupBy("run").agg(F.max("seq").alias("n"))
    return rows.join(last, "run").where("seq % 10 = 0 or seq = 1 or seq = n").select("run", "seq")


@query(
    "restart_machine",
    LG + """, x as (select run, seq, line, case when contains(line, 'warning') then 1 else 0 end as crash, case when contains(line, 'End of epoch 7') then 1 else 0 end as stop from lg),
    c as (select *, sum(crash) over (partition by run order by seq) as crashes from x), f as (select run, min(case when crashes > 3 then seq end) as dead, min(case when stop = 1 then seq end) as stopped, max(crashes) as total from c group by run)
    select f.run, case when dead is not null and (stopped is null or dead < stopped) then 'error' when stopped is not null then 'stopped' else 'running' end as status,
      (case when dead is not null and (stopped is null or dead < stopped) then 4 when stopped is not null then (select max(crashes) from c where c.run = f.run and c.seq <= f.stopped) else total end)::int as restarts from f""",
)
def restart_machine(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """Restarts after crashes until there are too many or the run is stopped.

    What ends a run is its first stop or its crash number most + 1, whichever is earlier. The
    latter is found among the first crashes of salted parts of a run, so no task gets a whole run.
    """
    event = F.when(F.col("line").contains("warning"), "crash").when(F.col("line").contains("End of epoch 7"), "stop")
    rows = log_lines(spark, sf_dir).select("run", "seq", event.alias("e"))
    crash = rows.where("e = 'crash'").withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)))
    for by in (["run", "salt"], ["run"]):
        crash = crash.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).where(F.col("k") <= most + 1)
    dead = crash.where(F.col("k") == most + 1).select("run", F.col("seq").alias("dead"))
    runs = rows.groupBy("run").agg(F.min(F.when(F.col("e") == "stop", F.col("seq"))).alias("stopped")).join(dead, "run", "left")
    end = F.coalesce(F.least("stopped", "dead"), F.lit(2**31 - 1))
    tries = rows.join(runs, "run").groupBy("run", "stopped", "dead").agg(F.count_if((F.col("e") == "crash") & (F.col("seq") <= end)).cast("int").alias("restarts"))
    status = F.when(F.col("dead") < F.coalesce("stopped", F.col("dead") + 1), "error").when(F.col("stopped").isNotNull(), "stopped").otherwise("running")
    return tries.select("run", status.alias("status"), "restarts")


@query("lr_schedule", "select r::int as epoch, round(1.0 - greatest(0, r + 1 - 100) / 101.0, 6) as linear, round(pow(0.1, r // 50), 6) as step, round((1 + cos(pi() * r / 100.0)) / 2, 6) + 0.0 as cosine from range(200) t(r)")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor of the learning rate by epoch, for 100 epochs and 100 of decay."""
    e = F.col("id").cast("int")
    linear = 1.0 - F.greatest(F.lit(0), e + 1 - 100) / 101.0
    cosine = (1 + F.cos(F.lit(3.141592653589793) * e / 100.0)) / 2
    return spark.range(200).select(e.alias("epoch"), F.round(linear, 6).alias("linear"), F.round(F.pow(F.lit(0.1), F.floor(e / 50)), 6).alias("step"), (F.round(cosine, 6) + 0.0).alias("cosine"))


CKPT = f"with {FILES_SQL}, ck as (select split_part(path, '/', 1) as run, case when id % 3 = 0 and split_part(path, '/', 1) < 'src5' then (id % 200) || '_net_G.pth' when id % 3 = 1 and split_part(path, '/', 1) < 'src8' then 'latest_net_G.pth' else 'notes.txt' end as name from fl)"


@query(
    "checkpoint_resume",
    CKPT + """, m as (select run, max(nullif(regexp_extract(name, '^(\\d+)_net_G\\.pth$', 1), '')::int) as last, max((name = 'latest_net_G.pth')::int) as latest from ck group by run)
    select run, coalesce(last::varchar, case when latest = 1 then 'latest' else 'fresh' end) as epoch, (case when last is not null then last + 1 else 1 end)::int as next from m""",
)
def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run goes on: behind the largest numbered checkpoint, at the latest, or from the start."""
    run = F.substring_index("path", "/", 1)
    name = F.when((F.col("id") % 3 == 0) & (run < "src5"), F.concat((F.col("id") % 200).cast("string"), F.lit("_net_G.pth"))).when((F.col("id") % 3 == 1) & (run < "src8"), "latest_net_G.pth").otherwise("notes.txt")
    rows = files(spark, sf_dir).select(run.alias("run"), name.alias("name"))
    last = F.max(F.regexp_extract("name", r"^(\d+)_net_G\.pth$", 1).try_cast("int"))
    m = rows.groupBy("run").agg(last.alias("last"), F.max(F.col("name") == "latest_net_G.pth").alias("latest"))
    epoch = F.coalesce(F.col("last").cast("string"), F.when(F.col("latest"), "latest").otherwise("fresh"))
    return m.select("run", epoch.alias("epoch"), F.coalesce(F.col("last") + 1, F.lit(1)).alias("next"))


@query("flag_values", "select event_id, lower(props) not in ('false', '0', 'none', '') as flag, try_cast(nullif(regexp_extract(props, '(-?[0-9]+)', 1), '') as double) as number from events")
def flag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose booleans and numbers: what is not false, 0, none or empty is true; what is no number is null."""
    number = F.nullif(F.regexp_extract("props", "(-?[0-9]+)", 1), F.lit("")).try_cast("double")
    return table(spark, sf_dir, "events").select("event_id", (~F.lower("props").isin("false", "0", "none", "")).alias("flag"), number.alias("number"))


@query("loss_lines", PARSED + " select run, seq, '(epoch: ' || epoch || ', iters: ' || iters || ') G_GAN: ' || printf('%.3f', gan) as line from ps where epoch is not null")
def loss_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed rows written as log lines again."""
    gan = F.format_string("%.3f", F.element_at("losses", "G_GAN"))
    rows = parsed(log_lines(spark, sf_dir)).where("epoch is not null")
    return rows.select("run", "seq", F.concat(F.lit("(epoch: "), F.col("epoch").cast("string"), F.lit(", iters: "), F.col("iters").cast("string"), F.lit(") G_GAN: "), gan).alias("line"))
