"""Training logs as streams: the latest state and stalls of each run, and a replay buffer.

These demonstrate the batch operators of plans/monitor_queries.py on Structured
Streaming; the event-time parts are this engine's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.monitor_queries import parsed
from ..scratch import Scratch


def lines_of(events: DataFrame) -> DataFrame:
    """Log lines (run, ts, event_id, line) of an event table or stream."""
    value = F.format_string("%.3f", F.round(F.coalesce("value", F.lit(0.0)), 2))
    epoch, iters = (F.col("event_id") % 20 + 1).cast("string"), (F.col("event_id") % 1000).cast("string")
    step = F.concat(F.lit("(epoch: "), epoch, F.lit(", iters: "), iters, F.lit(", time: 0.1, data: 0.2) G_GAN: "), value)
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("End of epoch "), epoch)).when(F.col("event_type") == "error", "warning: loader is slow").otherwise(step)
    return events.select(F.col("user_id").alias("run"), "ts", "event_id", line.alias("line"))


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the log files of a folder as a stream (run: the file's name; ts: when the line was read).

    A file that is there whole is read to its end once; new files are picked up as they come.
    """
    rows = spark.readStream.option("recursiveFileLookup", "true").text(folder)
    name = F.regexp_replace(F.substring_index(F.input_file_name(), "/", -1), r"\.[^.]*$", "")
    return rows.select(name.alias("run"), F.current_timestamp().alias("ts"), F.col("value").alias("line"))


def latest(lines: DataFrame) -> DataFrame:
    """The last iteration line of each run, by time; one state row a run."""
    rows = parsed(lines).where("epoch is not null")
    state = F.struct("epoch", "iters", F.element_at("losses", "G_GAN").alias("gan"))
    return rows.groupBy("run").agg(F.max_by(state, F.struct("ts", "event_id")).alias("s")).select("run", "s.*")


def drained(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Runs a stream over what is there now and returns its last result table."""
    out = Scratch(spark).root

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/table")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(latest(lines_of(event_stream(spark, sf_dir))), spark, "complete")


def stalls(lines: DataFrame, seconds: float, most: int = 20) -> DataFrame:
    """Watchdog per run: rows (run, status, restarts) as runs go silent for ``seconds`` of processing time.

    Iteration lines and epoch ends are progress and start the clock anew; other lines are not.
    After more than ``most`` silences a run is given up.
    """
    progress = parsed(lines).where("epoch is not null or epoch_end").select("run", "ts")

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        restarts = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            restarts += 1
            status = "error" if restarts > most else "stalled"
            if status == "error":
                state.remove()
            else:
                state.update((restarts,))
                state.setTimeoutDuration(int(seconds * 1000))
            yield pd.DataFrame({"run": [key[0]], "status": [status], "restarts": [restarts]})
            return
        for _ in batches:
            pass
        state.update((restarts,))
        state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame({"run": [key[0]], "status": ["running"], "restarts": [restarts]})

    return progress.groupBy("run").applyInPandasWithState(watch, "run long, status string, restarts int", "restarts int", "append", GroupStateTimeout.ProcessingTimeTimeout)


class ReplayBuffer:
    """A pool of earlier items: filled first; then, by a hashed coin, an item is kept and a random earlier one given back."""

    def __init__(self, size: int, seed: str = "0"):
        self.size, self.seed, self.items, self.n = size, seed, [], 0

    def offer(self, item):
        """What goes on in place of item."""
        if not self.size:
            return item
        self.n += 1
        if len(self.items) < self.size:
            self.items.append(item)
            return item
        h = int(hashlib.md5(f"{self.seed}:{self.n}".encode()).hexdigest()[:8], 16)
        if h % 2:
            return item
        slot = (h // 2) % self.size
        out, self.items[slot] = self.items[slot], item
        return out


QUERIES = {"stream_latest_state": stream_latest_state}
ORACLE = {
    "stream_latest_state": """with l as (select user_id as run, ts, event_id, (event_id % 20 + 1)::int as epoch, (event_id % 1000)::int as iters, printf('%.3f', round(coalesce(value, 0.0), 2))::double as gan
      from events where event_type not in ('signup', 'error')), r as (select *, row_number() over (partition by run order by ts desc, event_id desc) as k from l) select run, epoch, iters, gan from r where k = 1"""
}
