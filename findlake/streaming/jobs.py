"""Operators over job logs, each usable on a table and, where it says so, on a stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.sources.folders import shared_folder
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A breaker opens after so many failures in a row and stays open for so many seconds.
FAILURES, COOLDOWN = 3, 86_400.0


def read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of log rows."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"))


def run_once(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is and read its result, which each batch writes to the shared folder.

    In complete mode the last batch holds all, in append mode all batches together; in update mode the last row of a key (its first column) counts."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/out/batch={k}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda df, k: write(df.drop("batch") if "batch" in df.columns else df, k)).start().awaitTermination()
    out = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out/batch=*")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("batch"))
        return out.join(F.broadcast(last), "batch").drop("batch")  # one row
    if mode == "append":
        return out.drop("batch")
    key = out.columns[0]
    rows = F.struct("batch", *[c for c in out.columns if c not in (key, "batch")])
    return out.groupBy(key).agg(F.max_by(rows, "batch").alias("r")).select(key, *[f"r.{c}" for c in out.columns if c not in (key, "batch")])


def latest_state(log: DataFrame) -> DataFrame:
    """The last event of each job; on a stream too."""
    return log.groupBy("job_id").agg(F.max("seq").alias("seq"), F.max_by("stage", "seq").alias("stage"), F.count("*").alias("events"))


def weekly(log: DataFrame) -> DataFrame:
    """Events by week from 2024-01-01 and stage; on a stream too."""
    week = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("long")
    return log.groupBy(week.alias("week"), "stage").agg(F.count("*").alias("n"))


def rate_limited(log: DataFrame, span: str, limit: int) -> DataFrame:
    """Whether each event is among the first `limit` of its job in a clock-aligned window."""
    w = Window.partitionBy("job_id", F.window("ts", span)).orderBy("ts", "seq")
    return log.withColumn("allowed", F.row_number().over(w) <= limit)


def _step(streak: int, opened: float | None, t: float, bad: bool) -> tuple[int, float | None, int, int]:
    """(streak, opened, trips, refused) after an event."""
    if opened is not None and t - opened < COOLDOWN:
        return streak, opened, 0, 1
    streak = 0 if not bad else (0 if opened is not None else streak) + 1
    return (0, t, 1, 0) if streak >= FAILURES else (streak, None, 0, 0)


def breaker(outcomes: DataFrame) -> DataFrame:
    """outcomes (key, seq, ts, bad) -> (key, trips, refused): a fold over each key's events in order."""
    events = F.array_sort(F.collect_list(F.struct("ts", "seq", "bad")))
    grouped = outcomes.groupBy("key").agg(events.alias("e"))
    state = F.struct(F.lit(0).alias("streak"), F.lit(None).cast("double").alias("opened"), F.lit(0).alias("trips"), F.lit(0).alias("refused"))

    def step(acc, e):
        t = F.unix_micros(e["ts"]) / 1e6
        held = F.coalesce(t - acc["opened"] < COOLDOWN, F.lit(False))
        streak = F.when(e["bad"], F.when(acc["opened"].isNotNull(), 0).otherwise(acc["streak"]) + 1).otherwise(0)
        trips = ~held & (streak >= FAILURES)
        return F.struct(
            F.when(held, acc["streak"]).when(trips, 0).otherwise(streak).alias("streak"),
            F.when(held, acc["opened"]).when(trips, t).alias("opened"),
            (acc["trips"] + trips.cast("int")).alias("trips"),
            (acc["refused"] + held.cast("int")).alias("refused"),
        )

    done = grouped.select("key", F.aggregate("e", state, step).alias("s"))
    return done.select("key", "s.trips", "s.refused")


def stream_breaker(log: DataFrame) -> DataFrame:
    """The breaker over a stream of log rows, with its state kept for each job; events of a batch are taken in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, opened, trips, refused = state.get if state.exists else (0, -1.0, 0, 0)
        opened = None if opened < 0 else opened
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for t, stage in zip(rows["ts"], rows["stage"], strict=True):
            streak, opened, a, b = _step(streak, opened, t.timestamp(), stage == "error")
            trips, refused = trips + a, refused + b
        state.update((streak, -1.0 if opened is None else opened, trips, refused))
        yield pd.DataFrame([(key[0], trips, refused)], columns=["key", "trips", "refused"])

    return log.groupBy("job_id").applyInPandasWithState(run, "key long, trips int, refused int", "streak int, opened double, trips int, refused int", "update", GroupStateTimeout.NoTimeout)


def refreshes(reads: DataFrame, ttl: float) -> DataFrame:
    """reads (key, seq, ts) -> (key, probes): how often a value kept for `ttl` seconds is fetched."""
    grouped = reads.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", "seq"))).alias("e"))
    state = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("probes"))

    def step(acc, e):
        t = F.unix_micros(e["ts"]) / 1e6
        stale = F.coalesce(t - acc["last"] >= ttl, F.lit(True))
        return F.struct(F.when(stale, t).otherwise(acc["last"]).alias("last"), (acc["probes"] + stale.cast("int")).alias("probes"))

    return grouped.select("key", F.aggregate("e", state, step, lambda a: a["probes"]).alias("probes"))
