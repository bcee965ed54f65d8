"""Jobs of a log that end when nothing has come for a time, as sessions whose state the watermark clears, on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stream_ended(log: DataFrame, quiet: int, late: str = "0 seconds") -> DataFrame:
    """Runs of a stream of log rows (job_id, seq, ts, stage) that have ended by its watermark, `late` behind the newest event:
    job_id, first_seq and seq (first and last event), stage of the last one, and events, how many different ones.

    A run is a session of its job: it ends `quiet` milliseconds after its last event, and its state goes when the watermark
    is there. Events that are repeated are told while the watermark lets them come at all, and one that comes late joins
    what lies on both sides of it. The state store has to be the one on disk: state is a row for each event that the
    watermark has not passed and one for each open run, and does not grow with memory."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log.select("job_id", "seq", F.date_trunc("millisecond", "ts").alias("ts"), "stage").withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "seq"])
    runs = rows.groupBy("job_id", F.session_window("ts", f"{quiet} milliseconds")).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("stage", "seq").alias("stage"), F.count("*").cast("int").alias("events")
    )
    return runs.select("job_id", "first_seq", F.col("last_seq").alias("seq"), "stage", "events")


def ended(log: DataFrame, quiet: int) -> DataFrame:
    """The same from a table: runs apart by more than `quiet` milliseconds, without those that the newest event leaves open."""
    order = Window.partitionBy("job_id").orderBy("ts", "seq")
    rows = log.select("job_id", "seq", "ts", "stage").dropDuplicates(["job_id", "seq"]).withColumn("at", F.unix_millis("ts"))
    begins = F.coalesce(F.col("at") - F.lag("at").over(order) > quiet, F.lit(True)).cast("int")
    runs = rows.withColumn("run", begins).withColumn("run", F.sum("run").over(order)).groupBy("job_id", "run").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("seq"), F.max_by("stage", "seq").alias("stage"), F.count("*").cast("int").alias("events"), F.max("at").alias("last")
    )
    newest = log.agg(F.unix_millis(F.max("ts")).alias("now"))
    after = F.lead("run").over(Window.partitionBy("job_id").orderBy("run")).isNotNull()
    done = runs.withColumn("followed", after).crossJoin(F.broadcast(newest)).where("followed or last + " + str(quiet) + " <= now")  # one row
    return done.select("job_id", "first_seq", "seq", "stage", "events")
