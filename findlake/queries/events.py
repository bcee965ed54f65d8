"""Job logs, breakers, limits and weekly series over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.plans import bindings as b
from findlake.registry import query
from findlake.streaming import expiry, jobs

_LOG = "log AS (SELECT user_id AS job_id, event_id AS seq, ts, event_type AS stage, value FROM events)"


@query("f114_cursor_replay", f"WITH {_LOG} SELECT job_id, seq, stage FROM log WHERE seq > job_id * 10")
def cursor_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each job after its reader's cursor (here: ten times its number)."""
    return b.log(spark, sf_dir).where("seq > job_id * 10").select("job_id", "seq", "stage")


@query("f115_latest_state", f"WITH {_LOG} SELECT job_id, max(seq) AS seq, max_by(stage, seq) AS stage, count(*) AS events FROM log GROUP BY job_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_state(b.log(spark, sf_dir))


@query("f115_stream_latest_state", f"WITH {_LOG} SELECT job_id, max(seq) AS seq, max_by(stage, seq) AS stage, count(*) AS events FROM log GROUP BY job_id")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over the events table, run until the table is read."""
    return jobs.run_once(spark, jobs.latest_state(jobs.read_log(spark, sf_dir)), "complete")


@query("f116_recovery_state", f"WITH {_LOG}, m AS (SELECT max(ts) AS now FROM log), l AS (SELECT job_id, max_by(stage, seq) AS stage, max(ts) AS ts FROM log GROUP BY job_id) SELECT c_custkey AS job_id, CASE WHEN l.job_id IS NULL THEN 'unknown' WHEN stage = 'purchase' THEN 'succeeded' WHEN stage = 'error' THEN 'failed' WHEN now - ts > INTERVAL 6 HOUR THEN 'interrupted' ELSE 'running' END AS state FROM customer LEFT JOIN l ON c_custkey = l.job_id, m")
def recovery_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every known job (a customer each): its last event, or that it broke off, or that there is none."""
    log = b.log(spark, sf_dir)
    last = log.groupBy("job_id").agg(F.max_by("stage", "seq").alias("stage"), F.max("ts").alias("ts"))
    now = log.agg(F.max("ts").alias("now"))
    known = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")).join(last, "job_id", "left").crossJoin(F.broadcast(now))  # one row
    state = F.when(F.col("stage").isNull(), "unknown").when(F.col("stage") == "purchase", "succeeded").when(F.col("stage") == "error", "failed").when(F.col("now") - F.col("ts") > F.expr("INTERVAL '6' HOUR"), "interrupted").otherwise("running")
    return known.select("job_id", state.alias("state"))


@query("f117_retention", f"WITH {_LOG}, m AS (SELECT max(ts) AS now FROM log) SELECT job_id, seq FROM log, m WHERE ts >= now - INTERVAL 2 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last two days of the log."""
    log = b.log(spark, sf_dir)
    now = log.agg(F.max("ts").alias("now"))
    return log.crossJoin(F.broadcast(now)).where("ts >= now - interval '2' day").select("job_id", "seq")  # one row


#: Milliseconds without an event after which a run of a job has ended.
QUIET = 12 * 3_600_000
_ENDED = f"""WITH {_LOG}, e AS (SELECT *, epoch_ms(CAST(ts AS TIMESTAMP)) AS t FROM log), b AS (SELECT *, CASE WHEN t - lag(t) OVER o <= {QUIET} THEN 0 ELSE 1 END AS fresh FROM e WINDOW o AS (PARTITION BY job_id ORDER BY ts, seq)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, seq) AS run FROM b), g AS (SELECT job_id, run, min(seq) AS first_seq, max(seq) AS seq, max_by(stage, seq) AS stage, CAST(count(*) AS INT) AS events, max(t) AS last FROM r GROUP BY job_id, run)
SELECT job_id, first_seq, seq, stage, events FROM g QUALIFY lead(run) OVER (PARTITION BY job_id ORDER BY run) IS NOT NULL OR last + {QUIET} <= (SELECT max(t) FROM e)"""


@query("f117_ended_runs", _ENDED)
def ended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of jobs that have ended, for nothing came in twelve hours."""
    return expiry.ended(b.log(spark, sf_dir), QUIET)


@query("f117_stream_ended_runs", _ENDED)
def stream_ended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over the events, with state that the watermark clears."""
    return jobs.run_once(spark, expiry.stream_ended(jobs.read_log(spark, sf_dir), QUIET), "append")


_BREAKER = """numbered AS (SELECT user_id AS key, event_id, epoch(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""


@query("f118_circuit_breaker", f"""WITH RECURSIVE {_BREAKER}, run AS (
  SELECT key, k, CASE WHEN bad THEN 1 ELSE 0 END AS streak, CAST(NULL AS DOUBLE) AS opened, 0 AS trips, 0 AS refused FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.key, n.k,
    CASE WHEN opened IS NOT NULL AND t - opened < 86400 THEN streak WHEN NOT bad THEN 0 WHEN CASE WHEN opened IS NOT NULL THEN 0 ELSE streak END + 1 >= 3 THEN 0 ELSE CASE WHEN opened IS NOT NULL THEN 0 ELSE streak END + 1 END,
    CASE WHEN opened IS NOT NULL AND t - opened < 86400 THEN opened WHEN bad AND CASE WHEN opened IS NOT NULL THEN 0 ELSE streak END + 1 >= 3 THEN t END,
    trips + CASE WHEN NOT (opened IS NOT NULL AND t - opened < 86400) AND bad AND CASE WHEN opened IS NOT NULL THEN 0 ELSE streak END + 1 >= 3 THEN 1 ELSE 0 END,
    refused + CASE WHEN opened IS NOT NULL AND t - opened < 86400 THEN 1 ELSE 0 END
  FROM run r JOIN numbered n ON n.key = r.key AND n.k = r.k + 1)
SELECT key, CAST(max_by(trips, k) AS INT) AS trips, CAST(max_by(refused, k) AS INT) AS refused FROM run GROUP BY key""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.breaker(b.log(spark, sf_dir).select(F.col("job_id").alias("key"), "seq", "ts", (F.col("stage") == "error").alias("bad")))


@query("f118_stream_circuit_breaker")
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker as a stateful stream; held against the batch form in tests."""
    return jobs.run_once(spark, jobs.stream_breaker(jobs.read_log(spark, sf_dir)), "update")


@query("f119_fallback_routing", "WITH a AS (SELECT conv_id, list(CASE length(text) % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'busy' WHEN 2 THEN 'missing' ELSE 'denied' END ORDER BY turn) AS outcomes FROM conversations GROUP BY conv_id), p AS (SELECT *, list_position(outcomes, 'ok') AS ok, list_position(outcomes, 'denied') AS bad FROM a) SELECT conv_id, CASE WHEN ok > 0 AND (coalesce(bad, 0) = 0 OR ok < bad) THEN 'served' WHEN bad > 0 THEN 'fatal' WHEN len(list_filter(outcomes, lambda x: x = 'missing')) = len(outcomes) THEN 'unreachable' ELSE 'exhausted' END AS result, CAST(CASE WHEN ok > 0 AND (coalesce(bad, 0) = 0 OR ok < bad) THEN ok WHEN bad > 0 THEN bad ELSE len(outcomes) END AS INT) AS tried FROM p")
def fallback_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which outcome of an ordered list of attempts counts: the first success or fatal one, else the chain's."""
    n = F.length("text") % 4
    outcome = F.when(n == 0, "ok").when(n == 1, "busy").when(n == 2, "missing").otherwise("denied")
    a = b.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", outcome.alias("o")))), lambda x: x["o"]).alias("outcomes"))
    ok, bad = F.array_position("outcomes", "ok"), F.array_position("outcomes", "denied")
    served = (ok > 0) & ((bad == 0) | (ok < bad))
    result = F.when(served, "served").when(bad > 0, "fatal").when(F.forall("outcomes", lambda x: x == "missing"), "unreachable").otherwise("exhausted")
    return a.select("conv_id", result.alias("result"), F.when(served, ok).when(bad > 0, bad).otherwise(F.size("outcomes")).cast("int").alias("tried"))


@query("f120_rate_limit", f"WITH {_LOG} SELECT job_id, seq, row_number() OVER (PARTITION BY job_id, date_trunc('day', ts) ORDER BY ts, seq) <= 3 AS allowed FROM log")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a day and key, in clock-aligned days."""
    return jobs.rate_limited(b.log(spark, sf_dir), "1 day", 3).select("job_id", "seq", "allowed")


@query("f121_probe_cache", f"""WITH RECURSIVE n AS (SELECT user_id AS key, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), run AS (SELECT key, k, t AS last, 1 AS probes FROM n WHERE k = 1 UNION ALL SELECT n.key, n.k, CASE WHEN t - last >= 86400 THEN t ELSE last END, probes + CASE WHEN t - last >= 86400 THEN 1 ELSE 0 END FROM run r JOIN n ON n.key = r.key AND n.k = r.k + 1) SELECT key, CAST(max(probes) AS INT) AS probes FROM run GROUP BY key""")
def probe_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a value that is kept for a day is fetched anew."""
    return jobs.refreshes(b.log(spark, sf_dir).select(F.col("job_id").alias("key"), "seq", "ts"), 86_400.0)


@query("f122_weekly_counts", f"WITH {_LOG} SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS week, stage, count(*) AS n FROM log GROUP BY ALL")
def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.weekly(b.log(spark, sf_dir))


@query("f122_stream_weekly_counts", f"WITH {_LOG} SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS week, stage, count(*) AS n FROM log GROUP BY ALL")
def stream_weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(spark, jobs.weekly(jobs.read_log(spark, sf_dir)), "complete")


@query("f102_json_path", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("f071_durations", f"WITH {_LOG} SELECT job_id, round(epoch(max(ts)) - epoch(min(ts)), 2) AS seconds FROM log GROUP BY job_id")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = lambda c: F.unix_micros(c) / 1e6
    return b.log(spark, sf_dir).groupBy("job_id").agg(F.round(seconds(F.max("ts")) - seconds(F.min("ts")), 2).alias("seconds"))


@query("f112_window_filters", f"WITH {_LOG}, m AS (SELECT max(ts) AS now FROM log) SELECT job_id, count_if(ts >= now - INTERVAL 1 DAY) AS day, count_if(ts >= now - INTERVAL 7 DAY) AS week FROM log, m GROUP BY job_id")
def window_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = b.log(spark, sf_dir)
    now = log.agg(F.max("ts").alias("now"))
    j = log.crossJoin(F.broadcast(now))  # one row
    return j.groupBy("job_id").agg(F.count_if(F.expr("ts >= now - interval '1' day")).alias("day"), F.count_if(F.expr("ts >= now - interval '7' day")).alias("week"))


@query("f126_job_rows", f"WITH {_LOG} SELECT job_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS week, CASE WHEN bool_or(stage = 'error') THEN 'failed' WHEN bool_or(stage = 'purchase') THEN 'succeeded' ELSE 'running' END AS status, min(seq) AS started, max(seq) AS updated FROM log GROUP BY ALL")
def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a job and week from all events of the week: what its durable row would say if each week were a run."""
    week = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("long")
    return _job_rows(b.log(spark, sf_dir).withColumn("week", week), "week")


def _job_rows(log: DataFrame, *also: str) -> DataFrame:
    status = F.when(F.bool_or(F.col("stage") == "error"), "failed").when(F.bool_or(F.col("stage") == "purchase"), "succeeded").otherwise("running")
    return log.groupBy("job_id", *also).agg(status.alias("status"), F.min("seq").alias("started"), F.max("seq").alias("updated"))


@query("f126_all_job_rows", f"WITH {_LOG} SELECT job_id, CASE WHEN bool_or(stage = 'error') THEN 'failed' WHEN bool_or(stage = 'purchase') THEN 'succeeded' ELSE 'running' END AS status, min(seq) AS started, max(seq) AS updated FROM log GROUP BY job_id")
def all_job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a job from all its events."""
    return _job_rows(b.log(spark, sf_dir))


@query("f091_ordered_dedup", f"WITH {_LOG}, f AS (SELECT job_id, stage, min(seq) AS s FROM log GROUP BY ALL) SELECT job_id, string_agg(stage, '>' ORDER BY s) AS stages FROM f GROUP BY job_id")
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of a job in the order in which each first came."""
    first = b.log(spark, sf_dir).groupBy("job_id", "stage").agg(F.min("seq").alias("s"))
    return first.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "stage"))), lambda x: x["stage"]), ">").alias("stages"))


@query("f019_change_counts", "SELECT user_id AS path, count(*) AS changes FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY user_id")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = b.log(spark, sf_dir)
    now = log.agg(F.max("ts").alias("now"))
    return log.crossJoin(F.broadcast(now)).where("ts >= now - interval '14' day").groupBy(F.col("job_id").alias("path")).agg(F.count("*").alias("changes"))  # one row


@query("f043_consecutive_errors", "WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events), r AS (SELECT user_id, g, count(*) AS n FROM n WHERE event_type = 'error' GROUP BY ALL) SELECT user_id, max(n) AS longest FROM r GROUP BY user_id")
def consecutive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of errors of each job, from two row numbers."""
    e = b.log(spark, sf_dir).withColumn("bad", F.col("stage") == "error")
    w = Window.partitionBy("job_id").orderBy("ts", "seq")
    g = F.row_number().over(w) - F.row_number().over(Window.partitionBy("job_id", "bad").orderBy("ts", "seq"))
    runs = e.withColumn("g", g).where("bad").groupBy("job_id", "g").agg(F.count("*").alias("n"))
    return runs.groupBy(F.col("job_id").alias("user_id")).agg(F.max("n").alias("longest"))
