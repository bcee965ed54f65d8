"""Runs of jobs that end, on a stream that is stopped and started again, against the table."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from findlake.streaming import expiry

SHAPE = "job_id long, seq long, ts timestamp, stage string"


def test_a_stream_that_is_stopped_gives_each_run_once(spark, tmp_path):
    rng = random.Random(8)
    begin, rows = datetime(2024, 3, 1), []
    for k in range(400):
        rows.append((rng.randrange(12), k, begin + timedelta(minutes=7 * k + rng.randrange(7)), rng.choice("abc")))
    parts = [rows[:150], rows[140:260], rows[255:330], rows[330:]]  # events at the seams come twice
    quiet = 150 * 60_000
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        if k % 2:  # two parts in one run, from where the run before it stopped
            log = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
            query = expiry.stream_ended(log, quiet, late="90 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
    plain = lambda df: sorted(map(tuple, df.collect()))
    got, want = plain(spark.read.parquet(out)), plain(expiry.ended(spark.createDataFrame(rows, SHAPE), quiet))
    assert len(got) == len(set(got)) and set(got) <= set(want) and len(want) > 40
    # what the lateness keeps open is all that the table has besides
    newest = max(r[2] for r in rows)
    last = {r[1]: r[2] for r in rows}
    held = {w for w in want if max(t for j, s, t, _ in rows if j == w[0] and w[1] <= s <= w[2]) + timedelta(milliseconds=quiet) > newest - timedelta(minutes=90)}
    assert set(want) - set(got) <= held and last


def _streamed(spark, folder, parts, quiet, late):
    """What a stream gives over files of rows, a batch for each, as long as it lasts."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        log = spark.readStream.schema(SHAPE).parquet(f"{folder}/log")
        expiry.stream_ended(log, quiet, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.schema("job_id long, first_seq long, seq long, stage string, events int").parquet(f"{folder}/out").collect()))


def test_an_event_that_comes_late_joins_the_runs_around_it(spark, tmp_path):
    at = lambda minutes: datetime(2024, 3, 1) + timedelta(minutes=minutes)
    rows = [(1, 1, at(0), "a"), (1, 3, at(90), "c"), (1, 2, at(45), "b"), (1, 4, at(900), "d"), (2, 5, at(2000), "e")]
    got = _streamed(spark, tmp_path, [rows[:2], rows[2:3], rows[3:]], 60 * 60_000, "300 minutes")
    assert got == [(1, 1, 3, "c", 3), (1, 4, 4, "d", 1)] == sorted(map(tuple, expiry.ended(spark.createDataFrame(rows, SHAPE), 60 * 60_000).collect()))


def test_runs_meet_and_end_to_the_millisecond(spark, tmp_path):
    at = lambda k: datetime(2024, 3, 1) + timedelta(milliseconds=k)
    rows = [(1, 1, at(0), "a"), (1, 2, at(1000), "b"), (2, 3, at(0), "a"), (2, 4, at(1001), "b"), (4, 6, at(4000), "ended"), (5, 7, at(4001), "open"), (3, 5, at(5000), "x"), (3, 5, at(5000), "x")]
    rows += [(6, 8, at(2000.9), "a"), (6, 9, at(3001.01), "b"), (6, 9, at(3001.01), "b")]
    want = sorted(map(tuple, expiry.ended(spark.createDataFrame(rows, SHAPE), 1000).collect()))
    assert _streamed(spark, tmp_path, [rows], 1000, "0 seconds") == want and (4, 6, 6, "ended", 1) in want and not [r for r in want if r[0] in (3, 5)]


def test_no_event_of_a_stream_goes_through_python(spark, tmp_path, capsys):
    expiry.stream_ended(spark.readStream.schema(SHAPE).parquet(str(tmp_path)), 1000).explain()
    plan = capsys.readouterr().out
    assert "Session" in plan and "Python" not in plan and "Pandas" not in plan


def test_no_events(spark):
    assert expiry.ended(spark.createDataFrame([], SHAPE), 1000).count() == 0
