"""Streams over several files must equal their batch forms."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetvitals.streaming import rollup, sessions
from fleetvitals.streaming.run import file_stream, run_available
from helpers import make

START = datetime(2024, 1, 1)


def write_files(frames, folder: str) -> None:
    """One file per frame, read by the stream in this order."""
    for n, frame in enumerate(frames):
        part = f"{folder}/part{n}"
        frame.coalesce(1).write.parquet(part)
        (name,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
        os.rename(f"{part}/{name}", f"{folder}/{n}.parquet")
        at = 1_700_000_000 + 10 * n
        os.utime(f"{folder}/{n}.parquet", (at, at))


def stream_of(spark, folder, schema, files_per_trigger=1):
    return file_stream(spark, folder, schema, "[0-9].parquet", files_per_trigger)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_rollup_equals_batch_for_closed_windows(spark, tmp_path):
    folder = str(tmp_path)
    hours = [[0, 5, 23], [22, 25, 30], [47, 49, 50], [75]]
    frames = [make(spark, "exec", *[
        dict(exec_id=h, ts=START + timedelta(hours=h), exec_ms=1.5,
             sql_text=f"SELECT a WHERE b = {h}") for h in some]) for some in hours]
    write_files(frames, folder)
    stream = rollup.stream_statement_rollup(
        stream_of(spark, folder, frames[0].schema), delay="3 hours")
    streamed = run_available(stream, "test-rollup")
    everything = frames[0]
    for frame in frames[1:]:
        everything = everything.unionByName(frame)
    batch = rollup.batch_statement_rollup(everything)
    closed = batch.where(F.col("window_end") <= F.lit(START + timedelta(hours=72)).cast("timestamp_ntz"))
    names = ("window_start", "query", "calls", "total_exec_time", "rows_out")
    assert rows(streamed, *names) == rows(closed, *names)
    assert sum(r.calls for r in streamed.collect()) == 9


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    folder = str(tmp_path)
    frames = [make(spark, "exec", dict(ts=START + timedelta(hours=h), sql_text="SELECT 1"))
              for h in (1, 60, 61, 2, 90)]
    write_files(frames, folder)
    stream = rollup.stream_statement_rollup(
        stream_of(spark, folder, frames[0].schema), delay="1 hour")
    streamed = run_available(stream, "test-late")
    assert sorted(r.calls for r in streamed.collect()) == [1, 2]


def changes(spark, *marks):
    return make(spark, "sess", *[
        dict(pid=pid, state=state, state_change=START + timedelta(seconds=s))
        for pid, s, state in marks])


@pytest.mark.parametrize("files_per_trigger", [1, 9])
def test_sessions_equal_batch_in_any_order(spark, tmp_path, files_per_trigger):
    folder = str(tmp_path)
    frames = [
        changes(spark, (1, 100, "active"), (1, 0, "idle"), (2, 50, "idle in transaction"),
                (3, 10, "active"), (4, 0, "active")),
        # Out of order within the delay: session 3 ended before its limit.
        changes(spark, (1, 130, "idle"), (3, 60, "idle"), (2, 300, "idle"), (4, 61, "idle")),
        changes(spark, (1, 290, "active"), (5, 280, "idle in transaction"), (3, 310, "active")),
        changes(spark, (9, 700, "idle"), (5, 690, "idle")),
        changes(spark, (9, 1000, "idle")),
    ]
    write_files(frames, folder)
    stream = sessions.stream_long_sessions(
        stream_of(spark, folder, frames[0].schema, files_per_trigger), "app", delay="5 minutes")
    streamed = run_available(stream, "test-sessions")
    everything = frames[0]
    for frame in frames[1:]:
        everything = everything.unionByName(frame)
    until = int((START - datetime(1970, 1, 1)).total_seconds() + 700) * 1_000_000
    batch = sessions.batch_long_sessions(everything, "app", until)
    names = ("instance_id", "session_pid", "session_state", "since_us")
    assert rows(streamed, *names) == rows(batch, *names)
    assert sorted(r.session_pid for r in batch.collect()) == [1, 2, 3, 4, 5]


def test_sessions_share_a_call_and_its_state(spark, tmp_path):
    folder = str(tmp_path)
    pids = [*range(40), None]
    frames = [
        changes(spark, *[(pid, 7 * (pid or 0), "active") for pid in pids]),
        changes(spark, *[(pid, 100 + 5 * (pid or 0), "idle") for pid in pids], (900, 320, "idle")),
        make(spark, "sess", dict(pid=900, state_change=START + timedelta(hours=1)),
             dict(pid=901, state="active", state_change=None)),
    ]
    write_files(frames, folder)
    stream = sessions.stream_long_sessions(
        stream_of(spark, folder, frames[0].schema), "app", delay="5 minutes", shares=3)
    query = (stream.writeStream.format("memory").queryName("shared_sessions").outputMode("append")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    updated = [o["numRowsUpdated"] for p in query.recentProgress for o in p["stateOperators"]]
    assert updated and max(updated) <= 3
    everything = frames[0].unionByName(frames[1]).unionByName(frames[2])
    until = int((START - datetime(1970, 1, 1)).total_seconds() + 3300) * 1_000_000
    names = ("instance_id", "session_pid", "session_state", "since_us")
    key = lambda row: tuple((v is not None, v) for v in row)
    streamed, batch = (sorted([tuple(r[n] for n in names) for r in df.collect()], key=key) for df in (
        spark.table("shared_sessions"), sessions.batch_long_sessions(everything, "app", until)))
    assert streamed == batch and len(batch) == 21


def test_other_users_are_not_followed(spark, tmp_path):
    folder = str(tmp_path)
    frames = [make(spark, "sess", dict(state="active", state_change=START, usename="other"),
                   dict(pid=2, state_change=START + timedelta(hours=1)))]
    write_files(frames, folder)
    stream = sessions.stream_long_sessions(stream_of(spark, folder, frames[0].schema), "app")
    assert run_available(stream, "test-users").count() == 0


def test_a_pid_taken_over_by_another_user_is_a_stay_of_its_own(spark, tmp_path):
    folder = str(tmp_path)
    frames = [make(spark, "sess", dict(state="active", state_change=START),
                   dict(state="active", usename="other", state_change=START + timedelta(seconds=10)),
                   dict(pid=2, usename="other", state_change=START + timedelta(hours=1)))]
    write_files(frames, folder)
    until = int((START - datetime(1970, 1, 1)).total_seconds() + 3000) * 1_000_000
    for user, stays in (("app", []), ("other", [START + timedelta(seconds=10)])):
        stream = sessions.stream_long_sessions(stream_of(spark, folder, frames[0].schema), user)
        got = run_available(stream, "test-reuse").collect()
        batch = sessions.batch_long_sessions(frames[0], user, until).collect()
        wanted = [int((s - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for s in stays]
        assert [r.since_us for r in got] == [r.since_us for r in batch] == wanted


def test_windows_do_not_depend_on_the_session_zone(spark, tmp_path):
    folder = str(tmp_path)
    frames = [make(spark, "exec", *[dict(ts=START + timedelta(hours=h)) for h in (0, 23, 24, 60)])]
    write_files(frames, folder)
    spark.conf.set("spark.sql.session.timeZone", "America/Mexico_City")
    try:
        stream = rollup.stream_statement_rollup(stream_of(spark, folder, frames[0].schema))
        streamed = run_available(stream, "test-zone").collect()
        batch = rollup.batch_statement_rollup(frames[0]).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted((r.window_start, r.calls) for r in streamed) == [
        (START, 2), (START + timedelta(days=1), 1)]
    assert len(batch) == 3 and {r.window_start for r in streamed} < {r.window_start for r in batch}
