"""Sessions that stay in one state for too long, found while they do."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.clock import as_instant
from ..operators.health import MEDIUM_SECONDS, OPEN_STATES

DELAY = "10 minutes"
KEYS = ("instance_id", "pid")
OUTPUT = "instance_id long, session_pid long, session_state string, since_us long"
# Sessions are followed in so many shares, by a hash of their key: a call a session costs more
# than its changes do.
SHARES = 1024
# Of the sessions of a share that may still have to be reported the state and since when, and
# the changes the watermark has not passed yet.
STATE = ("instances array<long>, pids array<long>, states array<string>, since_us array<long>, "
         "later_us array<long>, later array<string>, later_users array<string>, "
         "later_instances array<long>, later_pids array<long>")


def _in_time(change: tuple) -> tuple:
    at, entered, by, *_ = change
    return at, entered is not None, entered or "", by is not None, by or ""


def _follow(limit_us: int, user: str | None):
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def follow(
        share: tuple, changes: Iterator[pd.DataFrame], kept: GroupState
    ) -> Iterator[pd.DataFrame]:
        """Take the changes of a share's sessions in time order, as far as the watermark has come."""
        held, later = {}, []
        if kept.exists:
            instances, pids, states, since, *waiting = kept.get
            held = dict(zip(zip(instances, pids, strict=True), zip(states, since, strict=True),
                            strict=True))
            later = list(zip(*waiting, strict=True))
        if not kept.hasTimedOut:
            for frame in changes:
                ids = ([None if k is None else int(k) for k in frame[c].tolist()] for c in KEYS)
                columns = (frame[c].tolist() for c in ("change_us", "state", "usename"))
                later += zip(*columns, *ids, strict=True)
        mark_us = kept.getCurrentWatermarkMs() * 1000
        found = []

        def check(session: tuple, until_us: int) -> bool:
            """Whether the session's stay is reported, now that it has lasted until then."""
            entered, since = held[session]
            if until_us - since > limit_us:
                found.append((*session, entered, since))
                return True
            return False

        for at, entered, by, *ids in sorted((c for c in later if c[0] <= mark_us), key=_in_time):
            session = tuple(ids)
            if session in held:
                check(session, at)
                del held[session]
            if entered in OPEN_STATES and (user is None or by == user):
                held[session] = entered, at
        later = [change for change in later if change[0] > mark_us]
        held = {session: stay for session, stay in held.items() if not check(session, mark_us)}
        wake = [change[0] for change in later] + [since + limit_us for _, since in held.values()]
        if wake:
            kept.update((*_columns(held, 2), *_columns(held.values(), 2), *_columns(later, 5)))
            kept.setTimeoutTimestamp(max(min(wake) // 1000, kept.getCurrentWatermarkMs()) + 1)
        elif kept.exists:
            # Whatever comes next starts new stays: nothing of these is needed.
            kept.remove()
        if found:
            yield pd.DataFrame(found, columns=names)

    return follow


def _columns(rows: Collection[tuple], width: int) -> list[list]:
    return [list(column) for column in zip(*rows, strict=True)] if rows else [[] for _ in range(width)]


def stream_long_sessions(
    sess: DataFrame, user: str | None, limit_seconds: int = MEDIUM_SECONDS, delay: str = DELAY,
    shares: int = SHARES,
) -> DataFrame:
    """A row for every stay in an open state beyond the limit, as soon as the watermark shows it.

    All changes of a pid are followed, as another user may take it over; `user` says
    whose stays are reported (None: everyone's). Changes may arrive in any order within
    `delay`: each waits in the state of its share until the watermark passes it; one
    without a time is left out. A session has state only while a change waits or a stay may
    still have to be reported. More sessions at a time call for more `shares`.
    """
    timed = (
        sess.withColumn("ts", as_instant(sess, "state_change"))
        .withColumn("change_us", F.unix_micros("ts"))
        .where("change_us is not null")
        # As text, since ids beside a null one would become floats in the frames.
        .select(*[F.col(k).cast("long").cast("string").alias(k) for k in KEYS], "state", "usename",
                "change_us", "ts")
        .withColumn("share", F.pmod(F.xxhash64(*KEYS), F.lit(shares)).cast("int"))
        .withWatermark("ts", delay)
    )
    return timed.groupBy("share").applyInPandasWithState(
        _follow(limit_seconds * 1_000_000, user), OUTPUT, STATE, "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def batch_long_sessions(
    sess: DataFrame, user: str | None, until_us: int, limit_seconds: int = MEDIUM_SECONDS
) -> DataFrame:
    """The same stays from a complete log of changes, judged at one moment."""
    order = Window.partitionBy(*KEYS).orderBy("change_us", "state", "usename")
    stays = sess.withColumn("change_us", F.unix_micros(as_instant(sess, "state_change")))
    stays = stays.withColumn("next_us", F.lead("change_us").over(order))
    end = F.least(F.coalesce("next_us", F.lit(until_us)), F.lit(until_us))
    long = F.col("state").isin(*OPEN_STATES) & (end - F.col("change_us") > limit_seconds * 1_000_000)
    if user is not None:
        long = long & (F.col("usename") == user)
    return stays.where(long).select(
        "instance_id", F.col("pid").alias("session_pid"), F.col("state").alias("session_state"),
        F.col("change_us").alias("since_us"),
    )
