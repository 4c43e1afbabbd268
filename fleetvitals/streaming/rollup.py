"""Statement statistics per day from a growing log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scope_of
from ..functions.clock import as_instant, as_wall_clock
from ..operators.rollup import normalise_log, rollup_aggregates

WINDOW = "1 day"
DELAY = "1 hour"


def _per_window(log: DataFrame, window: str, literals: str) -> DataFrame:
    by = [*scope_of(log), "query"]
    grouped = normalise_log(log, literals).groupBy(F.window("ts", window), *by)
    return grouped.agg(*rollup_aggregates(log)).select(
        as_wall_clock(F.col("window.start")).alias("window_start"),
        as_wall_clock(F.col("window.end")).alias("window_end"),
        *[F.col(c) for c in by],
        "calls", "total_exec_time", "rows_out", "temp_blks_written", "shared_blks_hit",
        "shared_blks_read", "has_wildcard", "has_ilike",
    )


def stream_statement_rollup(
    log: DataFrame, window: str = WINDOW, delay: str = DELAY, literals: str = "operands"
) -> DataFrame:
    """The rollup per tumbling window in UTC; a window is given out once, when the watermark
    has passed its end, and rows that come later are dropped."""
    timed = log.withColumn("ts", as_instant(log, "ts")).withWatermark("ts", delay)
    return _per_window(timed, window, literals)


def batch_statement_rollup(
    log: DataFrame, window: str = WINDOW, literals: str = "operands"
) -> DataFrame:
    """The same windows over a complete log."""
    return _per_window(log.withColumn("ts", as_instant(log, "ts")), window, literals)
