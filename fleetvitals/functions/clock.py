"""Event time for streams, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_wall_clock(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "timestamp_ntz"


def as_instant(df: DataFrame, name: str) -> Column:
    """A TIMESTAMP column, as watermarks need it; a zoneless time is read as UTC."""
    if not _is_wall_clock(df, name):
        return F.col(name)
    return F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone())


def as_wall_clock(instant: Column) -> Column:
    """The UTC wall-clock time of an instant, without a zone."""
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")
