"""How much of a table is older than its retention limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retention_audit(
    df: DataFrame,
    ts: str,
    table_name: str,
    limit_days: int,
    as_of: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Oldest row and share of rows past the limit, for the table or per group.

    `as_of` defaults to the newest row of the table, never the wall clock.
    """
    if as_of is None:
        as_of = df.agg(F.max(ts)).scalar()
    past = F.col(ts) < as_of - F.make_dt_interval(F.lit(limit_days))
    return df.groupBy(*by).agg(
        F.lit(table_name).alias("table_name"),
        F.count(ts).alias("n_rows"),
        F.min(ts).alias("oldest"),
        F.max(ts).alias("newest"),
        F.count_if(past).alias("rows_past_limit"),
        F.try_divide(F.count_if(past), F.count(ts)).alias("share_past_limit"),
    )
