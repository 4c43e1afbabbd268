"""Raw statement log to statement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fingerprint, is_wildcard_ilike, is_wildcard_search, scope_of

COUNTERS = ("rows_out", "temp_blks_written", "shared_blks_hit", "shared_blks_read")


def rollup_aggregates(log: DataFrame) -> list[Column]:
    """The sums and flags of one statement.

    All buffers have a fixed width, so Spark keeps the rollup a hash
    aggregation with a map-side half; times are summed in DECIMAL, which makes
    the sum independent of row order. The raw text is represented by the id of
    its first execution instead of a string minimum, which would need a sort.
    """
    counters = [c for c in (*COUNTERS, "temp_blks_read") if c in log.columns]
    return [
        F.count("*").alias("calls"),
        F.sum(F.col("exec_ms").cast("decimal(12,2)")).alias("total_exec_time"),
        *[F.sum(c).alias(c) for c in counters],
        F.bool_or("_wildcard").alias("has_wildcard"),
        F.bool_or("_ilike").alias("has_ilike"),
        F.min("exec_id").alias("sample_exec_id"),
    ]


def normalise_log(log: DataFrame, literals: str = "operands") -> DataFrame:
    """The log with normalised text and the flags that need the raw text."""
    return (
        log.withColumn("query", fingerprint(F.col("sql_text"), literals))
        .withColumn("_wildcard", is_wildcard_search(F.col("sql_text")))
        .withColumn("_ilike", is_wildcard_ilike(F.col("sql_text")))
    )


def statement_rollup(log: DataFrame, literals: str = "operands") -> DataFrame:
    """Statement statistics per instance and normalised statement.

    A log that carries the server's statement id keeps it, as ``queryid``.
    """
    normal = normalise_log(log, literals)
    own = ["queryid"] if "queryid" in log.columns else []
    return normal.groupBy(*scope_of(log), *own, "query").agg(*rollup_aggregates(log))


def with_sample_text(stmt: DataFrame, log: DataFrame) -> DataFrame:
    """Add the raw text of each statement's first execution; meant for reported rows."""
    by = [c for c in scope_of(stmt) if c in log.columns]
    texts = log.select(*by, F.col("exec_id").alias("sample_exec_id"),
                       F.col("sql_text").alias("sample_text"))
    return stmt.join(texts, [*by, "sample_exec_id"], "left")
