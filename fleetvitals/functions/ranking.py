"""Top-k per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_top(
    df: DataFrame, k: int, by: Sequence[str], *order: Column, rank: str = "rank"
) -> DataFrame:
    """The first k rows of every group with their rank.

    Spark turns ``row_number() <= k`` into a group limit before the shuffle, so
    a group that holds most rows sends at most k rows per task to its reducer.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_k(df: DataFrame, k: int, by: Sequence[str], *order: Column) -> DataFrame:
    """The first k rows of every group."""
    return ranked_top(df, k, by, *order, rank="_rank").drop("_rank")
