"""What separates one audited instance (and capture) from another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = ("instance_id", "captured_at")


def scope_of(df: DataFrame) -> list[str]:
    """The scope columns a relation carries."""
    return [name for name in SCOPE if name in df.columns]


def join_keys(left: DataFrame, right: DataFrame, *ids: str) -> list[str]:
    """Equi-join keys of two relations: the scope both carry, then the object ids.

    Object ids are unique only inside an instance, so a join must add the scope
    wherever both sides have it.
    """
    return [
        name for name in (*SCOPE, *ids) if name in left.columns and name in right.columns
    ]


# So many rows of a key join or a distinct are for one task, however well they compress.
TASK_ROWS = 1 << 18


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` moved by its keys to as many tasks as `rows` rows need, so that more rows make more
    tasks, not larger ones; few rows are left to the session's own partitions."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df


# Schemas of the server itself, and how those of its out-of-line storage begin, also of
# temporary tables (fixed values).
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")
TOAST_SCHEMAS = "pg_toast"


def is_user_object() -> Column:
    """Whether a table's schema is one of users."""
    schema = F.col("schema_name")
    return ~(schema.isin(*SYSTEM_SCHEMAS) | schema.startswith(TOAST_SCHEMAS))
