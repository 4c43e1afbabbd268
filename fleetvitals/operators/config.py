"""Server settings: memory, statement tracking, slow-statement logging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scope_of, setting_to_mb

MIN_WORK_MEM_MB = 16
MIN_SHARED_BUFFERS_MB = 256
MIN_TRACKED_STATEMENTS = 1000
FEW_TRACKED_STATEMENTS = 500
TRACKING_EXTENSION = "pg_stat_statements"
MEMORY_SETTINGS = ("work_mem", "shared_buffers")
TRACKING_LIMIT = "pg_stat_statements.max"
SLOW_LOG = "log_min_duration_statement"
# Settings the rules read (fixed values).
AUDITED_SETTINGS = (*MEMORY_SETTINGS, TRACKING_LIMIT, SLOW_LOG)


def value_mb() -> Column:
    return setting_to_mb(F.col("setting"), F.col("unit"))


def work_mem_is_low() -> Column:
    return (F.col("name") == "work_mem") & (value_mb() < MIN_WORK_MEM_MB)


def shared_buffers_are_low() -> Column:
    return (F.col("name") == "shared_buffers") & (value_mb() < MIN_SHARED_BUFFERS_MB)


def tracking_limit_is_low() -> Column:
    limit = F.col("setting").try_cast("int")
    return (F.col("name") == TRACKING_LIMIT) & (limit < MIN_TRACKED_STATEMENTS)


def tracking_limit_severity() -> Column:
    limit = F.col("setting").try_cast("int")
    return F.when(limit < FEW_TRACKED_STATEMENTS, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def slow_log_is_off() -> Column:
    return (F.col("name") == SLOW_LOG) & (F.col("setting") == "-1")


def _rows(setting: DataFrame, condition: Column, *columns: Column | str) -> DataFrame:
    return setting.where(condition).select(*scope_of(setting), "name", "setting", *columns)


def memory_settings(setting: DataFrame) -> DataFrame:
    """The current memory settings, for information."""
    return _rows(setting, F.col("name").isin(*MEMORY_SETTINGS), "unit")


def settings_in_mb(setting: DataFrame) -> DataFrame:
    """Memory settings converted from their unit to MB."""
    return _rows(
        setting, F.col("name").isin(*MEMORY_SETTINGS), "unit", value_mb().alias("value_mb")
    )


def low_work_mem(setting: DataFrame) -> DataFrame:
    return _rows(setting, work_mem_is_low(), "unit", value_mb().alias("value_mb"),
                 F.lit("MEDIUM").alias("severity"))


def low_shared_buffers(setting: DataFrame) -> DataFrame:
    return _rows(setting, shared_buffers_are_low(), "unit", value_mb().alias("value_mb"),
                 F.lit("MEDIUM").alias("severity"))


def low_tracking_limit(setting: DataFrame) -> DataFrame:
    return _rows(setting, tracking_limit_is_low(), F.lit("MEDIUM").alias("severity"))


def tracking_enabled(ext: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """Per instance, whether the statement-statistics extension is present.

    `instances` adds the instances that have no extension row at all.
    """
    by = scope_of(ext)
    marks = ext.select(*by, (F.col("extname") == TRACKING_EXTENSION).alias("enabled"))
    if instances is not None:
        marks = marks.unionByName(instances.select(*by, F.lit(False).alias("enabled")))
    return marks.groupBy(*by).agg(F.bool_or("enabled").alias("enabled"))


def tracked_instances(ext: DataFrame) -> DataFrame:
    """The instances that have the statement-statistics extension, each once."""
    return ext.where(F.col("extname") == TRACKING_EXTENSION).select(*scope_of(ext)).distinct()


def keep_tracked(df: DataFrame, ext: DataFrame) -> DataFrame:
    """Rows of instances that have the statement-statistics extension."""
    tracked = tracked_instances(ext)
    return df.join(tracked, [c for c in scope_of(df) if c in tracked.columns], "left_semi")


def tracking_limit_loses_statements(setting: DataFrame, ext: DataFrame) -> DataFrame:
    """A low tracking limit where tracking is in use at all."""
    low = _rows(setting, tracking_limit_is_low(), tracking_limit_severity().alias("severity"))
    return keep_tracked(low, ext)


def slow_log_disabled(setting: DataFrame) -> DataFrame:
    return _rows(setting, slow_log_is_off(), F.lit("MEDIUM").alias("severity"))
