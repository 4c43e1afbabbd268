"""Table bloat, dead rows and switched-off vacuuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_user_object, join_keys, rounded, scope_of

BLOCK_SIZE = 8192
PAGE_HEADER = 24
ALIGNMENT = 8
DEAD_ELEVATED_PCT = 10
DEAD_ALARMING_PCT = 20


def row_widths(col: DataFrame) -> DataFrame:
    """What the page estimate needs from the columns of each table, in one aggregation.

    The width is summed in DECIMAL, so the sum does not depend on row order.
    """
    null_frac = F.coalesce("null_frac", F.lit(0.0)).cast("decimal(12,8)")
    data = (1 - null_frac) * F.coalesce("avg_width", F.lit(0))
    return col.groupBy(*scope_of(col), "relid").agg(
        F.count("*").alias("n_columns"),
        F.count(F.when(F.col("has_stats"), 1)).alias("n_stats"),
        F.max(null_frac).alias("max_null_frac"),
        F.sum(data).cast("double").alias("data_width"),
    )


def _padding(width: Column, align: int) -> Column:
    return F.when(width % align == 0, F.lit(align)).otherwise(width % align)


def page_estimates(
    col: DataFrame, rel: DataFrame, block_size: int = BLOCK_SIZE, align: int = ALIGNMENT
) -> DataFrame:
    """Expected against actual pages for tables and materialised views with full statistics."""
    widths = row_widths(col).where(F.col("n_columns") == F.col("n_stats"))
    stored = rel.where(F.col("relkind").isin("r", "m")).select(
        *scope_of(rel), "relid", "schema_name", "relname", "reltuples", "toasttuples",
        (F.col("relpages") + F.col("toastpages")).alias("pages"),
        F.coalesce(
            F.regexp_extract("reloptions", "fillfactor=([0-9]+)", 1).try_cast("int"), F.lit(100)
        ).alias("fillfactor"),
    )
    joined = stored.join(widths, join_keys(stored, widths, "relid"))
    null_bitmap = F.when(
        F.col("max_null_frac") > 0, F.floor((F.col("n_stats") + 7) / 8)
    ).otherwise(F.lit(0))
    header = 23 + null_bitmap
    usable = block_size - PAGE_HEADER
    toast = F.ceil(F.col("toasttuples") / 4)
    sized = joined.withColumn("header_width", header.cast("bigint")).withColumn(
        "tuple_size",
        4 + F.col("header_width") + F.col("data_width") + 2 * align
        - _padding(F.col("header_width"), align)
        - _padding(F.ceil("data_width"), align),
    )
    rows, size, fill = F.col("reltuples"), F.col("tuple_size"), F.col("fillfactor")
    return sized.withColumn(
        "est_pages", (F.ceil(rows / (F.lit(usable) / size)) + toast).cast("bigint")
    ).withColumn(
        "est_pages_ff",
        (F.ceil(rows / (F.lit(usable) * fill / (size * 100))) + toast).cast("bigint"),
    )


def _excess_pct(expected: str) -> Column:
    extra = F.col("pages") - F.col(expected)
    return F.when(
        (F.col("pages") > 0) & (extra > 0), 100 * extra / F.col("pages").cast("double")
    ).otherwise(F.lit(0.0))


def table_bloat(
    col: DataFrame, rel: DataFrame, block_size: int = BLOCK_SIZE, align: int = ALIGNMENT
) -> DataFrame:
    """Estimated bloat of every table whose column statistics are complete."""
    est = page_estimates(col, rel, block_size, align)
    wasted = F.col("pages") - F.col("est_pages_ff")
    return est.select(
        *scope_of(est),
        F.col("schema_name").alias("schemaname"),
        F.col("relname").alias("tblname"),
        (F.col("pages") * block_size).alias("real_size"),
        ((F.col("pages") - F.col("est_pages")) * block_size).alias("extra_size"),
        _excess_pct("est_pages").alias("extra_pct"),
        "fillfactor",
        F.when(wasted > 0, wasted * block_size).otherwise(F.lit(0)).alias("bloat_size"),
        _excess_pct("est_pages_ff").alias("bloat_pct"),
        F.lit(False).alias("is_na"),
    )


def autovacuum_is_off() -> Column:
    return F.contains(F.col("reloptions"), F.lit("autovacuum_enabled=false"))


def autovacuum_disabled(rel: DataFrame) -> DataFrame:
    """Tables whose storage options switch automatic vacuuming off."""
    return rel.where(autovacuum_is_off()).select(*scope_of(rel), "relname", "reloptions")


def dead_tuple_pct() -> Column:
    live, dead = F.col("n_live_tup"), F.col("n_dead_tup")
    share = 100.0 * dead / (live + dead)
    return F.when(live + dead > 0, rounded(share, 2)).otherwise(F.lit(0.0))


def dead_tuple_band(pct: Column) -> Column:
    return (
        F.when(pct > DEAD_ALARMING_PCT, F.lit("alarming"))
        .when(pct > DEAD_ELEVATED_PCT, F.lit("elevated"))
        .otherwise(F.lit("optimal"))
    )


def dead_tuples(rel: DataFrame) -> DataFrame:
    """Share of dead rows of every user table, with its advice band."""
    measured = rel.where(is_user_object()).withColumn("dead_tuple_pct", dead_tuple_pct())
    return measured.select(
        *scope_of(rel),
        F.col("schema_name").alias("schemaname"),
        F.col("relname").alias("table_name"),
        "n_live_tup",
        "n_dead_tup",
        "dead_tuple_pct",
        dead_tuple_band(F.col("dead_tuple_pct")).alias("band"),
    )
