"""Operational health: tables that outgrow one heap, sessions that never end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, grouped, is_user_object, pretty_size, rounded, scope_of
from ..functions.sizes import MIB

LARGE_TABLE_MB = 500
MANY_INSERTS = 100_000
LOW_DELETE_SHARE = 0.05
OPEN_STATES = ("idle in transaction", "active")
MEDIUM_SECONDS = 60
HIGH_SECONDS = 120


def _deletes_are_rare() -> Column:
    share = F.try_divide(F.col("n_tup_del").cast("double"), F.col("n_tup_ins"))
    return (F.col("n_tup_ins") == 0) | (share < LOW_DELETE_SHARE)


def is_partition_candidate(mode: str = "all") -> Column:
    """``all``: large, much inserted, rarely purged plain tables.
    ``any``: one of these is enough, which takes in nearly every user table."""
    user = is_user_object()
    kind, part = F.col("relkind") == "r", ~F.col("relispartition")
    inserts = F.col("n_tup_ins") > MANY_INSERTS
    large = F.col("size_bytes") > LARGE_TABLE_MB * MIB
    if mode == "all":
        return user & kind & part & inserts & large & _deletes_are_rare()
    if mode == "any":
        return user & (kind | part | inserts | large | _deletes_are_rare())
    raise ValueError(f"mode must be 'all' or 'any', not {mode!r}")


def size_mb() -> Column:
    return F.floor(F.col("size_bytes") / MIB)


def delete_ratio_pct() -> Column:
    deleted, inserted = F.col("n_tup_del"), F.col("n_tup_ins")
    return F.when(
        inserted > 0, rounded(F.try_divide(100.0 * deleted, inserted), 2)
    ).otherwise(F.lit(0.0))


def partition_reasons() -> Column:
    reasons = F.array_compact(
        F.array(
            F.when(size_mb() > LARGE_TABLE_MB, F.concat(
                F.lit("takes "), size_mb().cast("string"), F.lit(f" MB (limit {LARGE_TABLE_MB} MB)"))),
            F.when(F.col("n_tup_ins") > MANY_INSERTS, F.concat(
                F.lit("has "), grouped(F.col("n_tup_ins")), F.lit(" inserts"))),
            F.when(delete_ratio_pct() < 100 * LOW_DELETE_SHARE, F.concat(
                F.lit("deletes only "), fixed(delete_ratio_pct()), F.lit("% of its inserts"))),
        )
    )
    return F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(
        F.lit("is a candidate by its growth")
    )


def partition_candidates(rel: DataFrame, mode: str = "all") -> DataFrame:
    """Tables that should be split by range, largest first when ordered by size_bytes."""
    return rel.where(is_partition_candidate(mode)).select(
        *scope_of(rel),
        F.col("schema_name").alias("schemaname"),
        F.col("relname").alias("table_name"),
        pretty_size(F.col("size_bytes")).alias("total_table_size"),
        size_mb().alias("size_mb"),
        F.col("n_tup_ins").alias("total_inserts_history"),
        F.col("n_tup_del").alias("total_deletes_history"),
        delete_ratio_pct().alias("delete_ratio_pct"),
        partition_reasons().alias("reasons"),
        "size_bytes",
    )


def latest_sessions(sess: DataFrame) -> DataFrame:
    """The last state of every session; map-side maxima keep a busy session cheap."""
    last = F.max(F.struct("state_change", "state", "usename")).alias("last")
    return sess.groupBy(*scope_of(sess), "pid").agg(last).select(
        *scope_of(sess), "pid", "last.*"
    )


def long_sessions(
    sess: DataFrame,
    user: str | None,
    as_of: Column | None = None,
    auditor_pid: int | None = None,
) -> DataFrame:
    """Sessions that stay active or idle in a transaction for more than a minute.

    `as_of` is the moment of the audit; by default that of the capture, or where
    it is not kept the newest change, never the wall clock. `user` None audits
    every user.
    """
    if as_of is None and "captured_at" in sess.columns:
        as_of = F.col("captured_at")
    elif as_of is None:
        as_of = sess.agg(F.max("state_change")).scalar()
    seconds = F.timestamp_diff("MICROSECOND", F.col("state_change"), as_of) / 1_000_000
    open_now = F.col("state").isin(*OPEN_STATES)
    if user is not None:
        open_now = open_now & (F.col("usename") == user)
    if auditor_pid is not None:
        open_now = open_now & (F.col("pid") != auditor_pid)
    aged = latest_sessions(sess).where(open_now).withColumn("_seconds", seconds)
    minutes = rounded(F.col("_seconds") / 60, 2)
    return aged.where(F.col("_seconds") > MEDIUM_SECONDS).select(
        *scope_of(sess),
        F.col("pid").alias("session_pid"),
        F.col("state").alias("session_state"),
        minutes.alias("idle_minutes"),
        F.concat(
            F.lit("Session "), F.col("pid").cast("string"), F.lit(" has been "), F.col("state"),
            F.lit(" for "), fixed(minutes), F.lit(" minutes and holds its resources."),
        ).alias("description"),
        F.when(F.col("_seconds") > HIGH_SECONDS, F.lit("HIGH"))
        .otherwise(F.lit("MEDIUM")).alias("severity"),
    )
