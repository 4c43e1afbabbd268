"""Rules over statement statistics.

Each rule ranks the statements of an instance and keeps the first k. A rule is
data (what is eligible, by what it is ranked, how many are kept), so that one
rule or all of them can run in the same pass over the statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks_to_mb, bytes_to_mb, query_id, rounded, scope_of, spill_severity
from ..functions.ranking import ranked_top, top_k
from .config import keep_tracked, tracking_enabled

MIN_COVERING_CALLS = 5
MIN_WILDCARD_CALLS = 2
MIN_TOTAL_MS = 100
MIN_SPILL_MB = 1
# Patterns over normalised statements (fixed values).
EQUALITY_FILTER = r"WHERE\s+\S+\s*=\s*\$[0-9]"
CATALOG_NAMES = ("%pg_stat%", "%pg_class%", "%pg_index%", "%information_schema%")
SCANNABLE_KINDS = ("SELECT %", "INSERT %", "UPDATE %", "DELETE %", "WITH %")
WILDCARD_LIKE_LABEL = "LIKE with a leading wildcard"
WILDCARD_ILIKE_LABEL = "ILIKE with a leading wildcard"


def _none_of(patterns: Sequence[str]) -> Column:
    query = F.col("query")
    condition = F.lit(True)
    for pattern in patterns:
        condition = condition & ~query.ilike(pattern)
    return condition


def total_ms() -> Column:
    return F.col("total_exec_time").cast("double")


def mean_exact() -> Column:
    """Mean time by its decimal digits."""
    return F.try_divide(F.col("total_exec_time"), F.col("calls"))


def mean_ms() -> Column:
    return F.try_divide(total_ms(), F.col("calls"))


def _reads_by_equality() -> Column:
    query = F.col("query")
    return (
        query.ilike("SELECT%")
        & query.rlike(EQUALITY_FILTER)
        & _none_of(("SELECT *%", "SELECT count(*)%", *CATALOG_NAMES))
        & (F.col("calls") >= MIN_COVERING_CALLS)
    )


def _searches_by_wildcard() -> Column:
    return (
        F.col("has_wildcard")
        & _none_of(("%pg_%", "%information_schema%"))
        & (F.col("calls") >= MIN_WILDCARD_CALLS)
    )


def _may_scan() -> Column:
    query = F.col("query")
    kinds = F.lit(False)
    for kind in SCANNABLE_KINDS:
        kinds = kinds | query.ilike(kind)
    return kinds & _none_of(("SELECT pg_%", "SELECT current_database%", "EXPLAIN %"))


def _is_user_statement() -> Column:
    query = F.col("query")
    return ~query.like("SELECT pg_%") & ~query.like("EXPLAIN %")


def _by_time() -> Column:
    return F.col("total_exec_time")


@dataclass(frozen=True)
class StatementRule:
    name: str
    k: int
    eligible: Callable[[], Column]
    rank_by: Callable[[], Column] = _by_time


COVERING = StatementRule("covering", 15, _reads_by_equality)
WILDCARD = StatementRule("wildcard", 15, _searches_by_wildcard)
SPILL = StatementRule("spill", 5, lambda: F.col("temp_blks_written") > 0,
                      lambda: F.col("temp_blks_written"))
TOP_TIME = StatementRule("top_time", 5, lambda: F.col("total_exec_time") >= MIN_TOTAL_MS)
SCANS = StatementRule("scans", 20, _may_scan)
TOP_20 = StatementRule("top_20", 20, _is_user_statement)


def rank_statements(stmt: DataFrame, rules: Sequence[StatementRule]) -> DataFrame:
    """The kept statements of every rule, marked by ``rule``; ties go by statement text.

    With several rules each statement is tagged with those it is eligible for,
    then one window ranks all of them, so the statistics are read once.
    """
    by = scope_of(stmt)
    if len(rules) == 1:
        rule = rules[0]
        kept = top_k(stmt.where(rule.eligible()), rule.k, by,
                     rule.rank_by().desc(), F.col("query").asc())
        return kept.withColumn("rule", F.lit(rule.name))
    tags = F.array_compact(
        F.array(
            *[
                F.when(rule.eligible(), F.struct(
                    F.lit(rule.name).alias("rule"), F.lit(rule.k).alias("k"),
                    rule.rank_by().cast("decimal(28,2)").alias("score")))
                for rule in rules
            ]
        )
    )
    tagged = stmt.select("*", F.inline(tags))
    most = max(rule.k for rule in rules)
    kept = ranked_top(tagged, most, [*by, "rule"], F.col("score").desc(), F.col("query").asc())
    return kept.where(F.col("rank") <= F.col("k")).drop("rank", "k", "score")


def cache_hit_pct() -> Column:
    hit, read = F.col("shared_blks_hit"), F.col("shared_blks_read")
    return F.when(
        hit + read > 0, rounded(F.try_divide(100.0 * hit, hit + read), 2)
    ).otherwise(F.lit(100.0))


def wildcard_kind() -> Column:
    return F.when(F.col("has_ilike"), F.lit(WILDCARD_ILIKE_LABEL)).otherwise(
        F.lit(WILDCARD_LIKE_LABEL)
    )


def wildcard_severity() -> Column:
    return (
        F.when((F.col("calls") > 100) & (mean_ms() > 500), F.lit("HIGH"))
        .when((F.col("calls") > 50) | (mean_ms() > 1000), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def temp_mb() -> Column:
    return blocks_to_mb(F.col("temp_blks_written"))


def covering_candidates(stmt: DataFrame) -> DataFrame:
    """Frequent reads filtered by equality that an index with included columns could answer."""
    ranked = rank_statements(stmt, [COVERING])
    return ranked.select(
        *scope_of(stmt),
        F.left("query", F.lit(200)).alias("query_sample"),
        F.col("calls").alias("total_executions"),
        total_ms().alias("total_time_ms"),
        rounded(mean_exact()).alias("avg_time_ms"),
        F.col("temp_blks_written").alias("temp_blocks"),
        cache_hit_pct().alias("cache_hit_pct"),
    )


def leading_wildcards(stmt: DataFrame) -> DataFrame:
    """Repeated searches by ``LIKE '%…%'``, which no ordinary index serves."""
    ranked = rank_statements(stmt, [WILDCARD])
    return ranked.select(
        *scope_of(stmt),
        F.left("query", F.lit(250)).alias("query_sample"),
        F.col("calls").alias("total_executions"),
        total_ms().alias("total_time_ms"),
        rounded(mean_exact()).alias("avg_ms"),
        wildcard_kind().alias("anti_pattern_type"),
        wildcard_severity().alias("severity"),
    )


def spilling_statements(stmt: DataFrame) -> DataFrame:
    """The statements of each instance that wrote most temporary blocks, at least 1 MB."""
    ranked = rank_statements(stmt, [SPILL]).where(temp_mb() >= MIN_SPILL_MB)
    read = F.col("temp_blks_read") if "temp_blks_read" in stmt.columns else F.lit(None)
    return ranked.select(
        *scope_of(stmt),
        F.lit("Temporary files in use").alias("title"),
        spill_severity(temp_mb()).alias("severity"),
        temp_mb().alias("temp_mb"),
        F.left("query", F.lit(300)).alias("query_sample"),
        "calls",
        total_ms().alias("total_exec_time"),
        rounded(mean_exact()).alias("mean_exec_time"),
        read.cast("bigint").alias("temp_blks_read"),
        "temp_blks_written",
    )


def untracked_instances(ext: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """Instances whose statements cannot be judged, as the card shown instead."""
    missing = tracking_enabled(ext, instances).where(~F.col("enabled"))
    return missing.select(
        *scope_of(ext),
        F.lit("Statement statistics are not enabled").alias("title"),
        F.lit("LOW").alias("severity"),
    )


def temp_spills(
    stmt: DataFrame, ext: DataFrame, instances: DataFrame | None = None
) -> DataFrame:
    """Spilling statements where tracking is on, one LOW card per instance where it is off."""
    return keep_tracked(spilling_statements(stmt), ext).unionByName(
        untracked_instances(ext, instances), allowMissingColumns=True
    )


def top_time_statements(stmt: DataFrame, ext: DataFrame) -> DataFrame:
    """The statements of each instance with the largest total time, from 100 ms."""
    ranked = keep_tracked(rank_statements(stmt, [TOP_TIME]), ext)
    return ranked.select(
        *scope_of(stmt),
        F.lit("Statement with a high total time").alias("title"),
        F.lit("MEDIUM").alias("severity"),
        F.left("query", F.lit(300)).alias("query_sample"),
        "calls",
        total_ms().alias("total_exec_time"),
        rounded(mean_exact()).alias("mean_exec_time"),
        F.col("rows_out").alias("rows"),
    )


def database_temp_usage(dbtemp: DataFrame) -> DataFrame:
    """Databases that wrote temporary files at all."""
    mb = bytes_to_mb(F.col("temp_bytes"))
    return dbtemp.where(F.col("temp_files") > 0).select(
        *scope_of(dbtemp), "datname", "temp_files", mb.alias("temp_mb"),
        spill_severity(mb).alias("severity"),
    )


def top_statements(stmt: DataFrame) -> DataFrame:
    """The twenty statements of each instance with the largest total time."""
    ranked = rank_statements(stmt, [TOP_20])
    return ranked.select(
        *scope_of(stmt), query_id(F.col("query")).alias("queryid"), "query", "calls",
        total_ms().alias("total_time"),
    )
