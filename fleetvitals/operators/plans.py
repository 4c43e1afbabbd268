"""Rules over captured execution plans.

A plan belongs to one execution of the log. What its lines say is reduced to a
few values per plan, then per statement, before it meets the ranked statements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import query_id, rounded, scope_of, statement_key
from .config import keep_tracked
from .statements import SCANS, TOP_TIME, mean_exact, rank_statements, total_ms

# Patterns over plan lines (fixed values).
EXTERNAL_SORT = "Sort Method: external merge"
DISK_USE = "Disk:"
BATCHES = r"Batches:\s*(\d+)"
SEQ_SCAN = r"Seq Scan on (\w+)"
KINDS = ("spill", "scan")


def _sort_on_disk() -> Column:
    line = F.col("line")
    return line.contains(EXTERNAL_SORT) | line.contains(DISK_USE)


def _batches() -> Column:
    """The largest batch count a line holds, 0 where it holds none."""
    found = F.regexp_extract_all("line", F.lit(BATCHES), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda n: n.cast("int"))), F.lit(0))


def _scanned_table() -> Column:
    return F.nullif(F.regexp_extract("line", SEQ_SCAN, 1), F.lit(""))


def plan_signals(plan: DataFrame, kinds: Sequence[str] = KINDS, *more: str) -> DataFrame:
    """Per plan that shows one of the wanted signs, with `more` of what a plan has one of.

    ``spill`` gives sort_on_disk and the largest batch count; ``scan`` gives the
    table named by the first line with a sequential scan. Lines without a sign
    are dropped before anything is shuffled.
    """
    lines = plan.select(*scope_of(plan), "plan_id", *more, "line_no", _sort_on_disk().alias("sort_on_disk"),
                        _batches().alias("batches"), _scanned_table().alias("scanned"))
    telling, aggregates = F.lit(False), []
    if "spill" in kinds:
        telling = telling | F.col("sort_on_disk") | (F.col("batches") > 1)
        aggregates += [F.bool_or("sort_on_disk").alias("sort_on_disk"),
                       F.max("batches").alias("batches")]
    if "scan" in kinds:
        telling = telling | F.col("scanned").isNotNull()
        first = F.min(F.when(F.col("scanned").isNotNull(), F.struct("line_no", "scanned")))
        aggregates.append(first.getField("scanned").alias("scanned"))
    return lines.where(telling).groupBy(*scope_of(plan), "plan_id", *more).agg(*aggregates)


def share_ids(stmt: DataFrame, plan: DataFrame) -> bool:
    """Whether statements and plans both carry the server's id of the statement."""
    return "queryid" in stmt.columns and "queryid" in plan.columns


def with_statement_key(stmt: DataFrame, plan: DataFrame) -> DataFrame:
    """Statements with the key their captured plans carry: the server's id of the
    statement where both relations have it, otherwise what equal texts share."""
    own = share_ids(stmt, plan)
    key = F.col("queryid").cast("string") if own else statement_key(F.col("query"))
    return stmt.withColumn("statement", key)


def plans_of(plan: DataFrame, wanted: DataFrame) -> DataFrame:
    """The plan lines of those statements, by the server's id; few statements are wanted,
    so the lines of all others go before anything is made of them."""
    by = [c for c in scope_of(plan) if c in wanted.columns]
    return plan.join(wanted.select(*by, "queryid").distinct(), [*by, "queryid"], "left_semi")


def statement_signals(
    stmt: DataFrame, plan: DataFrame, log: DataFrame | None, kinds: Sequence[str] = KINDS
) -> DataFrame:
    """Signs over all captured plans of a statement; of several scans, the oldest plan's.

    A plan that carries the server's statement id needs no log: only the plans of the
    statements given are looked at. Without ids, a plan's execution in the log gives the
    text, and both sides are reduced to what their texts share.
    """
    if share_ids(stmt, plan):
        joined = plan_signals(plans_of(plan, stmt), kinds, "queryid").withColumn(
            "statement", F.col("queryid").cast("string"))
    else:
        if log is None:
            raise ValueError("plans without the server's statement ids need the statement log")
        signals = plan_signals(plan, kinds)
        by = [c for c in scope_of(signals) if c in log.columns]
        executed = log.select(*by, F.col("exec_id").alias("plan_id"), "sql_text")
        # Texts are read after the join: by all of its tasks, however few files the log has,
        # and only those of executions whose plans show a sign. A key that may be null would
        # be tested, and so computed, before the join; "" is no statement's key.
        key = F.coalesce(statement_key(F.col("sql_text")), F.lit(""))
        joined = signals.join(executed, [*by, "plan_id"]).withColumn("statement", key)
    aggregates = []
    if "spill" in kinds:
        aggregates += [F.bool_or("sort_on_disk").alias("sort_on_disk"),
                       F.max("batches").alias("batches")]
    if "scan" in kinds:
        oldest = F.min(F.when(F.col("scanned").isNotNull(), F.struct("plan_id", "scanned")))
        aggregates.append(oldest.getField("scanned").alias("scanned"))
    return joined.groupBy(*scope_of(joined), "statement").agg(*aggregates)


def is_select() -> Column:
    return F.upper(F.trim("query")).startswith("SELECT")


def _top_selects(stmt: DataFrame, ext: DataFrame, plan: DataFrame) -> DataFrame:
    top = keep_tracked(rank_statements(stmt, [TOP_TIME]), ext)
    return with_statement_key(top.where(is_select()), plan)


def _explained(
    stmt: DataFrame, ext: DataFrame, plan: DataFrame, log: DataFrame | None, condition: Column,
    title: str, *more: str,
) -> DataFrame:
    top = _top_selects(stmt, ext, plan)
    spills = statement_signals(top, plan, log, ("spill",)).where(condition)
    joined = top.join(spills, [*[c for c in scope_of(top) if c in spills.columns], "statement"])
    return joined.select(
        *scope_of(stmt),
        F.lit(title).alias("title"),
        F.lit("HIGH").alias("severity"),
        F.left("query", F.lit(300)).alias("query_sample"),
        "calls",
        total_ms().alias("total_exec_time"),
        rounded(mean_exact()).alias("mean_exec_time"),
        F.col("rows_out").alias("rows"),
        *more,
    )


def sorts_on_disk(
    stmt: DataFrame, ext: DataFrame, plan: DataFrame, log: DataFrame | None = None
) -> DataFrame:
    """Slow reads whose captured plan sorts on disk."""
    return _explained(stmt, ext, plan, log, F.col("sort_on_disk"), "Sort on disk in the plan")


def hash_batches(
    stmt: DataFrame, ext: DataFrame, plan: DataFrame, log: DataFrame | None = None
) -> DataFrame:
    """Slow reads whose captured plan splits a hash into batches."""
    found = _explained(stmt, ext, plan, log, F.col("batches") > 1,
                       "Hash in batches in the plan", "batches")
    return found.withColumnRenamed("batches", "max_batches")


def sequential_scans(
    stmt: DataFrame, plan: DataFrame, log: DataFrame | None = None
) -> DataFrame:
    """Heavy statements whose captured plan scans a table in sequence."""
    top = with_statement_key(rank_statements(stmt, [SCANS]), plan)
    scans = statement_signals(top, plan, log, ("scan",))
    joined = top.join(scans, [*[c for c in scope_of(top) if c in scans.columns], "statement"])
    return joined.select(
        *scope_of(stmt),
        F.concat(F.lit("Sequential scan of "), F.col("scanned"), F.lit(" by statement "),
                 query_id(F.col("query"))).alias("title"),
        F.col("scanned").alias("table_name"),
        F.left("query", F.lit(200)).alias("query"),
        "calls",
    )
