
from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_texts
from fleetvitals.functions import pretty_size
from fleetvitals.operators import (
    bloat, config, counters, health, indexes, plans, profile, retention, rollup, statements, workload,
)
from fleetvitals.plans import audit, findings, report
from fleetvitals.session import new_folder
from fleetvitals.sources import plan_files, report_sink
from fleetvitals.sources.fixture_views import (
    SEARCH_TERMS, SUBSET_SEED, FixtureTelemetry, table,
)
from fleetvitals.streaming import rollup as stream_rollup
from fleetvitals.streaming import sessions
from fleetvitals.streaming.run import run_available

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP_DIR = "/root/testdata/sf0.001"
SUBSET_ROWS = 300


def entry(spark: SparkSession) -> DataFrame:
    """The health score of every instance."""
    return queries()["r06_health_score"](spark, FLAGSHIP_DIR)


def _on(build: Callable[..., DataFrame], *names: str, order: tuple = ()) -> Query:
    """An operator over named relations, in the order the report shows it ("-": downwards)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        telemetry = FixtureTelemetry(spark, sf_dir)
        result = build(*[telemetry[n] for n in names])
        columns = [F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc()
                   for n in order]
        return result.orderBy(*columns) if order else result

    return run


def _on_tables(build: Callable[..., DataFrame], *names: str) -> Query:
    """An operator over the driver's own tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*[table(spark, sf_dir, n) for n in names])

    return run


def _on_all(build: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    """A step of the report over all relations."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(FixtureTelemetry(spark, sf_dir).relations())

    return run


def _desc(first: str, *others: str) -> tuple:
    """Order by the first column downwards, then by the others."""
    return (f"-{first}", *others)


def _as_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _profiles(**columns_of: list[str] | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = [profile.column_profile(table(spark, sf_dir, name), name, columns)
                 for name, columns in columns_of.items()]
        return reduce(DataFrame.unionByName, parts)

    return run


def _retention(orders: DataFrame, events: DataFrame) -> DataFrame:
    audits = (retention.retention_audit(orders, "o_orderdate", "orders", 730)
              .unionByName(retention.retention_audit(events, "ts", "events", 14)))
    return audits.withColumns({n: F.col(n).cast("date") for n in ("oldest", "newest")})


def _changes_of_indexes(captures: DataFrame) -> DataFrame:
    changes = counters.counter_changes(captures, "idx")
    days = {c: F.col(c).cast("date") for c in ("captured_at", "previous_at")}
    return changes.withColumns(days).select(
        "instance_id", "relid", "index_name", "captured_at", "previous_at", "idx_scan",
        "idx_tup_read", "idx_tup_fetch", "size_bytes", "was_reset", "exact")


def _sizes(rel: DataFrame) -> DataFrame:
    size, dead = F.col("size_bytes"), F.col("n_dead_tup")
    return rel.select("relid", "size_bytes", pretty_size(size).alias("as_bytes"),
                      pretty_size(size * dead).alias("as_product"),
                      pretty_size(dead).alias("as_small"))


def _findings(*columns: str) -> Query:
    def build(relations: dict[str, DataFrame]) -> DataFrame:
        found = findings.all_findings(relations, columns=columns, session_user="app")
        return found.select("instance_id", *columns)

    return _on_all(build)


def _scores(*columns: str) -> Query:
    return _on_all(lambda r: report.fleet_scores(r, session_user="app").select(
        "instance_id", *columns))


def _severities(relations: dict[str, DataFrame]) -> DataFrame:
    found = findings.all_findings(relations, columns=("detector", "severity"), session_user="app")
    level = report.severity_level(F.col("severity")).alias("severity_level")
    return found.groupBy("instance_id", level).agg(F.count("*").alias("findings"))


def _category_counts(relations: dict[str, DataFrame]) -> DataFrame:
    return report.category_counts(
        findings.all_findings(relations, columns=("category", "detector", "metric"),
                              session_user="app"))


def _nested(relations: dict[str, DataFrame]) -> DataFrame:
    found = report.stored_findings(relations, session_user="app")
    return report.nested_report(found, report.instance_rows(relations))


def _report_contents(relations: dict[str, DataFrame]) -> DataFrame:
    """What the reports say and list for every detector, read back from their JSON."""
    entry = "struct<count:bigint,data:array<struct<object_name:string>>>"
    shape = "struct<categories:map<string,struct<detectors:map<string," + entry + ">>>>"
    parsed = _nested(relations).select("instance_id", F.from_json("report", shape).alias("r"))
    categories = parsed.select("instance_id", F.explode("r.categories").alias("category", "c"))
    detectors = categories.select("instance_id", F.explode("c.detectors").alias("detector", "d"))
    return detectors.select(
        "instance_id", "detector", F.col("d.count").alias("stated"),
        F.size("d.data").cast("bigint").alias("listed"),
        F.size(F.array_distinct("d.data.object_name")).cast("bigint").alias("objects"))


def _isolated(relations: dict[str, DataFrame]) -> DataFrame:
    """The states after an audit whose relations hold values that fail while being read:
    the temporary file counts of every database, and the options of some tables."""
    broken = F.raise_error(F.lit("unreadable value")).cast("bigint")
    dbtemp = relations["dbtemp"].withColumn(
        "temp_bytes", F.when(F.col("temp_files") >= 0, broken).otherwise(F.col("temp_bytes")))
    rel = relations["rel"].withColumn("reloptions", F.when(
        F.col("relid") % 17 == 0, broken.cast("string")).otherwise(F.col("reloptions")))
    folder = f"{new_folder(rel.sparkSession, 'audit')}/fleet"
    stored_audit = audit.run_audit(
        rel.sparkSession, {**relations, "dbtemp": dbtemp, "rel": rel}, folder, session_user="app")
    return stored_audit["status"]


def _plan_log(plan: DataFrame) -> DataFrame:
    folder = f"{new_folder(plan.sparkSession, 'plans')}/log"
    plan_files.write_plan_log(plan, folder)
    return plan_files.read_plan_log(plan.sparkSession, folder).select(
        "instance_id", "plan_id", "line_no", "line")


def _sunk(relations: dict[str, DataFrame]) -> DataFrame:
    columns = ("category", "detector", "object_name", "sql_fix")
    found = findings.all_findings(relations, columns=columns, session_user="app")
    folder = f"{new_folder(found.sparkSession, 'sink')}/findings"
    report_sink.write_findings(found, folder)
    return found.sparkSession.read.schema(found.schema).parquet(folder).select("instance_id", *columns)


def _subset(orders: DataFrame) -> DataFrame:
    drawn = workload.random_subset(orders, SUBSET_ROWS, ["o_orderkey"], SUBSET_SEED)
    return drawn.select("o_orderkey", "o_custkey")


def _without_subset(orders: DataFrame) -> DataFrame:
    return orders.join(_subset(orders), "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def _merged(events: DataFrame) -> DataFrame:
    merged = workload.merge_json(F.col("props"), {"iteration": F.col("event_id") % 5})
    return events.select("event_id", merged.alias("merged"))


def _merged_customers(customer: DataFrame) -> DataFrame:
    """Objects with strings, nested values, decimals and nulls; every seventh is cut off."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit('{"page":"/p/'), key, F.lit('","old":{"a":['), key,
                    F.lit(',"x",null]},"ratio":'), key, F.lit('.25,"iteration":7,"none":null'),
                    F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.lit("}")))
    merged = workload.merge_json(text, {"iteration": F.col("c_custkey") % 5})
    return customer.select("c_custkey", merged.alias("merged"))


def _sorted_orders(orders: DataFrame) -> DataFrame:
    return workload.full_sort(
        orders.select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date")
                      .alias("o_orderdate")),
        F.col("o_totalprice").desc(), F.col("o_orderdate").asc(), F.col("o_orderkey").asc())


def _sorted_join(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return workload.join_sorted(
        orders.select("o_orderkey", "o_custkey", "o_totalprice"),
        customer.select("c_custkey", "c_name"), "o_custkey", "c_custkey",
        F.col("o_totalprice").desc(), F.col("o_orderkey").asc(),
    ).select("o_orderkey", "c_name", "o_totalprice")


def _stream(name: str, build: Callable[[DataFrame], DataFrame], relation: str) -> Query:
    """A streaming operator, run over the files that are there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stream = build(FixtureTelemetry(spark, sf_dir).stream(relation))
        return run_available(stream, name)

    return run


def _daily(log: DataFrame) -> DataFrame:
    rolled = stream_rollup.stream_statement_rollup(log)
    return _as_double(rolled, "total_exec_time").withColumns(
        {n: F.col(n).cast("date") for n in ("window_start", "window_end")})


def _corpus_modules() -> list:
    """The text corpus queries, where their subpackage is there."""
    names = ("fleetvitals.llm.queries", "corpus_pipeline")
    try:
        return [importlib.import_module(name) for name in names]
    except ImportError:
        # The folders or a package that only they need are absent; the other queries go on.
        return []


def queries() -> dict[str, Query]:
    """One entry per operator; each takes (spark, folder of tables)."""
    found = audit_queries()
    for module in _corpus_modules():
        found |= module.queries()
    return found


def audit_queries() -> dict[str, Query]:
    """The queries on database telemetry."""
    statement_plan = ("stmt", "ext", "plan", "exec")
    by_time = _desc("total_time_ms", "instance_id", "query_sample")
    by_exec = _desc("total_exec_time", "instance_id", "query_sample")
    return {
        "d01_missing_partial": _on(
            indexes.missing_partial_indexes, "col", "rel", "idx",
            order=_desc("percent_occurrence", "instance_id", "table_name", "column_name")),
        "d02_fk_without_index": _on(indexes.foreign_keys_without_index, "fk", "idx", "rel", "col"),
        "d03_fk_index_coverage": _on(
            indexes.foreign_key_coverage, "fk", "idx", "rel", "col",
            order=("has_index", "table_name", "constraint_name")),
        "d04_duplicate_indexes": _on(
            lambda *r: indexes.duplicate_indexes(*r).drop("names"), "idx", "rel", "col"),
        "d05_duplicate_strict": _on(indexes.duplicate_indexes_strict, "idx", "rel"),
        "d06_unused_indexes": _on(
            indexes.unused_indexes, "idx", "rel",
            order=_desc("size_bytes", "instance_id", "index_name")),
        "c01_counter_changes": _on(_changes_of_indexes, "idx_captures"),
        "d06_unused_over_captures": _on(
            counters.unused_over_captures, "idx_captures", "rel",
            order=_desc("size_bytes", "instance_id", "index_name")),
        "d16_top_time_over_captures": _on(
            lambda stmt, ext: statements.top_time_statements(counters.activity(stmt, "stmt"), ext),
            "stmt_captures", "ext", order=by_exec),
        "d07_unused_by_scan": _on(
            indexes.unused_indexes_by_scan, "idx", "rel",
            order=_desc("size_bytes", "instance_id", "index_name")),
        "d08_covering_candidates": _on(statements.covering_candidates, "stmt", order=by_time),
        "d09_stale_stats": _on(
            indexes.stale_statistics, "rel",
            order=_desc("divergence_ratio", "instance_id", "table_name")),
        "d10_leading_wildcard": _on(statements.leading_wildcards, "stmt", order=by_time),
        "d11_table_bloat": _on(
            bloat.table_bloat, "col", "rel", order=("schemaname", "tblname")),
        "d12_autovacuum_disabled": _on(bloat.autovacuum_disabled, "rel"),
        "d13_dead_tuples": _on(
            bloat.dead_tuples, "rel", order=_desc("dead_tuple_pct", "instance_id", "table_name")),
        "d14_statement_stats_enabled": _on(config.tracking_enabled, "ext"),
        "d15_temp_spills": _on(
            statements.temp_spills, "stmt", "ext",
            order=_desc("temp_blks_written", "instance_id", "query_sample")),
        "d16_top_time": _on(statements.top_time_statements, "stmt", "ext", order=by_exec),
        "d17_db_temp_usage": _on(
            statements.database_temp_usage, "dbtemp", order=_desc("temp_mb", "instance_id")),
        "d18_explain_sort_spill": _on(plans.sorts_on_disk, *statement_plan, order=by_exec),
        "d19_explain_hash_batches": _on(plans.hash_batches, *statement_plan, order=by_exec),
        "d20_seq_scan": _on(plans.sequential_scans, "stmt", "plan", "exec"),
        "d18_sort_spill_by_id": _on(
            plans.sorts_on_disk, "stmt_ids", "ext", "plan_ids", order=by_exec),
        "d19_hash_batches_by_id": _on(
            plans.hash_batches, "stmt_ids", "ext", "plan_ids", order=by_exec),
        "d20_seq_scan_by_id": _on(plans.sequential_scans, "stmt_ids", "plan_ids"),
        "d21_top_statements": _on(
            statements.top_statements, "stmt", order=_desc("total_time", "instance_id", "query")),
        "d22_memory_settings": _on(config.memory_settings, "setting"),
        "d23_setting_to_mb": _on(config.settings_in_mb, "setting"),
        "d24_work_mem_low": _on(config.low_work_mem, "setting"),
        "d25_shared_buffers_low": _on(config.low_shared_buffers, "setting"),
        "d26_statement_max_low": _on(config.low_tracking_limit, "setting"),
        "d27_statement_limit": _on(config.tracking_limit_loses_statements, "setting", "ext"),
        "d28_slow_log_disabled": _on(config.slow_log_disabled, "setting"),
        "d29_partition_candidates": _on(
            health.partition_candidates, "rel",
            order=_desc("size_bytes", "instance_id", "table_name")),
        "d29_partition_candidates_any": _on(
            lambda rel: health.partition_candidates(rel, mode="any"), "rel",
            order=_desc("size_bytes", "instance_id", "table_name")),
        "d30_long_sessions": _on(lambda sess: health.long_sessions(sess, "app"), "sess"),
        "p01_column_profile": _profiles(
            lineitem=None, orders=None, customer=None, labels=None, documents=None),
        "p01_column_profile_approx": _on_tables(
            lambda t: profile.approx_column_profile(t, "lineitem"), "lineitem"),
        "p01_approx_exact_fields": _on_tables(
            lambda t: profile.approx_column_profile(t, "orders").select(
                "column_name", "n_rows", "null_frac", "avg_width"), "orders"),
        "p02_statement_rollup": _on(
            lambda log: _as_double(rollup.statement_rollup(log), "total_exec_time"), "exec"),
        "p02_statement_rollup_all_literals": _on(
            lambda log: _as_double(rollup.statement_rollup(log, "all"), "total_exec_time"), "exec"),
        "p02_statement_lexer": _on(
            lambda log: rollup.statement_rollup(log, "all").select("instance_id", "query", "calls"),
            "messy"),
        "p03_pretty_size": _on(_sizes, "rel"),
        "p04_retention_audit": _on_tables(_retention, "orders", "events"),
        "r01_findings": _findings(*findings.FINDING_COLUMNS),
        "r02_evidence_text": _findings("detector", "object_name", "evidence"),
        "r03_fix_sql_text": _findings("detector", "object_name", "sql_fix"),
        "r04_category_counts": _on_all(_category_counts),
        "r05_total_findings": _scores("total_findings"),
        "r06_health_score": _scores("penalty", "health_score"),
        "r07_score_label": _scores("health_score", "label"),
        "r08_severity_map": _on_all(_severities),
        "r09_detector_status": _on_all(
            lambda r: report.audit_status(r, session_user="app")),
        "r09_isolated_audit": _on_all(_isolated),
        "r10_report_json": _on_all(_nested),
        "r10_report_contents": _on_all(_report_contents),
        "s03_plan_log": _on(_plan_log, "plan"),
        "s06_report_sink": _on_all(_sunk),
        "w01_count_by_key": _on_tables(lambda t: workload.count_by_key(t, "o_custkey"), "orders"),
        "w02_filtered_count": _on_tables(
            lambda t: workload.filtered_count(t, F.col("p_brand") == "Brand#13",
                                              F.col("p_size") > 10), "part"),
        "w03_sum_sorted": _on_tables(
            lambda t: workload.sum_sorted(t, "l_orderkey", "l_extendedprice"), "lineitem"),
        "w04_full_sort": _on_tables(_sorted_orders, "orders"),
        "w05_join_sorted": _on_tables(_sorted_join, "orders", "customer"),
        "w06_contains_count": _on_tables(
            lambda t: workload.contains_counts(t, "text", SEARCH_TERMS), "documents"),
        "w07_missing_child": _on_tables(
            lambda o, li: workload.without_child(o, li, "o_orderkey", "l_orderkey")
            .select("o_orderkey"), "orders", "lineitem"),
        "w07_not_in": _on_tables(
            lambda o, li: workload.without_child(o, li, "o_orderkey", "l_orderkey", True)
            .select("o_orderkey"), "orders", "lineitem"),
        "w08_lateral_expand": _on_tables(
            lambda o: workload.expand_rows(o, 1 + F.col("o_orderkey") % 5)
            .select("o_orderkey", "n"), "orders"),
        "w09_random_subset": _on_tables(_subset, "orders"),
        "w09_random_delete": _on_tables(_without_subset, "orders"),
        "w10_json_merge": _on_tables(_merged, "events"),
        "w10_json_merge_mixed": _on_tables(_merged_customers, "customer"),
        "w11_derived_columns": _on_tables(workload.derived_parts, "part"),
        "t01_stream_statement_rollup": _stream("rollup", _daily, "exec"),
        "t02_stream_long_sessions": _stream(
            "sessions", lambda sess: sessions.stream_long_sessions(sess, "app"), "sess"),
    }


def oracle_sql() -> dict[str, str]:
    """The same queries as SQL; rows-only queries have no entry."""
    found = oracle_texts.all_texts()
    for module in _corpus_modules():
        found |= module.oracle_sql()
    return found
