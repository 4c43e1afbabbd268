"""What the physical plans must keep at scale, with broadcasting switched off."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from fleetvitals.functions import keys
from fleetvitals.operators import counters, indexes, plans
from fleetvitals.plans import findings, report
from helpers import NOON, make

STREAMED = ("t01", "t02")
ALL = [n for n in spark_entry.audit_queries() if not n.startswith(STREAMED)]


@pytest.fixture
def plan_of(spark, small):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def plan(name: str) -> str:
        df = spark_entry.queries()[name](spark, small)
        return df._jdf.queryExecution().executedPlan().toString()

    yield plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ALL)
def test_no_pairing_and_no_row_python(plan_of, name):
    plan = plan_of(name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin",
                "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, bad


@pytest.mark.parametrize("name", [
    "d08_covering_candidates", "d10_leading_wildcard", "d15_temp_spills", "d16_top_time",
    "d20_seq_scan", "d21_top_statements", "r06_health_score",
])
def test_top_k_is_cut_before_the_shuffle(plan_of, name):
    plan = plan_of(name)
    assert "Partial" in plan and "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["p02_statement_rollup", "r06_health_score", "d14_statement_stats_enabled"])
def test_sums_start_in_the_map_tasks(plan_of, name):
    assert "partial_" in plan_of(name)


def test_rollup_stays_a_hash_aggregation(plan_of):
    assert "SortAggregate" not in plan_of("p02_statement_rollup")


def test_score_reads_no_text_columns(plan_of):
    plan = plan_of("r06_health_score")
    assert "VACUUM" not in plan and "ALTER SYSTEM" not in plan


@pytest.mark.parametrize("name, filters, columns", [
    ("w02_filtered_count", "EqualTo(p_brand,Brand#13), GreaterThan(p_size,10)",
     "p_brand:string,p_size:int"),
    ("w03_sum_sorted", "", "l_orderkey:bigint,l_extendedprice:double"),
    ("w06_contains_count", "", "text:string"),
])
def test_scans_are_pruned(plan_of, name, filters, columns):
    plan = plan_of(name)
    assert filters in plan and f"struct<{columns}>" in plan


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_the_log_are_read_after_the_join(spark):
    log, plan, stmt = (make(spark, n, {}) for n in ("exec", "plan", "stmt"))
    top = plans.with_statement_key(stmt, plan)
    joined = top.join(plans.statement_signals(top, plan, log), ["instance_id", "statement"])
    lines = joined._jdf.queryExecution().optimizedPlan().toString().split("\n")
    reading = [i for i, line in enumerate(lines) if "md5(" in line and "sql_text" in line]
    assert reading
    for i in reading:
        assert "Filter" not in lines[i] and "Join Inner" in lines[i + 1]


def test_a_report_moves_its_findings_once(spark, tmp_path):
    relations = {n: make(spark, n, {}) for n in ("rel", "setting", "ext")}
    findings.all_findings(relations).write.parquet(f"{tmp_path}/findings")
    found = spark.read.parquet(f"{tmp_path}/findings")
    instances = spark.range(3).withColumnRenamed("id", "instance_id")
    assert physical(report.nested_report(found, instances)).count("Exchange hash") == 1


def test_captures_meet_changes_without_a_sort_and_once(spark, plan_of):
    rows = make(spark, "idx", dict(instance_id=1, captured_at=NOON),
                instance_id="bigint", captured_at="timestamp_ntz")
    for build, joins in ((counters.counter_changes, 1), (counters.activity, 2)):
        plan = physical(build(rows, "idx"))
        assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == joins


def test_names_of_duplicates_move_once(spark, plan_of):
    plan = physical(indexes.duplicate_indexes(make(spark, "idx", {}), make(spark, "rel", {})))
    moves = [line for line in plan.split("\n") if "Exchange hash" in line]
    assert moves and not any(re.search(r"hashpartitioning\(.*index_name", line) for line in moves)


def test_more_rows_make_more_tasks_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(keys, "TASK_ROWS", 20)
    fk, rel = make(spark, "fk", dict(attnum=1), dict(attnum=7)), make(spark, "rel", {})
    idx = make(spark, "idx", *[dict(index_name=f"i{n}", key1=n % 3) for n in range(90)])
    bare = indexes.bare_foreign_keys(fk, idx, rel)
    moved = r"hashpartitioning\(relid\S* \S*attnum\S* {}\), REPARTITION_BY_NUM"
    assert re.search(moved.format(5), physical(bare))
    assert [r.attnum for r in bare.collect()] == [7]
    relations = {"rel": make(spark, "rel", *[dict(instance_id=n) for n in range(8)])}
    status = report.audit_status(relations)
    # 8 instances become 200 rows: 10 tasks.
    assert re.search(r"hashpartitioning\(instance_id\S* 10\), REPARTITION_BY_NUM", physical(status))
    listed = status.groupBy("instance_id").agg(F.count_distinct("detector").alias("n"), F.count("*").alias("m"))
    assert sorted(listed.collect()) == [(n, 25, 25) for n in range(8)]
