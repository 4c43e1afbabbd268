from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetvitals.plans import findings, report
from fleetvitals.schemas import RELATIONS, RelationError, conform
from fleetvitals.session import shared_folder
from fleetvitals.sources import plan_files, report_sink, snapshots
from helpers import make


def test_snapshots_are_kept_by_capture(spark, tmp_path):
    folder = str(tmp_path)
    relations = {n: make(spark, n, {}) for n in ("rel", "ext", "sess", "stmt")}
    first, second = datetime(2024, 1, 1, 12), datetime(2024, 1, 2, 12)
    snapshots.write_snapshot(relations, folder, first)
    snapshots.write_snapshot(relations, folder, second)
    back = snapshots.read_snapshot(spark, folder, list(relations))
    assert {n: df.count() for n, df in back.items()} == {n: 2 for n in relations}
    only = snapshots.read_relation(spark, "rel", f"{folder}/rel",
                                   captured_at=F.col("captured_at") == F.lit(second))
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert only.count() == 1 and "PartitionFilters: [isnotnull(captured_at" in plan


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, fmt):
    path = f"{tmp_path}/ext"
    make(spark, "ext", {}, dict(instance_id=2)).write.format(fmt).save(path)
    df = snapshots.read_relation(spark, "ext", path, fmt)
    assert sorted(r.instance_id for r in df.collect()) == [1, 2]


def test_wrong_snapshot_is_refused(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/ext")
    with pytest.raises(RelationError):
        snapshots.read_relation(spark, "ext", f"{tmp_path}/ext")


def test_every_relation_has_a_server_query():
    built_here = {"exec", "plan"}
    assert set(snapshots.SERVER_QUERIES) == set(RELATIONS) - built_here


def test_plan_files(spark, tmp_path):
    os.makedirs(tmp_path / "instance=3")
    (tmp_path / "instance=3" / "plan=12.txt").write_text("Sort\n  Sort Method: quicksort\n")
    (tmp_path / "instance=3" / "plan=13.txt").write_text("Seq Scan on t\n")
    rows = plan_files.read_plan_files(spark, str(tmp_path)).collect()
    assert sorted((r.instance_id, r.plan_id, r.line_no, r.line) for r in rows) == [
        (3, 12, 1, "Sort"), (3, 12, 2, "  Sort Method: quicksort"), (3, 13, 1, "Seq Scan on t")]


def test_plan_log_holds_many_plans_to_a_file(spark, tmp_path):
    rows = [dict(instance_id=i, plan_id=p, line_no=n, line=f"  a\tb {p}")
            for i in (3, 4) for p in range(20) for n in (1, 2)]
    plan = make(spark, "plan", *rows).coalesce(1)
    plan_files.write_plan_log(plan, str(tmp_path / "log"))
    back = plan_files.read_plan_log(spark, str(tmp_path / "log"))
    assert sorted(map(tuple, back.select(plan.columns).collect())) == sorted(map(tuple, plan.collect()))
    assert len(back.inputFiles()) == 2


def test_plan_log_of_many_instances_has_few_files(spark, tmp_path):
    rows = [dict(instance_id=i, plan_id=7, line=f"\ta {i}\t") for i in (None, -5, *range(500))]
    plan = make(spark, "plan", *rows).coalesce(1)
    plan_files.write_plan_log(plan, str(tmp_path / "log"))
    back = plan_files.read_plan_log(spark, str(tmp_path / "log"))
    shown = {(r.instance_id, r.plan_id, r.line_no, r.line) for r in back.collect()}
    assert shown == {(r["instance_id"], 7, 1, r["line"]) for r in rows} and back.count() == 502
    assert len(back.inputFiles()) <= plan_files.LOG_PARTS + 1


def test_a_plan_file_without_a_name_stops_the_read(spark, tmp_path):
    (tmp_path / "other.txt").write_text("Seq Scan on t")
    with pytest.raises(Exception, match="no instance and plan"):
        plan_files.read_plan_files(spark, str(tmp_path)).collect()


def test_servers_are_read_one_partition_each(spark, tmp_path, monkeypatch):
    reader = snapshots.ServerReader(
        {"relation": "idx", "driver": "canned_server", "servers": '{"7": "b", "3": "a"}'},
        snapshots.server_schema("idx"))
    assert [p.value for p in reader.partitions()] == [(3, "a"), (7, "b")]
    (tmp_path / "canned_server.py").write_text(
        "class connect:\n"
        "    def __init__(self, address): self.left = [(address + '_pkey', 5, [2, 1])]\n"
        "    def cursor(self): return self\n"
        "    def execute(self, text): self.description = [('index_name',), ('relid',), ('indkey',)]\n"
        "    def fetchmany(self, n): rows, self.left = self.left, []; return rows\n"
        "    def close(self): pass\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    names = snapshots.server_schema("idx").fieldNames()
    assert [{n: v for n, v in zip(names, row) if v is not None} for row in rows] == [
        {"instance_id": 3, "index_name": "a_pkey", "relid": 5, "indkey": [2, 1]},
        {"instance_id": 7, "index_name": "b_pkey", "relid": 5, "indkey": [2, 1]}]


@pytest.mark.parametrize("relation", sorted(snapshots.SERVER_QUERIES))
def test_server_rows_fit_their_relation(spark, relation):
    assert conform(relation, spark.createDataFrame([], snapshots.server_schema(relation))).count() == 0


def test_report_sinks(spark, tmp_path):
    relations = {n: make(spark, n, {}) for n in ("rel", "setting", "ext")}
    found = findings.all_findings(relations)
    report_sink.write_findings(found, f"{tmp_path}/findings")
    assert "category=bloat" in os.listdir(f"{tmp_path}/findings")
    back = spark.read.parquet(f"{tmp_path}/findings")
    assert back.count() == found.count()
    report_sink.write_reports(report.nested_report(back, report.instance_rows(relations)),
                              f"{tmp_path}/reports")
    (line,) = spark.read.text(f"{tmp_path}/reports").collect()
    assert json.loads(line.value)["health_score"] == 100


def test_shared_folder_is_the_session_s(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
