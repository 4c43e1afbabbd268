"""Audits whose inputs fail while being read, audits that are resumed, and fleets with servers down."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from fleetvitals import session
from fleetvitals.plans import audit
from fleetvitals.plans.catalog import DETECTORS, PASSES
from fleetvitals.sources import snapshots
from helpers import left_behind, make, shuffle_files


def telemetry(spark):
    return {
        "rel": make(spark, "rel", dict(relname="a", n_live_tup=100, n_dead_tup=50),
                    dict(relid=2, relname="b", reloptions="autovacuum_enabled=false")),
        "setting": make(spark, "setting", dict(name="work_mem", setting="1024", unit="kB")),
        "sess": make(spark, "sess", {}), "ext": make(spark, "ext", {}),
        "stmt": make(spark, "stmt", dict(total_exec_time=500)),
        "dbtemp": make(spark, "dbtemp", dict(temp_files=3, temp_bytes=9 << 20)),
    }


def broken(df, name):
    """The column cannot be read: its value fails while a task runs."""
    return df.withColumn(name, F.when(F.col(name).isNotNull(), F.raise_error(F.lit("bad value")))
                         .cast(df.schema[name].dataType))


def states(stored):
    return {r.detector: (r.status, r.findings) for r in stored["status"].collect()}


def test_every_detector_is_in_one_pass():
    assert sorted(n for part in PASSES for n in part) == sorted(d.name for d in DETECTORS)


def test_a_failure_while_running_costs_one_detector(spark, tmp_path):
    relations = telemetry(spark)
    whole = audit.run_audit(spark, relations, f"{tmp_path}/whole")
    bad = {**relations, "dbtemp": broken(relations["dbtemp"], "temp_bytes"),
           "rel": broken(relations["rel"], "reloptions")}
    stored = audit.run_audit(spark, bad, f"{tmp_path}/bad", workers=2)
    assert states(whole)["disabled_autovacuum"] == ("warning", 1)
    wanted = {**states(whole), "disabled_autovacuum": ("error", 0), "db_temp_usage": ("error", 0)}
    assert states(stored) == wanted
    failed = {r.detector: r.problem for r in stored["outcomes"].where("state = 'failed'").collect()}
    assert set(failed) == {"disabled_autovacuum", "db_temp_usage"}
    assert all("bad value" in p for p in failed.values())
    lost = whole["findings"].where(F.col("detector").isin(*failed)).agg(F.sum("weight")).first()[0]
    assert stored["scores"].first().penalty == whole["scores"].first().penalty - lost
    kept = whole["findings"].where(~F.col("detector").isin(*failed))
    assert sorted(map(str, stored["findings"].collect())) == sorted(map(str, kept.collect()))


def test_a_resumed_audit_goes_on_after_what_is_complete(spark, tmp_path, monkeypatch):
    relations, folder = telemetry(spark), str(tmp_path)
    real = audit.health_scores
    monkeypatch.setattr(audit, "health_scores", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        audit.run_audit(spark, relations, folder, capture="monday")
    monkeypatch.setattr(audit, "health_scores", real)
    written = {p: os.stat(os.path.join(p, f)).st_mtime_ns for p, _, fs in os.walk(f"{folder}/findings") for f in fs}
    stored = audit.run_audit(spark, relations, folder, capture="monday", resume=True)
    assert {r.state for r in stored["outcomes"].collect()} == {"kept"}
    assert written == {p: os.stat(os.path.join(p, f)).st_mtime_ns
                       for p, _, fs in os.walk(f"{folder}/findings") for f in fs}
    plain = audit.run_audit(spark, relations, f"{folder}-plain")
    assert states(stored) == states(plain)
    # Another capture's files stay, and a failed detector is tried again on resuming.
    bad = {**relations, "rel": broken(relations["rel"], "reloptions")}
    tuesday = audit.run_audit(spark, bad, folder, capture="tuesday")
    assert states(tuesday)["disabled_autovacuum"] == ("error", 0)
    mended = audit.run_audit(spark, relations, folder, capture="tuesday", resume=True)
    assert states(mended) == states(plain)
    assert {r.detector: r.state for r in mended["outcomes"].collect()}["disabled_autovacuum"] == "written"
    assert mended["scores"].first().penalty == plain["scores"].first().penalty
    counts = spark.read.parquet(f"{folder}/findings").groupBy("capture").count().collect()
    assert {r["capture"]: r["count"] for r in counts} == {
        name: plain["findings"].count() for name in ("monday", "tuesday")}
    # A run anew leaves nothing of the detectors it wrote one by one.
    again = audit.run_audit(spark, relations, folder, capture="tuesday")
    assert again["findings"].count() == plain["findings"].count()
    with pytest.raises(ValueError, match="no name"):
        audit.run_audit(spark, relations, folder, capture="a/b")


SERVER = """
import os
class connect:
    def __init__(self, address):
        self.number, self.left = int(address), None
        if self.number % 17 == 3:
            raise OSError("no route to " + address)
        # One in ten answers at the second attempt only, after some rows.
        self.flaky = self.number % 10 == 1 and not os.path.exists(FOLDER + "/" + address)
        if self.flaky:
            open(FOLDER + "/" + address, "w").close()
    def cursor(self): return self
    def execute(self, text):
        self.description = [("extname",)]
        self.left = [[("plpgsql",)], [("pg_stat_statements",)]]
    def fetchmany(self, n):
        if self.flaky and len(self.left) == 1:
            raise OSError("connection lost")
        return self.left.pop(0) if self.left else []
    def close(self): pass
"""


def test_a_fleet_is_read_though_servers_are_down(spark, tmp_path):
    module = tmp_path / "flaky_server.py"
    module.write_text(f"FOLDER = {str(tmp_path)!r}\n{SERVER}")
    spark.sparkContext.addPyFile(str(module))
    servers = {i: str(i) for i in range(50)}
    found, problems = snapshots.read_fleet(
        spark, ["ext"], servers, "flaky_server", attempts=2, wait=0.01, per_partition=7)
    down = {3, 20, 37}
    rows = found["ext"].groupBy("instance_id").count().collect()
    assert {r.instance_id: r["count"] for r in rows} == {i: 2 for i in servers if i not in down}
    assert {(r.instance_id, r.relation, r.attempts) for r in problems.collect()} == {
        (i, "ext", 2) for i in down}
    assert all("no route to" in r.problem for r in problems.collect())
    stored = audit.run_audit(spark, found, f"{tmp_path}/audit", unread=problems)
    tracking = {r.instance_id: r.status for r in stored["status"].where(
        "detector = 'pg_stat_statements'").collect()}
    assert tracking == {i: "error" if i in down else "ok" for i in servers}
    assert stored["scores"].count() == 50


def test_a_fleet_reader_packs_servers(spark):
    reader = snapshots.FleetReader(
        {"relation": "ext", "driver": "x", "servers": '{"9": "c", "7": "b", "3": "a"}', "attempts": "1",
         "wait": "0", "per_partition": "2"}, snapshots.FleetSource({"relation": "ext"}).schema())
    assert [p.value for p in reader.partitions()] == [((3, "a"), (7, "b")), ((9, "c"),)]
    rows = list(reader.read(reader.partitions()[1]))
    assert [(r[0], r[-2]) for r in rows] == [(9, snapshots.UNREAD)] and "ModuleNotFoundError" in rows[0][-1]


def test_an_audit_leaves_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    bad = {**telemetry(spark), "dbtemp": broken(telemetry(spark)["dbtemp"], "temp_bytes")}
    stored = audit.run_audit(spark, bad, str(tmp_path))
    assert not left_behind(spark, before)
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"
    assert states(stored)["db_temp_usage"] == ("error", 0)
    assert stored["documents"].count() == 1


def test_the_cleanup_of_shuffles_ends_with_the_last_to_leave(spark):
    spark.conf.set(session.SHUFFLE_CLEANUP, "false")
    with session.brief_shuffles(spark):
        with pytest.raises(ZeroDivisionError), session.brief_shuffles(spark):
            1 / 0
        assert spark.conf.get(session.SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"
    spark.conf.unset(session.SHUFFLE_CLEANUP)
