"""Counters of several captures: resets, new and vanished objects, repeats, nulls."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from fleetvitals.operators import counters, indexes, statements
from fleetvitals.plans.findings import all_findings
from fleetvitals.schemas import conform
from fleetvitals.sources import fixture_views

from helpers import make

DAYS = [datetime(2024, 3, day) for day in range(1, 6)]


def captures(spark, name, *rows):
    return make(spark, name, *rows, **{"captured_at": "timestamp", **(
        {} if name != "idx" else {"instance_id": "bigint"})})


def databases(spark, **values_of):
    """dbtemp captures: the bytes of each database day by day, None where it is not there."""
    rows = [dict(datname=name, captured_at=DAYS[day], temp_files=1, temp_bytes=value)
            for name, values in values_of.items() for day, value in enumerate(values)
            if value is not None]
    return captures(spark, "dbtemp", *rows)


def changes(df):
    return {(r.datname, r.captured_at.day): (r.temp_bytes, r.previous_at.day, r.was_reset, r.exact)
            for r in df.collect()}


def test_differences_and_resets(spark):
    found = changes(counters.counter_changes(
        databases(spark, shop=[10, 25, 4, 9], calm=[7, 7, 7, 7]), "dbtemp"))
    assert found[("shop", 2)] == (15, 1, False, True)
    # What it shows after a reset is the least that happened, for all of the instance.
    assert found[("shop", 3)] == (4, 2, True, False)
    assert found[("calm", 3)] == (0, 2, False, False)
    assert found[("shop", 4)] == (5, 3, False, True)
    assert len(found) == 6


def test_new_objects_start_at_the_capture_before_and_gaps_span_resets(spark):
    found = changes(counters.counter_changes(
        databases(spark, shop=[10, 20, 5, 6], late=[None, 3, None, 8], last=[None, None, None, 2]),
        "dbtemp"))
    assert found[("late", 2)] == (3, 1, False, True)
    assert found[("late", 4)] == (5, 2, False, False)
    assert found[("last", 4)] == (2, 3, False, True)


def test_repeats_count_once_and_nulls_are_zero(spark):
    rows = [dict(datname=None, captured_at=DAYS[0], temp_bytes=5, temp_files=None)] * 3 + [
        dict(datname=None, captured_at=DAYS[0], temp_bytes=2, temp_files=None),
        dict(datname=None, captured_at=DAYS[1], temp_bytes=8, temp_files=None),
        dict(datname=None, captured_at=None, temp_bytes=99, temp_files=1)]
    found = counters.counter_changes(captures(spark, "dbtemp", *rows), "dbtemp").collect()
    assert [(r.datname, r.temp_bytes, r.temp_files) for r in found] == [(None, 3, 0)]


def test_a_stated_reset_is_one_though_no_counter_fell(spark):
    rows = [dict(datname="shop", captured_at=DAYS[d], temp_bytes=b, stats_reset=DAYS[s])
            for d, b, s in ((0, 5, 0), (1, 9, 1), (2, 12, 1))]
    df = make(spark, "dbtemp", *rows, captured_at="timestamp", stats_reset="timestamp")
    assert changes(counters.counter_changes(df, "dbtemp")) == {
        ("shop", 2): (9, 1, True, False), ("shop", 3): (3, 2, False, True)}


def test_resets_of_one_instance_leave_others_exact(spark):
    rows = [dict(instance_id=i, datname="shop", captured_at=DAYS[d], temp_bytes=b)
            for i, values in ((1, (9, 3)), (2, (9, 12)), (None, (1, 2)))
            for d, b in enumerate(values)]
    found = counters.counter_changes(captures(spark, "dbtemp", *rows), "dbtemp").collect()
    assert {r.instance_id: (r.temp_bytes, r.exact) for r in found} == {
        1: (3, False), 2: (3, True), None: (1, True)}


def test_activity_keeps_what_is_there_and_takes_its_last_shape(spark):
    df = databases(spark, shop=[10, 25, 4], gone=[1, 2, None])
    found = counters.activity(df, "dbtemp").collect()
    assert [(r.datname, r.temp_bytes, r.observed_from, r.observed_to, r.resets, r.exact)
            for r in found] == [("shop", 19, DAYS[0], DAYS[2], 1, False)]
    assert "captured_at" not in counters.activity(df, "dbtemp").columns
    assert dict(counters.activity(df, "dbtemp").dtypes)["temp_bytes"] == "bigint"


def test_statements_are_only_forgotten(spark):
    rows = [dict(query=q, captured_at=DAYS[d], calls=c, total_exec_time=t)
            for q, d, c, t in (("a", 0, 1, 900), ("a", 1, 3, 1000), ("b", 0, 5, 500),
                               ("b", 2, 5, 500), ("c", 2, 4, "150.25"))]
    stmt = counters.activity(captures(spark, "stmt", *rows), "stmt")
    assert {r["query"]: (r.calls, r.total_exec_time) for r in stmt.collect()} == {
        "a": (2, Decimal("100.00")), "c": (4, Decimal("150.25"))}
    ext = make(spark, "ext", {})
    top = statements.top_time_statements(stmt, ext)
    assert sorted(r.total_exec_time for r in top.collect()) == [100.0, 150.25]


@pytest.mark.parametrize("name", sorted(counters.COUNTERS))
def test_one_capture_and_none_have_no_activity(spark, name):
    one = captures(spark, name, dict(captured_at=DAYS[0]))
    for df in (one, one.limit(0)):
        assert counters.activity(df, name).count() == 0
        assert counters.counter_changes(df, name).count() == 0


def test_unused_by_what_happened_not_by_totals(spark):
    names = ("idle", "once", "used", "t_pkey")
    def row(name, day, scans):
        return dict(index_name=name, captured_at=DAYS[day], idx_scan=scans, idx_tup_read=scans,
                    idx_tup_fetch=scans, instance_id=1)
    idx = captures(spark, "idx", *[
        row(n, day, scans) for n, values in zip(names, ((0, 0), (7, 7), (7, 8), (0, 0)))
        for day, scans in enumerate(values)])
    rel = make(spark, "rel", {})
    found = counters.unused_over_captures(idx, rel)
    assert sorted(r.index_name for r in found.collect()) == ["idle", "once"]
    assert {r.index_name for r in indexes.unused_indexes(
        idx.where(idx.captured_at == DAYS[1]).drop("captured_at"), rel).collect()} == {"idle"}
    # A reset in between leaves open whether an index was used.
    reset = idx.unionByName(captures(spark, "idx", row("used", 2, 0), row("idle", 2, 0)))
    assert counters.unused_over_captures(reset, rel).count() == 0


def test_activity_of_all_relations_feeds_the_findings(spark):
    dbtemp = databases(spark, shop=[10, 10 + 200 * 1024**2], calm=[900 * 1024**2] * 2)
    dbtemp = dbtemp.withColumn("temp_files", dbtemp.temp_bytes)
    setting = captures(spark, "setting", dict(captured_at=DAYS[0], name="work_mem", setting="1"))
    setting = setting.unionByName(captures(
        spark, "setting", dict(captured_at=DAYS[1], name="work_mem", setting="65536", unit="kB")))
    found = counters.activity_of_relations({"dbtemp": dbtemp, "setting": setting})
    assert [r.setting for r in found["setting"].collect()] == ["65536"]
    shown = all_findings(found).where("detector = 'db_temp_usage'").collect()
    assert [r.object_name for r in shown] == ["shop"]


def test_one_exchange_serves_repeats_and_differences(spark):
    df = databases(spark, shop=[1, 2])
    plan = counters._with_previous(df, "dbtemp")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_rows_that_a_join_left_by_their_object_are_not_moved_again(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = captures(spark, "idx", dict(instance_id=1, captured_at=DAYS[0])).drop("instance_id")
        owners = make(spark, "rel", {}).select("relid", "instance_id")
        plan = counters._with_previous(df.join(owners, "relid"), "idx")._jdf.queryExecution()
        assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_captures_of_the_fixture_are_repeated_after_their_join(spark, tmp_path):
    items = [(1, 1, 5, 9, 10.0), (1, 1, 5, 9, 10.0), (1, 2, 9, 2, None), (7, 1, 3, 3, 2.5), (5, None, 1, 1, 1.0),
             (None, 1, 1, 1, 1.0), (99, 1, 1, 1, 1.0), (35, 4, None, 6, 8.0)]
    spark.createDataFrame(items, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, "
                          "l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 4), (1, 5), (7, None), (5, 3), (None, 2), (35, 6)], "o_orderkey bigint, o_custkey bigint"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    made = fixture_views.FixtureTelemetry(spark, str(tmp_path))
    lines = made["idx_captures"]._jdf.queryExecution().optimizedPlan().toString().split("\n")
    generate, join = (min(i for i, line in enumerate(lines) if kind in line) for kind in ("Generate", "Join"))
    assert generate < join
    thrice = made["idx"].crossJoin(spark.createDataFrame([(1,), (2,), (3,)], "n int"))
    wanted = conform("idx", spark.sql(fixture_views.IDX_CAPTURES, fx_idx_thrice=thrice,
                                      orders=fixture_views.table(spark, str(tmp_path), "orders")))
    assert made["idx_captures"].dtypes == wanted.dtypes
    assert wanted.count() and sorted(map(str, made["idx_captures"].collect())) == sorted(map(str, wanted.collect()))
