"""Every strict or inclusive limit of the rules, on rows made by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetvitals.functions import pretty_size, setting_to_mb
from fleetvitals.operators import bloat, config, health, indexes, plans, rollup, statements
from fleetvitals.plans import findings, report
from fleetvitals.schemas import RelationError, conform
from helpers import NOON, before, column, left_behind, make, shuffle_files


def test_partial_index_limits(spark):
    rel = make(spark, "rel", dict(relid=1, relname="large", reltuples=10001),
               dict(relid=2, relname="at_limit", reltuples=10000),
               dict(relid=3, relname="system", reltuples=99999, schema_name="pg_catalog"),
               # The underscore of pg_% stands for any character.
               dict(relid=4, relname="like_system", reltuples=99999, schema_name="pgx"))
    col = make(spark, "col", dict(relid=1, attname="status", mcf1=0.8501, mcv1="a"),
               dict(relid=1, attname="equal", mcf1=0.85, mcv1="a"),
               dict(relid=1, attname="covered", mcf1=0.9, mcv1="a"),
               dict(relid=1, attname="unknown"),
               dict(relid=2, attname="small", mcf1=0.99), dict(relid=3, attname="sys", mcf1=0.99),
               dict(relid=4, attname="sys2", mcf1=0.99))
    idx = make(spark, "idx", dict(relid=1, indpred="(COVERED <> 'a'::text)"),
               dict(relid=9, indpred="(status)"), dict(relid=1))
    found = indexes.missing_partial_indexes(col, rel, idx)
    assert column(found, "column_name") == ["status"]
    assert column(found.where("column_name = 'status'"), "percent_occurrence") == [85.01]


def test_foreign_keys(spark):
    rel = make(spark, "rel", dict(relid=1, relname="orders"), dict(relid=2, relname="customers"))
    fk = make(spark, "fk", dict(constraint_name="a", attnum=2, ref_relid=2),
              dict(constraint_name="b", attnum=3, ref_relid=77),
              dict(constraint_name="c", attnum=4, ref_relid=2))
    idx = make(spark, "idx", dict(key1=2), dict(key1=2, index_name="again"), dict(key1=1, key2=3))
    bare = indexes.foreign_keys_without_index(fk, idx, rel)
    assert column(bare, "constraint_name") == ["b", "c"]
    assert column(bare, "referenced_table") == ["77", "customers"]
    flags = {r.constraint_name: r.has_index
             for r in indexes.foreign_key_coverage(fk, idx, rel).collect()}
    assert flags == {"a": "yes", "b": "no", "c": "no"}


def test_foreign_key_arrays_and_names(spark):
    fk = spark.createDataFrame(
        [(1, "k", 1, [2, 3], 5)], "instance_id long, constraint_name string, relid long, "
        "conkey array<int>, ref_relid long")
    idx = spark.createDataFrame([(1, "i", 1, [3, 2])], "instance_id long, index_name string, "
                                "relid long, indkey array<int>")
    rel = make(spark, "rel", dict(relname="t"))
    found = indexes.foreign_keys_without_index(fk, idx, rel)
    assert column(found, "column_name") == ["c2"]


def test_same_ids_in_two_instances_stay_apart(spark):
    rel = make(spark, "rel", dict(instance_id=1, relname="a"), dict(instance_id=2, relname="b"))
    fk = make(spark, "fk", dict(instance_id=1), dict(instance_id=2), instance_id="long")
    idx = make(spark, "idx", dict(instance_id=2, key1=1), instance_id="long")
    found = indexes.foreign_keys_without_index(fk, idx, rel)
    assert [(r.instance_id, r.table_name) for r in found.collect()] == [(1, "a")]


def test_duplicate_indexes(spark):
    rel = make(spark, "rel", dict(relid=1, relname="t"),
               dict(relid=2, relname="s", schema_name="pg_toast"))
    idx = make(spark, "idx", dict(index_name="b", key1=1), dict(index_name="a", key1=1),
               dict(index_name="c", key1=1, key2=2), dict(index_name="d", key1=2, key2=1),
               dict(index_name="x", relid=2), dict(index_name="y", relid=2),
               dict(index_name="p", key1=5, indpred="(z)"), dict(index_name="q", key1=5))
    rows = {r["columns"]: r for r in indexes.duplicate_indexes(idx, rel).collect()}
    assert set(rows) == {"c1", "c5"}
    assert rows["c1"]["index_names"] == "a, b" and rows["c1"]["keep_name"] == "a"
    strict = indexes.duplicate_indexes_strict(idx, rel).collect()
    assert sorted((r.table_name, r.column_ids) for r in strict) == [("s", "1"), ("t", "1")]


def test_large_duplicate_group_is_one_row(spark):
    rel = make(spark, "rel", dict(relname="t"))
    idx = make(spark, "idx", *[dict(index_name=f"i{n:04}, x") for n in range(2500)])
    (row,) = indexes.duplicate_indexes(idx, rel).collect()
    assert row["names"] == [f"i{n:04}, x" for n in range(2500)]
    assert row["count"] == 2500 and row.keep_name == "i0000, x"


def test_key_columns_have_their_names_in_key_order(spark):
    rel = make(spark, "rel", dict(relname="t"))
    col = make(spark, "col", dict(attnum=1, attname="zeta"), dict(attnum=2, attname="alpha"))
    idx = make(spark, "idx", dict(index_name="a", indkey=[2, 1, 0, 7]),
               dict(index_name="b", indkey=[2, 1, 0, 7]), indkey="array<int>")
    (row,) = indexes.duplicate_indexes(idx, rel, col).collect()
    assert row["columns"] == "alpha, zeta, (expression), c7"
    fk = make(spark, "fk", dict(attnum=2), dict(attnum=9))
    assert column(indexes.foreign_keys_without_index(fk, idx.limit(0), rel, col), "column_name") == [
        "alpha", "c9"]


@pytest.mark.parametrize("schema", ["pg_catalog", "information_schema", "pg_toast", "pg_toast_temp_3"])
def test_objects_of_the_server_are_no_findings(spark, schema):
    rel = make(spark, "rel", dict(schema_name=schema, relname="t", reltuples=1, n_live_tup=900,
                                  n_dead_tup=900, n_tup_ins=10**6, n_tup_del=0, size_bytes=10**10))
    idx = make(spark, "idx", dict(index_name="i", idx_scan=0, idx_tup_read=0, idx_tup_fetch=0))
    for found in (indexes.unused_indexes(idx, rel), indexes.unused_indexes_by_scan(idx, rel),
                  indexes.stale_statistics(rel), bloat.dead_tuples(rel),
                  health.partition_candidates(rel), health.partition_candidates(rel, "any")):
        assert found.collect() == []


def test_unused_indexes(spark):
    rel = make(spark, "rel", dict(relname="t"), dict(relid=2, relname="pg_like"))
    never = dict(idx_scan=0, idx_tup_read=0, idx_tup_fetch=0)
    idx = make(spark, "idx", dict(index_name="free", **never), dict(index_name="t_pkey", **never),
               dict(index_name="read", **{**never, "idx_tup_read": 1}), dict(index_name="used"),
               dict(index_name="other", relid=2, **never))
    assert column(indexes.unused_indexes(idx, rel), "index_name") == ["free", "other"]
    assert column(indexes.unused_indexes_by_scan(idx, rel), "index_name") == [
        "free", "read", "t_pkey"]


@pytest.mark.parametrize("planned, live, severity", [
    (1000, 5000, None), (1000, 5010, "WARNING"), (1000, 10000, "WARNING"),
    (1000, 10010, "CRITICAL"), (5010, 1000, "WARNING"), (0, 100, None), (0, 101, "OK"),
    (100, 0, None), (-1, 500, None),
])
def test_stale_statistics(spark, planned, live, severity):
    rel = make(spark, "rel", dict(reltuples=planned, n_live_tup=live))
    assert column(indexes.stale_statistics(rel), "stats_severity") == (
        [] if severity is None else [severity])


def test_stale_statistics_only_of_ordinary_tables(spark):
    far = dict(reltuples=1, n_live_tup=900)
    rel = make(spark, "rel", dict(relkind="p", **far), dict(schema_name="pg_temp", **far))
    assert indexes.stale_statistics(rel).count() == 0


def test_dead_rows(spark):
    rel = make(spark, "rel", dict(relname="a", n_live_tup=0, n_dead_tup=0),
               dict(relname="b", n_live_tup=90, n_dead_tup=10),
               dict(relname="c", n_live_tup=899, n_dead_tup=101),
               dict(relname="d", n_live_tup=80, n_dead_tup=20),
               dict(relname="e", n_live_tup=799, n_dead_tup=201))
    got = {r.table_name: (r.dead_tuple_pct, r.band) for r in bloat.dead_tuples(rel).collect()}
    assert got == {"a": (0.0, "optimal"), "b": (10.0, "optimal"), "c": (10.1, "elevated"),
                   "d": (20.0, "elevated"), "e": (20.1, "alarming")}


def test_bloat_formula_by_hand(spark):
    # header 23 + 1, data 12, tuple 4+24+12+16-8-4 = 44, 8168/44 rows a page
    rel = make(spark, "rel", dict(reltuples=1000, relpages=20, toastpages=1, toasttuples=5),
               dict(relid=2, relname="part", relkind="p"), dict(relid=3, relname="odd"))
    col = make(spark, "col", dict(avg_width=8), dict(attnum=2, avg_width=8, null_frac=0.5),
               dict(relid=2), dict(relid=3), dict(relid=3, attnum=2, has_stats=False))
    (row,) = bloat.table_bloat(col, rel).collect()
    expected = -(-1000 * 44 // 8168) + 2
    assert row.tblname == "t" and row.real_size == 21 * 8192
    assert row.extra_size == (21 - expected) * 8192
    assert row.bloat_pct == pytest.approx(100 * (21 - expected) / 21)


def test_autovacuum(spark):
    rel = make(spark, "rel", dict(relname="a", reloptions="autovacuum_enabled=false"),
               dict(relname="b", reloptions="autovacuum_enabled=true"))
    assert column(bloat.autovacuum_disabled(rel), "relname") == ["a"]


def test_settings(spark):
    setting = make(spark, "setting", dict(name="work_mem", setting="16383", unit="kB"),
                   dict(instance_id=2, name="work_mem", setting="16384", unit="kB"),
                   dict(instance_id=1, name="shared_buffers", setting="32767", unit="8kB"),
                   dict(instance_id=2, name="shared_buffers", setting="256", unit="MB"),
                   dict(instance_id=3, name="shared_buffers", setting="255"),
                   dict(instance_id=1, name="pg_stat_statements.max", setting="499"),
                   dict(instance_id=2, name="pg_stat_statements.max", setting="500"),
                   dict(instance_id=3, name="pg_stat_statements.max", setting="1000"),
                   dict(instance_id=4, name="pg_stat_statements.max", setting="many"),
                   dict(instance_id=1, name="log_min_duration_statement", setting="-1"),
                   dict(instance_id=2, name="log_min_duration_statement", setting="0"))
    ext = make(spark, "ext", dict(instance_id=1), dict(instance_id=2, extname="plpgsql"))
    assert column(config.low_work_mem(setting), "instance_id") == [1]
    assert column(config.low_shared_buffers(setting), "instance_id") == [1, 3]
    assert column(config.low_tracking_limit(setting), "instance_id") == [1, 2]
    loses = config.tracking_limit_loses_statements(setting, ext).collect()
    assert [(r.instance_id, r.severity) for r in loses] == [(1, "MEDIUM")]
    assert column(config.slow_log_disabled(setting), "instance_id") == [1]
    assert config.memory_settings(setting).count() == 5


def test_setting_units(spark):
    df = spark.createDataFrame([("1024", "kB"), ("128", "8kB"), ("7", "MB"), ("7", None), ("x", "kB")],
                               "s string, u string")
    got = [r.mb for r in df.select(setting_to_mb(F.col("s"), F.col("u")).alias("mb")).collect()]
    assert got == [1.0, 1.0, 7.0, 7.0, None]


@pytest.mark.parametrize("size, text", [
    (0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10751, "10 kB"), (10752, "11 kB"),
    (10485247, "10239 kB"), (10485248, "10 MB"), (10 * 1024**3, "10 GB"),
    (10 * 1024**5, "10 PB"), (-20480, "-20 kB"),
])
def test_pretty_size(spark, size, text):
    df = spark.createDataFrame([(size,)], "n long")
    assert df.select(pretty_size(F.col("n"))).first()[0] == text


def _blocks(mb: float) -> int:
    return round(mb * 128)


def test_spills(spark):
    mbs = {1: 0.9, 2: 1.0, 3: 9.99, 4: 10.0, 5: 100.0}
    stmt = make(spark, "stmt", *[dict(query=f"q{i}", temp_blks_written=_blocks(mb), calls=2,
                                      total_exec_time=3) for i, mb in mbs.items()],
                dict(query="q0"), dict(instance_id=2, query="z", temp_blks_written=_blocks(5)))
    got = {(r.instance_id, r.query_sample): r.severity
           for r in statements.spilling_statements(stmt).collect()}
    assert got == {(1, "q2"): "LOW", (1, "q3"): "LOW", (1, "q4"): "MEDIUM", (1, "q5"): "HIGH",
                   (2, "z"): "LOW"}
    ext = make(spark, "ext", dict(), dict(instance_id=2, extname="plpgsql"))
    cards = statements.temp_spills(stmt, ext).where("instance_id = 2").collect()
    assert [(c.title, c.severity) for c in cards] == [
        ("Statement statistics are not enabled", "LOW")]


def test_top_k_is_per_instance_with_ties_by_text(spark):
    stmt = make(spark, "stmt", *[dict(instance_id=i, query=f"q{n}", total_exec_time=100)
                                 for i in (1, 2) for n in range(9)],
                dict(query="below", total_exec_time=99.99))
    ext = make(spark, "ext", dict(), dict(instance_id=2))
    got = statements.top_time_statements(stmt, ext)
    assert column(got, "query_sample") == sorted(f"q{n}" for n in range(5) for _ in (1, 2))


def test_covering_candidates(spark):
    texts = {"SELECT a FROM t WHERE id = $1": 5, "SELECT b FROM t WHERE id = $1": 4,
             "SELECT * FROM t WHERE id = $1": 9, "SELECT count(*) FROM t WHERE id = $1": 9,
             "SELECT a FROM pg_class WHERE oid = $1": 9, "select c FROM t WHERE id=$2": 9,
             "SELECT a FROM t WHERE id > $1": 9, "UPDATE t SET a = 1 WHERE id = $1": 9}
    stmt = make(spark, "stmt", *[dict(query=q, calls=n, shared_blks_hit=0) for q, n in texts.items()])
    got = statements.covering_candidates(stmt)
    assert column(got, "query_sample") == ["SELECT a FROM t WHERE id = $1",
                                           "select c FROM t WHERE id=$2"]
    assert column(got, "cache_hit_pct") == [100.0, 100.0]


@pytest.mark.parametrize("calls, mean, severity", [
    (1, 9999, None), (2, 10, "LOW"), (50, 1000, "LOW"), (51, 1, "MEDIUM"), (2, 1001, "MEDIUM"),
    (100, 501, "MEDIUM"), (101, 500, "MEDIUM"), (101, 501, "HIGH"),
])
def test_wildcards(spark, calls, mean, severity):
    stmt = make(spark, "stmt", dict(query="SELECT x", calls=calls, total_exec_time=calls * mean,
                                    has_wildcard=True, has_ilike=True))
    rows = statements.leading_wildcards(stmt).collect()
    assert [r.severity for r in rows] == ([] if severity is None else [severity])
    assert all(r.anti_pattern_type.startswith("ILIKE") for r in rows)


def test_wildcard_flags_survive_normalising(spark):
    log = make(spark, "exec", dict(exec_id=1, sql_text="SELECT 1 FROM t WHERE a LIKE '%x%'"),
               dict(exec_id=2, sql_text="SELECT 1 FROM t WHERE a LIKE 'x%'"),
               dict(exec_id=3, sql_text="SELECT 1 FROM t WHERE a ilike  '%y%'"),
               dict(exec_id=4, sql_text="SELECT 1 FROM t WHERE a = $7 AND b = 12.5"))
    rows = {r.query: r for r in rollup.statement_rollup(log, "all").collect()}
    like = rows["SELECT $1 FROM t WHERE a LIKE $1"]
    assert (like.calls, like.has_wildcard, like.has_ilike) == (2, True, False)
    assert rows["SELECT $1 FROM t WHERE a ilike  $1"].has_ilike
    assert rows["SELECT $1 FROM t WHERE a = $1 AND b = $1"].has_wildcard is False


def test_sample_text(spark):
    log = make(spark, "exec", dict(exec_id=5, sql_text="SELECT a WHERE i = 5"),
               dict(exec_id=4, sql_text="SELECT a WHERE i = 4"))
    stmt = rollup.statement_rollup(log)
    assert column(rollup.with_sample_text(stmt, log), "sample_text") == ["SELECT a WHERE i = 4"]


def test_plan_rules(spark):
    log = make(spark, "exec", *[dict(exec_id=n, sql_text=q, exec_ms=200.0) for n, q in (
        (1, "SELECT a FROM t WHERE id = 1"), (2, "SELECT a FROM t WHERE id = 2"),
        (3, "INSERT INTO t VALUES (1)"), (4, "SELECT b FROM t"))])
    plan = make(spark, "plan",
                dict(plan_id=1, line_no=1, line="Sort Method: quicksort  Memory: 25kB"),
                dict(plan_id=2, line_no=1, line="Sort Method: external merge  Disk: 8kB"),
                dict(plan_id=2, line_no=2, line="  Buckets: 1  Batches: 4  Batches: 12"),
                dict(plan_id=2, line_no=3, line="  ->  Seq Scan on later  (cost=0)"),
                dict(plan_id=1, line_no=3, line="  ->  Seq Scan on second  (cost=0)"),
                dict(plan_id=1, line_no=2, line="  ->  Seq Scan on first  (cost=0)"),
                dict(plan_id=3, line_no=1, line="Sort Method: external merge  Disk: 8kB"),
                dict(plan_id=4, line_no=1, line="Buckets: 1  Batches: 1"))
    stmt, ext = conform("stmt", rollup.statement_rollup(log)), make(spark, "ext", dict())
    assert column(plans.sorts_on_disk(stmt, ext, plan, log), "query_sample") == [
        "SELECT a FROM t WHERE id = $1"]
    assert column(plans.hash_batches(stmt, ext, plan, log), "max_batches") == [12]
    assert column(plans.sequential_scans(stmt, plan, log), "table_name") == ["first"]
    off = make(spark, "ext", dict(extname="plpgsql"))
    assert plans.sorts_on_disk(stmt, off, plan, log).count() == 0


def test_partition_candidates(spark):
    big = dict(size_bytes=500 * 1024 * 1024 + 1, n_tup_ins=100001, n_tup_del=5000)
    rel = make(spark, "rel", dict(relname="yes", **big),
               dict(relname="small", **{**big, "size_bytes": 500 * 1024 * 1024}),
               dict(relname="few", **{**big, "n_tup_ins": 100000, "n_tup_del": 0}),
               dict(relname="purged", **{**big, "n_tup_del": 5001}),
               dict(relname="part", relispartition=True, **big), dict(relname="kind", relkind="p", **big))
    assert column(health.partition_candidates(rel), "table_name") == ["yes"]
    assert health.partition_candidates(rel, mode="any").count() == 6
    (row,) = health.partition_candidates(rel).collect()
    assert row.size_mb == 500 and "takes" not in row.reasons and "100,001 inserts" in row.reasons


def test_partition_candidate_without_inserts(spark):
    rel = make(spark, "rel", dict(relkind="p", relispartition=True, n_tup_ins=0, n_tup_del=0))
    assert health.partition_candidates(rel, mode="any").count() == 1


@pytest.mark.parametrize("age, severity", [
    (60, None), (60.5, "MEDIUM"), (120, "MEDIUM"), (120.5, "HIGH"),
])
def test_session_age(spark, age, severity):
    sess = make(spark, "sess", dict(state="active", state_change=before(age)))
    found = health.long_sessions(sess, "app", F.lit(NOON).cast("timestamp_ntz")).collect()
    assert [r.severity for r in found] == ([] if severity is None else [severity])


def test_sessions_that_do_not_count(spark):
    old = dict(state="idle in transaction", state_change=before(600))
    sess = make(spark, "sess", dict(pid=1, **old), dict(pid=2, usename="other", **old),
                dict(pid=3, state="idle", state_change=before(600)), dict(pid=4, **old),
                dict(pid=4, state="idle", state_change=before(5)), dict(pid=5, **old))
    as_of = F.lit(NOON).cast("timestamp_ntz")
    assert column(health.long_sessions(sess, "app", as_of, auditor_pid=5), "session_pid") == [1]
    assert column(health.long_sessions(sess, None, as_of), "session_pid") == [1, 2, 5]


def test_tracking_of_an_instance_without_extensions(spark):
    ext = make(spark, "ext", dict(), dict(extname="plpgsql"))
    seen = spark.createDataFrame([(1,), (2,)], "instance_id long")
    got = {r.instance_id: r.enabled for r in config.tracking_enabled(ext, seen).collect()}
    assert got == {1: True, 2: False}


def test_severity_and_labels(spark):
    df = spark.createDataFrame([(s,) for s in ("HIGH", "critical", "MEDIUM", "WARNING", "LOW", "OK",
                                               "odd", None)], "s string")
    levels = [r[0] for r in df.select(report.severity_level(F.col("s"))).collect()]
    assert levels == ["high", "high", "medium", "medium", "low", "ok", "ok", "ok"]
    scores = spark.createDataFrame([(n,) for n in (100, 80, 79, 60, 59, 40, 39, 0)], "n int")
    labels = [r[0] for r in scores.select(report.score_label(F.col("n"))).collect()]
    assert labels == ["Healthy"] * 2 + ["Acceptable"] * 2 + ["Needs attention"] * 2 + ["Critical"] * 2


def test_schema_check(spark):
    with pytest.raises(RelationError, match="extname is missing"):
        conform("ext", spark.createDataFrame([(1,)], "instance_id long"))
    with pytest.raises(RelationError, match="instance_id is string"):
        conform("ext", spark.createDataFrame([("1", "a")], "instance_id string, extname string"))
    narrow = conform("ext", spark.createDataFrame([(1, "a")], "instance_id int, extname string"))
    assert dict(narrow.dtypes)["instance_id"] == "bigint"
    options = conform("rel", make(spark, "rel", dict()).withColumn(
        "reloptions", F.array(F.lit("fillfactor=70"), F.lit("autovacuum_enabled=false"))))
    assert bloat.autovacuum_disabled(options).first().reloptions == (
        "fillfactor=70 autovacuum_enabled=false")


@pytest.mark.parametrize("relation, rule", [
    ("rel", indexes.stale_statistics), ("rel", bloat.dead_tuples),
    ("rel", health.partition_candidates), ("setting", config.low_work_mem),
    ("stmt", statements.covering_candidates), ("sess", lambda s: health.long_sessions(s, "app")),
    ("dbtemp", statements.database_temp_usage), ("exec", rollup.statement_rollup),
])
def test_empty_input(spark, relation, rule):
    assert rule(make(spark, relation)).count() == 0


def test_findings_stored_for_a_report_are_all_and_leave_no_shuffle_files(spark):
    relations = {
        "rel": make(spark, "rel", dict(relname="a", n_dead_tup=50), dict(instance_id=None, relid=2)),
        "idx": make(spark, "idx", *[dict(index_name=f"i{n}", idx_scan=0, idx_tup_read=0, idx_tup_fetch=0)
                                    for n in range(3)] * 2),
        "fk": make(spark, "fk", dict(attnum=7)), "setting": make(spark, "setting", dict(name="work_mem")),
        "ext": make(spark, "ext", dict(extname=None)), "stmt": make(spark, "stmt", dict(total_exec_time=500)),
    }
    there = shuffle_files(spark)
    kept = report.stored_findings(relations, session_user="app")
    assert not left_behind(spark, there)
    whole = findings.all_findings(relations, session_user="app")
    assert kept.schema.simpleString() == whole.schema.simpleString()
    assert kept.count() and sorted(map(str, kept.collect())) == sorted(map(str, whole.collect()))
    with pytest.raises(ValueError):
        report.stored_findings({})
