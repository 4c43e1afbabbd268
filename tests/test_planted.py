"""A shop database with known problems, as one hand-made capture: each must be
found once, and the clean objects beside them must give nothing."""

from __future__ import annotations

import hashlib
import json

import pytest

from fleetvitals.operators import retention, rollup
from fleetvitals.plans import findings, report
from fleetvitals.schemas import conform
from helpers import before, make

TABLES = {"categories": 1, "customers": 2, "products": 3, "inventory": 4, "orders": 5,
          "order_items": 6, "reviews": 7, "event_log": 8}
BIG = 600 * 1024 * 1024


def statements_log(spark):
    rows, next_id = [], iter(range(1, 1000))

    def run(text: str, times: int, ms: float, blocks: int = 0) -> None:
        for n in range(times):
            rows.append(dict(exec_id=next(next_id), sql_text=text.format(n=n), exec_ms=ms,
                             temp_blks_written=blocks, rows_out=1))

    run("SELECT count(*) FROM orders WHERE customer_id = {n}", 30, 12.0)
    run("SELECT id, total FROM orders WHERE customer_id = {n}", 6, 4.0)
    run("SELECT o.id FROM orders o ORDER BY o.total DESC", 2, 900.0, 20000)
    run("SELECT count(*) FROM products WHERE description LIKE '%premium%'", 3, 40.0)
    run("SELECT count(*) FROM products WHERE sku LIKE 'SKU%'", 3, 1.0)
    return make(spark, "exec", *rows)


@pytest.fixture(scope="module")
def shop(spark):
    def table(name: str, **changed) -> dict:
        return dict(relid=TABLES[name], relname=name, **changed)

    rel = make(
        spark, "rel", table("categories"), table("customers", reltuples=10000, n_live_tup=10000),
        table("products", reltuples=1000, n_live_tup=6000),
        table("inventory", reloptions="autovacuum_enabled=false"),
        table("orders", reltuples=100000, n_live_tup=100000), table("order_items"),
        table("reviews", n_live_tup=100, n_dead_tup=100),
        table("event_log", reltuples=145000, n_live_tup=145000, size_bytes=BIG, n_tup_ins=205000,
              n_tup_del=6000, relpages=70000))
    col = make(
        spark, "col", *[dict(relid=i, attname="id") for i in TABLES.values()],
        dict(relid=2, attnum=2, attname="country", mcf1=1.0, mcv1="MX"),
        dict(relid=5, attnum=2, attname="customer_id", mcf1=0.01),
        dict(relid=5, attnum=3, attname="status", mcf1=0.95, mcv1="pending"))
    idx = make(
        spark, "idx", *[dict(index_name=f"{n}_pkey", relid=i) for n, i in TABLES.items()],
        dict(index_name="idx_products_category", relid=3, key1=5),
        dict(index_name="idx_products_category_dup", relid=3, key1=5),
        dict(index_name="idx_birth_date", relid=2, key1=5, idx_scan=0, idx_tup_read=0,
             idx_tup_fetch=0),
        dict(index_name="idx_reviews_product", relid=7, key1=2))
    fk = make(
        spark, "fk", dict(constraint_name="orders_customer", relid=5, attnum=2, ref_relid=2),
        dict(constraint_name="products_category", relid=3, attnum=5, ref_relid=1),
        dict(constraint_name="reviews_product", relid=7, attnum=2, ref_relid=3))
    log = statements_log(spark)
    sort = [r.exec_id for r in log.where("sql_text LIKE '%ORDER BY%'").collect()]
    count = [r.exec_id for r in log.where("sql_text LIKE '%count(*) FROM orders%'").collect()]
    plan = make(
        spark, "plan", dict(plan_id=sort[0], line="  Sort Method: external merge  Disk: 90kB"),
        dict(plan_id=sort[1], line="  Buckets: 1024  Batches: 4  Memory Usage: 8kB"),
        dict(plan_id=count[0], line="  ->  Seq Scan on orders  (cost=0.00..9.00)"))
    setting = make(
        spark, "setting", dict(name="work_mem", setting="4096", unit="kB"),
        dict(name="shared_buffers", setting="16384", unit="8kB"),
        dict(name="pg_stat_statements.max", setting="100"),
        dict(name="log_min_duration_statement", setting="-1", unit="ms"), dict())
    sess = make(spark, "sess", dict(pid=7, state="active", state_change=before(600)),
                dict(pid=8, state="idle", state_change=before(0)))
    return {
        "rel": rel, "col": col, "idx": idx, "fk": fk, "exec": log, "plan": plan, "sess": sess,
        "stmt": conform("stmt", rollup.statement_rollup(log, "all")), "setting": setting,
        "ext": make(spark, "ext", dict()),
        "dbtemp": make(spark, "dbtemp", dict(temp_files=4, temp_bytes=200 * 1024 * 1024)),
    }


@pytest.fixture(scope="module")
def found(shop):
    return findings.all_findings(shop).cache()


PLANTED = {
    "missing_indexes": ["orders_customer"],
    "duplicate_indexes": ["products"],
    "unused_indexes": ["idx_birth_date"],
    "missing_partial": ["orders.status"],
    "covering_candidates": ["SELECT id, total FROM orders WHERE customer_id = $1"],
    "disabled_autovacuum": ["inventory"],
    "obsolete_stats": ["public.products"],
    "wildcard_searches": ["SELECT count(*) FROM products WHERE description LIKE $1"],
    "work_mem_evaluation": ["work_mem"],
    "shared_buffers_evaluation": ["shared_buffers"],
    "pg_stat_max_evaluation": ["pg_stat_statements.max"],
    "pg_stat_limit": ["pg_stat_statements.max"],
    "slow_query_logging": ["log_min_duration_statement"],
    "idle_in_transaction": ["7"],
    "partitioning_candidates": ["public.event_log"],
    "temp_spills": ["SELECT o.id FROM orders o ORDER BY o.total DESC"],
    "explain_spills": ["SELECT o.id FROM orders o ORDER BY o.total DESC"] * 2,
    "seq_scans": ["SELECT count(*) FROM orders WHERE customer_id = $1"],
    "db_temp_usage": ["shop"],
}


def test_planted_problems(found):
    by_detector: dict[str, list[str]] = {}
    for row in found.collect():
        by_detector.setdefault(row.detector, []).append(row.object_name)
    for detector, objects in PLANTED.items():
        # Statements are named by their id.
        objects = [hashlib.md5(o.encode()).hexdigest() if " " in o else o for o in objects]
        assert sorted(by_detector[detector]) == sorted(objects), detector


def test_bloat_and_dead_rows(found):
    bloated = found.where("detector = 'table_bloat' AND weight > 0").collect()
    assert [r.object_name for r in bloated] == ["public.event_log"]
    dead = found.where("detector = 'dead_tuples' AND weight > 0").collect()
    assert [r.object_name for r in dead] == ["public.reviews"]


def test_retention(spark):
    from pyspark.sql import functions as F

    log = make(spark, "exec", *[dict(exec_id=n, ts=before(86400 * d)) for n, d in
                                enumerate((0, 1, 30, 31, 700))])
    (row,) = retention.retention_audit(log, "ts", "event_log", 30).collect()
    assert (row.n_rows, row.rows_past_limit, row.share_past_limit) == (5, 2, 0.4)
    per = retention.retention_audit(log, "ts", "event_log", 30, as_of=F.lit(before(0)).cast(
        "timestamp_ntz"), by=["instance_id"]).collect()
    assert [(r.instance_id, r.rows_past_limit) for r in per] == [(1, 2)]


def test_evidence_and_fixes(found):
    rows = {r.detector: r for r in found.collect()}
    assert rows["missing_indexes"].sql_fix == (
        "CREATE INDEX CONCURRENTLY idx_orders_customer_id_fk ON orders (customer_id);")
    assert rows["duplicate_indexes"].sql_fix == (
        "DROP INDEX CONCURRENTLY idx_products_category_dup;")
    assert rows["missing_partial"].sql_fix.endswith("WHERE status <> 'pending';")
    assert "1,000 rows" in rows["obsolete_stats"].evidence
    assert "6.0 times" in rows["obsolete_stats"].evidence
    assert found.where("evidence IS NULL OR sql_fix IS NULL OR title IS NULL").count() == 0


def expected_totals(rows) -> tuple[int, int]:
    info = ("work_mem", "shared_buffers", "pg_stat_statements")
    kept = [r for r in rows if r.detector not in info
            and not (r.detector == "table_bloat" and r.metric <= 20)
            and not (r.detector == "dead_tuples" and r.metric <= 10)]
    return len(kept), sum(r.weight for r in kept)


def test_totals_and_score(shop, found):
    total, penalty = expected_totals(found.collect())
    (lean,) = report.fleet_scores(shop).collect()
    (full,) = report.health_scores(found, report.instance_rows(shop)).collect()
    for row in (lean, full):
        assert (row.total_findings, row.penalty) == (total, penalty)
        assert row.health_score == max(0, 100 - penalty)
        assert row.label == "Critical"


def test_clean_instance_scores_100(spark):
    relations = {n: make(spark, n, {}) for n in ("rel", "idx", "setting", "ext", "sess", "stmt")}
    (row,) = report.fleet_scores(relations).collect()
    assert (row.total_findings, row.health_score, row.label) == (0, 100, "Healthy")


def test_category_counts(found):
    counts = {(r.category, r.detector): r.findings for r in report.category_counts(found).collect()}
    assert counts["bloat", "dead_tuples"] == len(TABLES)
    assert counts["bloat", None] == sum(n for (c, d), n in counts.items() if c == "bloat" and d)
    assert sum(n for (_, d), n in counts.items() if d) == found.count()


def test_status_and_missing_relations(shop):
    rows = {r.detector: r for r in report.audit_status(shop).collect()}
    assert len(rows) == 25
    assert rows["missing_indexes"].status == "warning" and rows["work_mem"].status == "ok"
    partial = {n: df for n, df in shop.items() if n not in ("plan", "fk")}
    rows = {r.detector: r for r in report.audit_status(partial).collect()}
    for lost in ("missing_indexes", "seq_scans", "explain_spills"):
        assert (rows[lost].status, rows[lost].findings) == ("error", 0)
    assert rows["top_time_queries"].status == "warning"
    (score,) = report.fleet_scores(partial).collect()
    (full,) = report.fleet_scores(shop).collect()
    assert full.penalty - score.penalty == 6 + 4 + 2 * 6


def test_nested_report(shop, found):
    documents = report.nested_report(found, report.instance_rows(shop)).collect()
    assert len(documents) == 1
    objects = []
    for document in documents:
        body = json.loads(document.report)
        assert list(body["categories"]) == ["bloat", "config", "health", "indexes", "queries"]
        assert body["categories"]["bloat"]["detectors"]["dead_tuples"]["count"] == len(TABLES)
        for category in body["categories"].values():
            for detector in category["detectors"].values():
                objects += [item["object_name"] for item in detector["data"]]
    assert sorted(objects) == sorted(r.object_name for r in found.collect())


def test_captures_are_audited_apart(spark, shop):
    from pyspark.sql import functions as F

    def twice(df):
        at = [df.withColumn("captured_at", F.lit(t).cast("timestamp_ntz"))
              for t in ("2024-01-01 12:00:00", "2024-01-02 12:00:00")]
        return at[0].unionByName(at[1])

    once = report.fleet_scores(shop).first()
    rows = report.fleet_scores({n: twice(df) for n, df in shop.items()}).collect()
    assert len(rows) == 2
    assert {(r.total_findings, r.penalty) for r in rows} == {(once.total_findings, once.penalty)}


def test_audit_job_equals_the_lazy_report(spark, shop, tmp_path):
    from fleetvitals.plans.audit import run_audit

    relations = {n: df for n, df in shop.items() if n != "stmt"}
    stored = run_audit(spark, relations, str(tmp_path))
    lazy, job = report.fleet_scores(shop).first(), stored["scores"].first()
    assert job.asDict() == lazy.asDict()
    assert stored["findings"].count() == findings.all_findings(shop).count()
    assert stored["status"].count() == 25
    assert stored["documents"].count() == 1


def test_a_bad_relation_stops_only_its_detectors(spark, shop, tmp_path):
    from fleetvitals.plans.audit import run_audit

    bad = {**shop, "sess": shop["sess"].drop("state")}
    stored = run_audit(spark, bad, str(tmp_path))
    rows = {r.detector: r.status for r in stored["status"].collect()}
    assert rows["idle_in_transaction"] == "error" and rows["missing_indexes"] == "warning"
    assert [r.relation for r in stored["problems"].collect()] == ["sess"]


def test_an_audit_without_findings_and_with_a_healthy_instance(spark, tmp_path):
    from fleetvitals.plans.audit import run_audit

    relations = {"sess": make(spark, "sess", dict(), dict(instance_id=2, pid=2)),
                 "setting": make(spark, "setting", dict(instance_id=1))}
    stored = run_audit(spark, relations, str(tmp_path))
    assert stored["findings"].collect() == []
    assert {r.instance_id: r.health_score for r in stored["scores"].collect()} == {1: 100, 2: 100}
    assert stored["documents"].count() == 2


def test_server_statements_meet_their_plans(spark):
    from fleetvitals.operators import plans

    stmt = make(spark, "stmt", dict(query="SELECT a FROM t WHERE x = $1 AND y IN ($2, $3)", calls=9,
                                    total_exec_time=900))
    log = make(spark, "exec", dict(exec_id=7, sql_text="SELECT a FROM t WHERE x = 'it''s' AND y IN (1, 2.5e3)"))
    plan = make(spark, "plan", dict(plan_id=7, line="Seq Scan on t"),
                dict(plan_id=7, line_no=2, line="Sort Method: external merge  Disk: 9kB"))
    ext = make(spark, "ext", dict())
    assert plans.sequential_scans(stmt, plan, log).count() == 1
    assert plans.sorts_on_disk(stmt, ext, plan, log).count() == 1
    from pyspark.sql import functions as F

    own = [df.withColumn("queryid", F.lit(-5)) for df in (stmt, plan)]
    found = plans.sorts_on_disk(own[0], ext, own[1])
    assert found.count() == 1
    other = own[1].withColumn("queryid", F.lit(6))
    assert plans.sequential_scans(own[0], other).count() == 0


def test_one_instance_with_most_findings(spark):
    """A hot instance changes nothing but the number of its rows."""
    hot = [dict(relid=n, relname=f"t{n}", reloptions="autovacuum_enabled=false")
           for n in range(400)]
    cold = [dict(instance_id=i, relid=i, relname="t") for i in range(2, 30)]
    relations = {
        "rel": make(spark, "rel", *hot, *cold),
        "setting": make(spark, "setting", *[dict(instance_id=i) for i in range(1, 30)]),
    }
    scores = {r.instance_id: r for r in report.fleet_scores(relations).collect()}
    assert (scores[1].total_findings, scores[1].penalty, scores[1].health_score) == (400, 4000, 0)
    assert all(scores[i].health_score == 100 for i in range(2, 30))
