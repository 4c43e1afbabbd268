"""Small relations by hand: give what matters, the rest takes harmless values."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from fleetvitals.schemas import RELATIONS

CALM = {
    "rel": dict(instance_id=1, relid=1, schema_name="public", relname="t", relkind="r",
                relispartition=False, reltuples=100, n_live_tup=100, n_dead_tup=0, n_tup_ins=100,
                n_tup_del=50, size_bytes=8192, relpages=1, toastpages=0, toasttuples=0,
                reloptions=""),
    "col": dict(relid=1, attnum=1, attname="id", null_frac=0.0, avg_width=4, mcf1=None, mcv1=None,
                n_distinct=-1.0, has_stats=True),
    "idx": dict(index_name="t_pkey", relid=1, key1=1, key2=None, indpred=None, idx_scan=9,
                idx_tup_read=9, idx_tup_fetch=9, size_bytes=8192),
    "fk": dict(constraint_name="fk", relid=1, attnum=1, ref_relid=1),
    "exec": dict(instance_id=1, exec_id=1, ts=datetime(2024, 1, 1), exec_ms=1.0, sql_text="SELECT 1",
                 rows_out=1, temp_blks_written=0, shared_blks_hit=1, shared_blks_read=0),
    "stmt": dict(instance_id=1, query="SELECT 1", calls=1, total_exec_time=1, rows_out=1,
                 temp_blks_written=0, shared_blks_hit=1, shared_blks_read=0, has_wildcard=False,
                 has_ilike=False),
    "plan": dict(instance_id=1, plan_id=1, line_no=1, line="Index Scan using i on t"),
    "sess": dict(instance_id=1, pid=1, state_change=datetime(2024, 1, 1), state="idle",
                 usename="app"),
    "setting": dict(instance_id=1, name="port", setting="5432", unit=None),
    "ext": dict(instance_id=1, extname="pg_stat_statements"),
    "dbtemp": dict(instance_id=1, datname="shop", temp_files=0, temp_bytes=0),
}
NOON = datetime(2024, 1, 1, 12)


def before(seconds: float) -> datetime:
    return NOON - timedelta(seconds=seconds)


def make(spark: SparkSession, relation: str, *rows: dict, **extra_types: str) -> DataFrame:
    """A relation of the given rows; `extra_types` adds columns beyond its schema."""
    from decimal import Decimal

    schema = RELATIONS[relation]
    full = []
    for row in rows:
        merged = {**CALM[relation], **row}
        if relation == "stmt":
            merged["total_exec_time"] = Decimal(str(merged["total_exec_time"])).quantize(
                Decimal("0.01"))
        full.append(merged)
    names = schema.fieldNames()
    text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    for name, kind in extra_types.items():
        text += f", {name} {kind}"
        names.append(name)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], text)


def column(df: DataFrame, name: str) -> list:
    return sorted((r[name] for r in df.collect()), key=lambda v: (v is None, v))


def shuffle_files(spark: SparkSession) -> set[str]:
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def left_behind(spark: SparkSession, before: set[str]) -> set[str]:
    """Shuffle files that are still there when those of ended jobs had time to go."""
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left
