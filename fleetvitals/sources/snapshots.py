"""Reading captured telemetry: files of every Spark format, or live servers."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..schemas import RELATIONS, conform
from ..session import stored

# What is asked of one server for each relation; the rules run in Spark, not there.
SERVER_QUERIES = {
    "rel": """
SELECT c.oid::bigint AS relid, n.nspname AS schema_name, c.relname, c.relkind::text AS relkind,
  c.relispartition, c.reltuples::bigint AS reltuples, coalesce(s.n_live_tup, 0) AS n_live_tup,
  coalesce(s.n_dead_tup, 0) AS n_dead_tup, coalesce(s.n_tup_ins, 0) AS n_tup_ins,
  coalesce(s.n_tup_del, 0) AS n_tup_del, pg_total_relation_size(c.oid) AS size_bytes,
  c.relpages::bigint AS relpages, coalesce(t.relpages, 0)::bigint AS toastpages,
  coalesce(t.reltuples, 0)::bigint AS toasttuples,
  coalesce(array_to_string(c.reloptions, ' '), '') AS reloptions
FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace
LEFT JOIN pg_stat_all_tables s ON s.relid = c.oid LEFT JOIN pg_class t ON t.oid = c.reltoastrelid
WHERE c.relkind IN ('r', 'm', 'p')""",
    "col": """
SELECT a.attrelid::bigint AS relid, a.attnum::int AS attnum, a.attname::text AS attname,
  s.null_frac::float8 AS null_frac, s.avg_width::bigint AS avg_width,
  s.most_common_freqs[1]::float8 AS mcf1, (s.most_common_vals::text::text[])[1] AS mcv1,
  s.n_distinct::float8 AS n_distinct,
  (s.attname IS NOT NULL AND a.atttypid <> 'name'::regtype) AS has_stats
FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid
JOIN pg_namespace n ON n.oid = c.relnamespace
LEFT JOIN pg_stats s ON s.schemaname = n.nspname AND s.tablename = c.relname
  AND s.attname = a.attname AND NOT s.inherited
WHERE a.attnum > 0 AND NOT a.attisdropped AND c.relkind IN ('r', 'm', 'p')""",
    "idx": """
SELECT i.relname AS index_name, x.indrelid::bigint AS relid,
  string_to_array(x.indkey::text, ' ')::int[] AS indkey, x.indclass::text AS indclass,
  x.indoption::text AS indoption, pg_get_expr(x.indexprs, x.indrelid) AS indexprs,
  pg_get_expr(x.indpred, x.indrelid) AS indpred, coalesce(s.idx_scan, 0) AS idx_scan,
  coalesce(s.idx_tup_read, 0) AS idx_tup_read, coalesce(s.idx_tup_fetch, 0) AS idx_tup_fetch,
  pg_relation_size(x.indexrelid) AS size_bytes
FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid
LEFT JOIN pg_stat_all_indexes s ON s.indexrelid = x.indexrelid""",
    "fk": """
SELECT k.conname AS constraint_name, k.conrelid::bigint AS relid, u.attnum::int AS attnum,
  a.attname::text AS attname, k.confrelid::bigint AS ref_relid
FROM pg_constraint k CROSS JOIN LATERAL unnest(k.conkey) AS u(attnum)
JOIN pg_attribute a ON a.attrelid = k.conrelid AND a.attnum = u.attnum
WHERE k.contype = 'f'""",
    "sess": """
SELECT pid::bigint AS pid, state_change::timestamp AS state_change, state, usename::text AS usename
FROM pg_stat_activity WHERE pid <> pg_backend_pid() AND state IS NOT NULL""",
    "setting": "SELECT name, setting, unit FROM pg_settings",
    "ext": "SELECT extname::text AS extname FROM pg_extension",
    "dbtemp": """
SELECT datname::text AS datname, temp_files, temp_bytes FROM pg_stat_database
WHERE datname = current_database()""",
    "stmt": """
SELECT queryid, min(query) AS query, sum(calls)::bigint AS calls, sum(total_exec_time)::numeric(28,2) AS total_exec_time,
  sum(rows)::bigint AS rows_out, sum(temp_blks_read)::bigint AS temp_blks_read,
  sum(temp_blks_written)::bigint AS temp_blks_written,
  sum(shared_blks_hit)::bigint AS shared_blks_hit,
  sum(shared_blks_read)::bigint AS shared_blks_read,
  bool_or(query ~* '\\mI?LIKE\\s+''%[^'']+%''') AS has_wildcard,
  bool_or(query ~* '\\mILIKE\\s+''%[^'']+%''') AS has_ilike
FROM pg_stat_statements GROUP BY queryid""",
}

# Columns that servers give beyond a relation's schema.
SERVER_EXTRAS = {
    "idx": {"indkey": ArrayType(IntegerType()), "indclass": StringType(), "indoption": StringType(),
            "indexprs": StringType()},
    "fk": {"attname": StringType()},
    "stmt": {"temp_blks_read": LongType(), "queryid": LongType()},
}
FETCH_ROWS = 10_000


def read_relation(
    spark: SparkSession, relation: str, path: str, fmt: str = "parquet",
    captured_at: Column | None = None, schema: StructType | None = None, **options: str,
) -> DataFrame:
    """One relation from files, checked against its schema.

    Formats without a schema of their own (json, csv) are read with `schema`, by
    default the relation's own columns. Snapshots written by `write_snapshot` are partitioned by
    capture, so a condition on captured_at prunes folders.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("json", "csv"):
        reader = reader.schema(schema or RELATIONS[relation])
    df = reader.load(path)
    if captured_at is not None:
        df = df.where(captured_at)
    return conform(relation, df)


def read_snapshot(
    spark: SparkSession, folder: str, relations: Sequence[str] | None = None,
    fmt: str = "parquet", captured_at: Column | None = None,
) -> dict[str, DataFrame]:
    """All relations under one folder, a sub-folder each."""
    names = relations or list(RELATIONS)
    return {n: read_relation(spark, n, f"{folder.rstrip('/')}/{n}", fmt, captured_at)
            for n in names}


def write_snapshot(
    relations: Mapping[str, DataFrame], folder: str, captured_at: datetime
) -> None:
    """Add one capture of each relation, as a partition of its own."""
    for name, df in relations.items():
        stamped = conform(name, df).withColumn("captured_at", F.lit(captured_at))
        (stamped.write.mode("append").partitionBy("captured_at")
         .parquet(f"{folder.rstrip('/')}/{name}"))


def server_schema(relation: str) -> StructType:
    """What a server's rows of a relation hold, without asking it."""
    own = [f for f in RELATIONS[relation] if f.name not in ("instance_id", "key1", "key2")]
    more = [StructField(name, kind, True) for name, kind in SERVER_EXTRAS.get(relation, {}).items()]
    known = {f.name for f in own}
    return StructType([StructField("instance_id", LongType(), True), *own,
                       *[f for f in more if f.name not in known]])


class _ServerPartition(InputPartition):
    def __init__(self, instance: int, address: str):
        super().__init__((instance, address))


class ServerReader(DataSourceReader):
    """One partition per server; an executor connects, asks once and streams the rows."""

    def __init__(self, options: Mapping[str, str], schema: StructType):
        self.relation, self.driver, self.schema = options["relation"], options["driver"], schema
        self.servers = {int(i): a for i, a in json.loads(options["servers"]).items()}

    def partitions(self) -> list[InputPartition]:
        return [_ServerPartition(i, a) for i, a in sorted(self.servers.items())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        instance, address = partition.value
        connection = importlib.import_module(self.driver).connect(address)
        try:
            cursor = connection.cursor()
            cursor.execute(SERVER_QUERIES[self.relation])
            names = [column[0] for column in cursor.description]
            while rows := cursor.fetchmany(FETCH_ROWS):
                for row in rows:
                    found = {**dict(zip(names, row, strict=True)), "instance_id": instance}
                    yield tuple(found.get(name) for name in self.schema.fieldNames())
        finally:
            connection.close()


class _ServersPartition(InputPartition):
    def __init__(self, servers: Sequence[tuple[int, str]]):
        super().__init__(tuple(servers))


class FleetReader(ServerReader):
    """Several servers to a partition; one that cannot be read becomes a row that says so.

    Rows stream out as they come, so those of an attempt that breaks off are already given
    out. Every row therefore names its attempt, and a closing row the attempt that was
    complete, or that none was.
    """

    def __init__(self, options: Mapping[str, str], schema: StructType):
        super().__init__(options, schema)
        self.attempts, self.wait = int(options["attempts"]), float(options["wait"])
        self.together = int(options["per_partition"])

    def partitions(self) -> list[InputPartition]:
        servers = sorted(self.servers.items())
        return [_ServersPartition(servers[at:at + self.together])
                for at in range(0, len(servers), self.together)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        blank = (None,) * (len(self.schema) - len(_OUTCOME) - 1)
        for server in partition.value:
            for attempt in range(1, self.attempts + 1):
                try:
                    for row in super().read(_ServerPartition(*server)):
                        yield *row[:-len(_OUTCOME)], attempt, None, None
                    yield server[0], *blank, attempt, COMPLETE, None
                    break
                except Exception as problem:  # noqa: BLE001 - reported as a row
                    if attempt == self.attempts:
                        said = f"{type(problem).__name__}: {problem}"[:PROBLEM_CHARS]
                        yield server[0], *blank, attempt, UNREAD, said
                    else:
                        time.sleep(self.wait * 2 ** (attempt - 1))


_OUTCOME = (StructField("attempt", IntegerType(), True), StructField("outcome", StringType(), True),
            StructField("problem", StringType(), True))
COMPLETE, UNREAD = "complete", "unread"
PROBLEM_CHARS = 500


class FleetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fleet_attempts"

    def schema(self) -> StructType:
        return StructType([*server_schema(self.options["relation"]), *_OUTCOME])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FleetReader(self.options, schema)


def read_fleet(
    spark: SparkSession, relations: Sequence[str], servers: Mapping[int, str],
    driver: str = "psycopg", attempts: int = 3, wait: float = 1.0, per_partition: int = 8,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Relations of all servers that answer, and (instance_id, relation, attempts, problem)
    of those that do not.

    A server is asked again after `wait` seconds, doubled each time, `attempts` times in
    all; `per_partition` servers share a task, so a fleet of many small servers makes few
    tasks. What was read is stored in the shared folder at once, as servers give other rows
    when asked again; of a server without a complete attempt no row is kept. The problems
    are what `run_audit` takes as `unread`.
    """
    spark.dataSource.register(FleetSource)
    found, problems = {}, []
    for relation in relations:
        options = {"relation": relation, "driver": driver, "attempts": str(attempts), "wait": str(wait),
                   "per_partition": str(per_partition),
                   "servers": json.dumps({str(i): a for i, a in servers.items()})}
        rows = stored(spark.read.format("fleet_attempts").options(**options).load(), f"fleet-{relation}")
        complete = rows.where(F.col("outcome") == COMPLETE).select("instance_id", "attempt")
        kept = rows.where("outcome is null").join(complete, ["instance_id", "attempt"])
        found[relation] = conform(relation, kept.drop(*[f.name for f in _OUTCOME]))
        problems.append(rows.where(F.col("outcome") == UNREAD).select(
            "instance_id", F.lit(relation).alias("relation"), F.col("attempt").alias("attempts"), "problem"))
    return found, reduce(DataFrame.unionByName, problems)


class ServerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fleet_servers"

    def schema(self) -> StructType:
        return server_schema(self.options["relation"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ServerReader(self.options, schema)


def read_servers(
    spark: SparkSession, relation: str, servers: Mapping[int, str], driver: str = "psycopg",
) -> DataFrame:
    """One relation from live servers, given as instance id to address.

    Every server is one partition of one read, its schema is declared, so the driver
    connects to none; a server that fails ends the read (`read_fleet` goes on without it). `driver` is a DB-API module that the executors can import. Write the
    result with `write_snapshot` before auditing it.
    """
    spark.dataSource.register(ServerSource)
    rows = (spark.read.format("fleet_servers").option("relation", relation).option("driver", driver)
            .option("servers", json.dumps({str(i): a for i, a in servers.items()})).load())
    return conform(relation, rows)
