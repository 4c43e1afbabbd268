"""Telemetry relations derived from the driver's tables (FIXTURES.md part C).

Instance = customer, table = order, column/index/foreign key = lineitem,
statement execution / session change / plan line = event. The SQL is the part
both Spark and the comparison engine read the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import statement_rollup
from ..schemas import RELATIONS, conform
from ..streaming.run import file_stream

REL = """
select o_custkey as instance_id, o_orderkey as relid,
 case when o_orderkey%10=0 then 'pg_catalog' when o_orderkey%10=1 then 'information_schema'
      else 'public' end as schema_name,
 concat('t',cast(o_orderkey as string)) as relname,
 case when o_orderkey%7=0 then 'p' when o_orderkey%7=1 then 'm' else 'r' end as relkind,
 (o_orderkey%5=0) as relispartition,
 cast(case when o_orderkey%11=0 then 0 else floor(o_totalprice) end as bigint) as reltuples,
 cast(floor(o_totalprice*(1+o_orderkey%13)) as bigint) as n_live_tup,
 cast(floor(o_totalprice*(o_orderkey%40)/100) as bigint) as n_dead_tup,
 cast(floor(o_totalprice*3) as bigint) as n_tup_ins,
 cast(floor(o_totalprice*3*(o_orderkey%20)/100) as bigint) as n_tup_del,
 cast(floor(o_totalprice*4096) as bigint) as size_bytes,
 cast(floor(o_totalprice/(20+o_orderkey%200))+1 as bigint) as relpages,
 cast(o_orderkey%3 as bigint) as toastpages, cast(o_orderkey%9 as bigint) as toasttuples,
 case when o_orderkey%17=0 then 'fillfactor=70 autovacuum_enabled=false'
      when o_orderkey%17=1 then 'fillfactor=70' else '' end as reloptions
from {orders}"""

COL = """
select l_orderkey as relid, l_linenumber as attnum,
 concat('c',cast(l_linenumber as string)) as attname,
 max(l_tax) as null_frac, max(cast(floor(l_quantity) as bigint)) as avg_width,
 max(1-2*l_discount) as mcf1, min(l_returnflag) as mcv1, max(l_partkey%100) as n_distinct,
 (max(l_suppkey%8)<>0) as has_stats
from {lineitem} group by l_orderkey, l_linenumber"""

IDX = """
select concat('ix_',cast(l_orderkey as string),'_',cast(l_linenumber as string),'_',
   cast(l_partkey as string),'_',cast(l_suppkey as string),
   case when l_partkey%9=0 then '_pkey' else '' end) as index_name,
 l_orderkey as relid, l_linenumber as key1,
 case when l_suppkey%3=0 then l_linenumber%7+1 else null end as key2,
 case when l_partkey%5=0 then concat('(C',cast(l_linenumber as string),' <> 0)') else null end
   as indpred,
 l_suppkey%3 as idx_scan, l_suppkey%3 as idx_tup_read, l_suppkey%3 as idx_tup_fetch,
 cast(floor(l_extendedprice) as bigint) as size_bytes
from {lineitem}"""

FK = """
select concat('fk_',cast(l_orderkey as string),'_',cast(l_linenumber as string))
   as constraint_name,
 l_orderkey as relid, l_linenumber%7+1 as attnum, min(l_partkey) as ref_relid
from {lineitem} where l_returnflag='A' group by l_orderkey, l_linenumber"""

EXEC = """
select user_id as instance_id, event_id as exec_id, ts, value as exec_ms, event_type,
 cast(regexp_extract(props,'([0-9]+)',1) as bigint) as k,
 case event_type
  when 'view' then concat('SELECT id, total FROM t',cast(user_id%5 as string),
                          ' WHERE id = ',cast(event_id as string))
  when 'click' then concat('SELECT * FROM t',cast(user_id%5 as string),
                           ' WHERE note LIKE ''%w',cast(event_id%3 as string),'%''')
  when 'purchase' then concat('INSERT INTO t',cast(user_id%5 as string),
                              ' VALUES (',cast(event_id as string),')')
  when 'signup' then concat('SELECT count(*) FROM t',cast(user_id%5 as string),' ORDER BY 1')
  else concat('SELECT pg_sleep(',cast(event_id as string),')') end as sql_text
from {events}"""

# The log as a server with statement ids keeps it: an id per kind of statement and table.
EXEC_IDS = """
select *, cast(10 * (case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3
  when 'signup' then 4 else 5 end) + instance_id%5 as bigint) as queryid from {fx_exec}"""

# The same three statements written in many ways: comments, layout, case, quotes of every kind.
MESSY_LOG = """
select *, case event_id%9
  when 0 then concat('SELECT id, "col 1" FROM t', unit, ' WHERE note = ''it''''s ', number, '''')
  when 1 then concat('select  id,"col 1"', chr(10), 'from T', unit, ' where note=e''x', chr(92), '''y ',
                     number, ''' -- isn''t ', number)
  when 2 then concat('/* ', number, ' /* "x */ '' */ Select Id , "col 1" From t', unit,
                     ' Where note = $$a ''', number, '$$')
  when 3 then concat('INSERT INTO t', unit, ' VALUES (', number, ', ''a''), (-2, ''b'')')
  when 4 then concat('insert into t', unit, ' values(+', number, ',$q$ $$ $q$);')
  when 5 then concat('INSERT INTO t', unit, '/**/VALUES ($1, $2) ,', chr(10), '( 3.5e-2 , N''c'')')
  when 6 then concat('SELECT count(*) FROM t', unit, ' WHERE a-1 IN (', number, ', -2, 0x1F) OR a<=-', number)
  when 7 then concat('select COUNT( * ) from t', unit, ' where a - ', number, ' in (7) or a <= .5--x')
  else concat('SELECT', chr(9), 'count (*) FROM t', unit, ' WHERE a -$3 IN ($1,$2) OR a <= +', number)
  end as sql_text
from (select instance_id, exec_id as event_id, exec_id, ts, exec_ms, rows_out, temp_blks_written,
   shared_blks_hit, shared_blks_read, cast(exec_id as string) as number,
   cast(instance_id%5 as string) as unit from {fx_exec})"""

# The log's counters, all functions of k.
EXEC_COUNTERS = """
select *, k as rows_out, k*20 as temp_blks_written, k as shared_blks_hit,
 k%7 as shared_blks_read from {fx_exec}"""

PLAN = """
select instance_id, exec_id as plan_id, 1+k as calls,
 case k%4 when 0 then concat('  ->  Seq Scan on t',cast(instance_id%5 as string),
                             '  (cost=0.00..',cast(k as string),'.00)')
  when 1 then concat('  Sort Method: external merge  Disk: ',cast(k*8 as string),'kB')
  when 2 then concat('  Buckets: 1024  Batches: ',cast(1+k%5 as string),'  Memory Usage: 8kB')
  else concat('Index Scan using ix on t',cast(instance_id%5 as string)) end as line
from {fx_exec}"""

SESS = """
select user_id as instance_id, user_id%37 as pid, ts as state_change,
 case event_type when 'error' then 'idle in transaction' when 'click' then 'active'
      else 'idle' end as state,
 case when user_id%4=0 then 'monitor' else 'app' end as usename
from {events}"""

SETTING = """
select c_custkey as instance_id,
 case c_custkey%4 when 0 then 'work_mem' when 1 then 'shared_buffers'
      when 2 then 'pg_stat_statements.max' else 'log_min_duration_statement' end as name,
 cast(cast(case c_custkey%4 when 0 then 1024*(1+c_custkey%40) when 1 then 4096*(1+c_custkey%20)
      when 2 then 100*(1+c_custkey%30) else c_custkey%3-1 end as bigint) as string) as setting,
 case c_custkey%4 when 0 then 'kB' when 1 then '8kB' when 3 then 'ms' else null end as unit
from {customer}"""

EXT = """
select c_custkey as instance_id,
 case when c_custkey%5=0 then 'plpgsql' else 'pg_stat_statements' end as extname
from {customer}"""

DBTEMP = """
select instance_id, concat('db',cast(instance_id as string)) as datname,
 cast(sum(k%3) as bigint) as temp_files, cast(sum(k%3*1048576) as bigint) as temp_bytes
from {fx_exec} group by instance_id"""


# Three daily captures of cumulative counters; n is the number of the capture. Instances that
# 3 divides are reset before the third. Of tables, those that 5 divides come with the second
# capture and those that 7 divides are gone in the third; of statements, by their calls.
CAPTURED = """case n when 1 then timestamp '2024-03-01 00:00:00' when 2 then timestamp '2024-03-02 00:00:00'
  else timestamp '2024-03-03 00:00:00' end"""
GROWN = "(case when n=1 then 10 when n=2 then 25 when instance_id%3=0 then 5 else 40 end)"

IDX_OWNED = "(select i.*, o_custkey as instance_id from {fx_idx_thrice} i join {orders} on o_orderkey=relid)"
IDX_CAPTURES = f"""
select instance_id, index_name, relid, key1, key2, indpred, size_bytes, {CAPTURED} as captured_at,
 idx_scan*{GROWN} as idx_scan, idx_tup_read*{GROWN}+100 as idx_tup_read,
 idx_tup_fetch*{GROWN} as idx_tup_fetch
from {IDX_OWNED}
where (n>1 or relid%5<>0) and (n<3 or relid%7<>0)"""

STMT_CAPTURES = f"""
select instance_id, query, calls*{GROWN} as calls,
 cast(total_exec_time*{GROWN} as decimal(28,2)) as total_exec_time, rows_out*{GROWN} as rows_out,
 temp_blks_written*{GROWN} as temp_blks_written, shared_blks_hit*{GROWN} as shared_blks_hit,
 shared_blks_read*{GROWN} as shared_blks_read, has_wildcard, has_ilike, {CAPTURED} as captured_at
from {{fx_stmt_thrice}} where (n>1 or calls%5<>0) and (n<3 or calls%7<>0)"""

# Terms looked for in the documents, and the order seed of the random subset (fixed values).
SEARCH_TERMS = ("the", "license", "de ", "http", "Copyright", "password", "und ", "@")
SUBSET_SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class FixtureTelemetry:
    """The relations over one folder of driver tables, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self._spark.sql(text, **frames)

    def _build(self, name: str) -> DataFrame:
        def of(source: str, text: str) -> DataFrame:
            return self._sql(text, **{source: table(self._spark, self._dir, source)})

        if name == "rel":
            return of("orders", REL)
        if name in ("col", "idx", "fk"):
            return of("lineitem", {"col": COL, "idx": IDX, "fk": FK}[name])
        if name == "log":
            return of("events", EXEC)
        if name == "exec":
            return self._sql(EXEC_COUNTERS, fx_exec=self["log"])
        if name == "messy":
            return conform("exec", self._sql(MESSY_LOG, fx_exec=self["exec"]))
        if name == "stmt_ids":
            return conform("stmt", statement_rollup(self._sql(EXEC_IDS, fx_exec=self["exec"]), "all"))
        if name == "plan_ids":
            return conform("plan", self._sql(
                PLAN.replace("plan_id,", "plan_id, queryid,"),
                fx_exec=self._sql(EXEC_IDS, fx_exec=self["log"])))
        if name == "stmt":
            return statement_rollup(self["exec"])
        if name in ("idx_captures", "stmt_captures"):
            kind = name.split("_")[0]
            source = self._owned_indexes() if kind == "idx" else self[kind]
            thrice = source.withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
            text = {"idx": IDX_CAPTURES.replace(IDX_OWNED, "{fx_idx_thrice}"), "stmt": STMT_CAPTURES}[kind]
            return conform(kind, self._sql(text, **{f"fx_{kind}_thrice": thrice}))
        if name in ("plan", "dbtemp"):
            return self._sql({"plan": PLAN, "dbtemp": DBTEMP}[name], fx_exec=self["log"])
        if name == "sess":
            return of("events", SESS)
        if name in ("setting", "ext"):
            return of("customer", {"setting": SETTING, "ext": EXT}[name])
        raise KeyError(name)

    def _owned_indexes(self) -> DataFrame:
        """`idx` with its instance (IDX_OWNED): bare columns are joined, before names are built of
        them and rows are repeated for captures."""
        orders = table(self._spark, self._dir, "orders").select("o_orderkey", "o_custkey")
        rows = table(self._spark, self._dir, "lineitem").join(
            orders, F.col("o_orderkey") == F.col("l_orderkey"))
        text = IDX.replace("select ", "select o_custkey as instance_id, ", 1)
        return conform("idx", self._sql(text, lineitem=rows))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            made = self._build(name)
            self._made[name] = conform(name, made) if name in RELATIONS else made
        return self._made[name]

    def stream(self, name: str) -> DataFrame:
        """The log or the sessions as a stream over the events file."""
        schema = table(self._spark, self._dir, "events").schema
        events = file_stream(self._spark, self._dir, schema, "events.parquet")
        if name == "sess":
            return conform(name, self._sql(SESS, events=events))
        if name == "exec":
            return conform(name, self._sql(EXEC_COUNTERS, fx_exec=self._sql(EXEC, events=events)))
        raise KeyError(name)

    def relations(self) -> dict[str, DataFrame]:
        names = ("rel", "col", "idx", "fk", "exec", "stmt", "plan", "sess", "setting", "ext",
                 "dbtemp")
        return {name: self[name] for name in names}
