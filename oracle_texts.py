"""The same queries as SQL for the comparison engine (DuckDB).

PARTS are named subqueries; a query pulls in those it mentions. The relations of
FIXTURES.md share their text with the Spark side, everything else is written
independently of the library.
"""

from __future__ import annotations

import re

from fleetvitals.sources import fixture_views as fx


def _bound(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text).strip()


def pretty(x: str) -> str:
    """Size text: half units, then half up."""
    def unit(size: int, name: str) -> str:
        return f"concat(cast((({x}) // {size // 2} + 1) // 2 as varchar), ' {name}')"

    ladder = [f"when ({x}) < 10240 then concat(cast(({x}) as varchar), ' bytes')"]
    for power, name in ((1, "kB"), (2, "MB"), (3, "GB"), (4, "TB")):
        half = 1024**power // 2
        ladder.append(f"when ({x}) // {half} < 20479 then {unit(1024**power, name)}")
    return f"(case {' '.join(ladder)} else {unit(1024**5, 'PB')} end)"


def rounded(x: str, digits: int = 2) -> str:
    """Rounding of the decimal digits of a double, half away from zero."""
    return f"cast(round(cast({x} as decimal(28,10)), {digits}) as double)"


def fixed(x: str, digits: int = 2) -> str:
    return f"cast(cast(round(cast({x} as decimal(28,10)), {digits}) as decimal(28,{digits})) as varchar)"


def grouped(x: str) -> str:
    return f"format('{{:,}}', cast({x} as bigint))"


def mb_of(setting: str = "setting", unit: str = "unit") -> str:
    value = f"try_cast({setting} as bigint)"
    return (f"(case when {unit} = 'kB' then {value} / 1024.0 when {unit} = '8kB' "
            f"then {value} * 8 / 1024.0 else {value} end)::double")


def spill(mb: str) -> str:
    return f"(case when {mb} >= 100 then 'HIGH' when {mb} >= 10 then 'MEDIUM' else 'LOW' end)"


STMT_COLUMNS = """
 count(*) as calls, sum(cast(exec_ms as decimal(12,2))) as total_exec_time,
 cast(sum(k) as bigint) as rows_out, cast(sum(k*20) as bigint) as temp_blks_written,
 cast(sum(k) as bigint) as shared_blks_hit, cast(sum(k%7) as bigint) as shared_blks_read,
 bool_or(regexp_matches(sql_text, '(?i)\\bI?LIKE\\s+''%[^'']+%''')) as has_wildcard,
 bool_or(regexp_matches(sql_text, '(?i)\\bILIKE\\s+''%[^'']+%''')) as has_ilike"""
SAMPLE_ID = ", min(exec_id) as sample_exec_id"

OPERANDS = r"regexp_replace(sql_text,'(= |\()[0-9]+','\1$1','g')"
# What a statement of the log is, by how it begins and its table: no literal is looked at.
STATEMENT = "concat(regexp_extract({x}, '^(SELECT [a-z*]+|INSERT)', 1), regexp_extract({x}, ' t[0-9]+', 0))"
# What the kinds of events in the log are without their literals.
CANONICAL = """case event_type
 when 'view' then concat('SELECT id, total FROM t', instance_id % 5, ' WHERE id = $1')
 when 'click' then concat('SELECT * FROM t', instance_id % 5, ' WHERE note LIKE $1')
 when 'purchase' then concat('INSERT INTO t', instance_id % 5, ' VALUES ($1)')
 when 'signup' then concat('SELECT count(*) FROM t', instance_id % 5, ' ORDER BY $1')
 else 'SELECT pg_sleep($1)' end"""
EVENT_ID = """10 * (case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3
 when 'signup' then 4 else 5 end) + instance_id % 5"""
SIGNS = r"""
 bool_or(contains(line,'Sort Method: external merge') or contains(line,'Disk:')) as sort_on_disk,
 max(coalesce(try_cast(nullif(regexp_extract(line,'Batches:\s*(\d+)',1),'') as int),0)) as batches,
 arg_min(nullif(regexp_extract(line,'Seq Scan on (\w+)',1),''), plan_id) filter
   (where regexp_matches(line,'Seq Scan on (\w+)')) as scanned"""
USER = "schema_name not in ('pg_catalog','information_schema','pg_toast')"

MEAN = "(cast(total_exec_time as double) / calls)"
HIT = ("(case when shared_blks_hit + shared_blks_read > 0 then "
       + rounded("100::double * shared_blks_hit / (shared_blks_hit + shared_blks_read)")
       + " else 100 end)::double")
TEMP_MB = rounded("cast(temp_blks_written as double) * 8192 / 1048576")
RATIO = ("(case when n_live_tup > 0 and reltuples > 0 then "
         + rounded("greatest(reltuples, n_live_tup)::double / least(reltuples, n_live_tup)")
         + " end)")
DEAD = ("(case when n_live_tup + n_dead_tup > 0 then "
        + rounded("100::double * n_dead_tup / (n_live_tup + n_dead_tup)") + " else 0 end)::double")
DELETES = ("(case when n_tup_ins > 0 then " + rounded("100::double * n_tup_del / n_tup_ins")
           + " else 0 end)::double")
RARE = "(n_tup_ins = 0 or n_tup_del::double / nullif(n_tup_ins, 0) < 0.05)"
SIZE_MB = "(size_bytes // 1048576)"
CANDIDATE = (f"({USER} and relkind = 'r' and not relispartition and n_tup_ins > 100000 and "
             f"size_bytes > 524288000 and {RARE})")
CANDIDATE_ANY = (f"({USER} and (relkind = 'r' or not relispartition or n_tup_ins > 100000 "
                 f"or size_bytes > 524288000 or {RARE}))")
REASONS = f"""coalesce(nullif(concat_ws('; ',
 case when {SIZE_MB} > 500 then concat('takes ', {SIZE_MB}, ' MB (limit 500 MB)') end,
 case when n_tup_ins > 100000 then concat('has ', {grouped('n_tup_ins')}, ' inserts') end,
 case when {DELETES} < 5 then concat('deletes only ', {fixed(DELETES)}, '% of its inserts') end),
 ''), 'is a candidate by its growth')"""
WILD_KIND = ("case when has_ilike then 'ILIKE with a leading wildcard' "
             "else 'LIKE with a leading wildcard' end")
WILD_SEVERITY = (f"case when calls > 100 and {MEAN} > 500 then 'HIGH' "
                 f"when calls > 50 or {MEAN} > 1000 then 'MEDIUM' else 'LOW' end")
BAND = f"case when {DEAD} > 20 then 'alarming' when {DEAD} > 10 then 'elevated' else 'optimal' end"

TOP = "row_number() over (partition by instance_id order by {by} desc, query) as rn"



def _change_parts(kind: str, keys: str, counters: tuple[str, ...], others: str) -> dict[str, str]:
    """What happened between captures, by joining every row to all earlier ones of its object."""
    same = " and ".join(f"p.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    was = ", ".join(f"arg_max(p.{c}, p.captured_at) as was_{c}" for c in counters)
    fell = " or ".join(f"{c} < was_{c}" for c in counters)
    change = ", ".join(f"case when {fell} then {c} else {c} - coalesce(was_{c}, 0) end as {c}"
                       for c in counters)
    return {
        f"{kind}_once": f"""
select * from fx_{kind}_captures qualify row_number() over (partition by {keys}, captured_at
 order by {counters[0]} desc, {others} desc) = 1""",
        f"{kind}_times": f"select distinct instance_id, captured_at from fx_{kind}_captures",
        f"{kind}_pairs": f"""
select c.*, max(p.captured_at) as before, {was}
from {kind}_once c left join {kind}_once p on {same} and p.captured_at < c.captured_at group by all""",
        f"{kind}_falls": f"select distinct instance_id as fallen, captured_at as fallen_at from {kind}_pairs where {fell}",
        f"{kind}_since": f"""
select c.instance_id, c.captured_at, max(p.captured_at) as earlier from {kind}_times c
 join {kind}_times p on p.instance_id = c.instance_id and p.captured_at < c.captured_at group by all""",
        f"{kind}_changes": f"""
select c.* replace ({change}), coalesce(before, earlier) as previous_at,
 coalesce({fell}, false) as was_reset,
 not exists (select 1 from {kind}_falls where fallen = c.instance_id
   and fallen_at > coalesce(before, earlier) and fallen_at <= c.captured_at) as exact
from {kind}_pairs c join {kind}_since using (instance_id, captured_at)""",
    }


PARTS = {
    "fx_rel": _bound(fx.REL), "fx_col": _bound(fx.COL), "fx_idx": _bound(fx.IDX),
    "fx_fk": _bound(fx.FK), "fx_exec": _bound(fx.EXEC), "fx_plan": _bound(fx.PLAN),
    "fx_sess": _bound(fx.SESS), "fx_set": _bound(fx.SETTING), "fx_ext": _bound(fx.EXT),
    "fx_dbtemp": _bound(fx.DBTEMP),
    "fx_stmt": f"select instance_id, {OPERANDS} as query, {STMT_COLUMNS} {SAMPLE_ID} from fx_exec group by 1,2",
    "fx_idx_thrice": "select *, unnest([1, 2, 3]) as n from fx_idx",
    "fx_stmt_thrice": "select *, unnest([1, 2, 3]) as n from fx_stmt",
    "fx_idx_captures": _bound(fx.IDX_CAPTURES), "fx_stmt_captures": _bound(fx.STMT_CAPTURES),
    **_change_parts("idx", "instance_id, relid, index_name",
                    ("idx_scan", "idx_tup_read", "idx_tup_fetch"), "size_bytes"),
    **_change_parts("stmt", "instance_id, query",
                    ("calls", "total_exec_time", "rows_out", "temp_blks_written",
                     "shared_blks_hit", "shared_blks_read"), "query"),
    "partial_missing": f"""
select r.instance_id, r.relname as table_name, c.attname as column_name,
 r.reltuples as estimated_rows, c.mcv1 as dominant_value,
 {rounded('c.mcf1*100')} as percent_occurrence, cast(c.n_distinct as double) as estimated_distinct
from fx_col c join fx_rel r on r.relid = c.relid
where c.mcf1 > 0.85 and r.reltuples > 10000 and r.schema_name not like 'pg_%'
 and r.schema_name <> 'information_schema'
 and not exists (select 1 from fx_idx i where i.relid = c.relid and i.indpred is not null
   and contains(lower(i.indpred), lower(c.attname)))""",
    "fk_described": """
select r.instance_id, f.constraint_name, r.relname as table_name,
 coalesce(a.attname, concat('c', f.attnum)) as column_name, coalesce(p.relname, cast(f.ref_relid as varchar))
   as referenced_table,
 case when exists (select 1 from fx_idx i where i.relid = f.relid and i.key1 = f.attnum)
   then 'yes' else 'no' end as has_index
from fx_fk f join fx_rel r on r.relid = f.relid left join fx_rel p
 on p.relid = f.ref_relid and p.instance_id = r.instance_id
 left join fx_col a on a.relid = f.relid and a.attnum = f.attnum""",
    "duplicates": """
select r.instance_id, r.relname as table_name, concat_ws(', ',
   coalesce(any_value(a.attname), concat('c', i.key1)),
   case when i.key2 is not null then coalesce(any_value(b.attname), concat('c', i.key2)) end)
   as columns,
 string_agg(distinct i.index_name, ', ' order by i.index_name) as index_names,
 count(*) as count, min(i.index_name) as keep_name,
 list_sort(list(distinct i.index_name)) as names
from fx_idx i join fx_rel r on r.relid = i.relid
left join fx_col a on a.relid = i.relid and a.attnum = i.key1
left join fx_col b on b.relid = i.relid and b.attnum = i.key2
where r.schema_name not in ('pg_catalog','information_schema','pg_toast')
group by r.instance_id, r.relname, i.relid, i.key1, i.key2 having count(*) > 1""",
    "unused": f"""
select r.instance_id, r.relname as table_name, i.index_name, i.idx_scan,
 {pretty('i.size_bytes')} as size, i.size_bytes
from fx_idx i join fx_rel r on r.relid = i.relid
where i.idx_scan = 0 and i.idx_tup_read = 0 and i.idx_tup_fetch = 0
 and i.index_name not like '%_pkey' and r.{USER}""",
    "stale": f"""
select instance_id, schema_name, relname as table_name, reltuples as planner_estimate,
 n_live_tup as stats_live_tuples, {RATIO} as divergence_ratio,
 case when {RATIO} > 10 then 'CRITICAL' when {RATIO} > 5 then 'WARNING' else 'OK' end
   as stats_severity
from fx_rel where schema_name not like 'pg_%' and {USER} and relkind = 'r'
 and ({RATIO} > 5 or (reltuples = 0 and n_live_tup > 100))""",
    "col_widths": """
select relid, count(*) as n_columns, count(*) filter (where has_stats) as n_stats,
 max(null_frac) as max_null,
 cast(sum((1-cast(null_frac as decimal(12,8)))*avg_width) as double) as data
from fx_col group by relid""",
    "bloat_sized": """
select r.*, r.relpages + r.toastpages as pages, w.data,
 coalesce(try_cast(nullif(regexp_extract(r.reloptions,'fillfactor=([0-9]+)',1),'') as int),100)
   as fillfactor,
 23 + case when w.max_null > 0 then (7 + w.n_stats) // 8 else 0 end as hdr
from fx_rel r join col_widths w on w.relid = r.relid
where r.relkind in ('r','m') and w.n_columns = w.n_stats""",
    "bloat_tuples": """
select *, 4 + hdr + data + 16 - (case when hdr % 8 = 0 then 8 else hdr % 8 end)
 - (case when cast(ceil(data) as bigint) % 8 = 0 then 8 else cast(ceil(data) as bigint) % 8 end)
   as tpl
from bloat_sized""",
    "bloat_pages": """
select *, cast(ceil(reltuples/(8168/tpl)) + ceil(toasttuples/4.0) as bigint) as est,
 cast(ceil(reltuples/(8168*fillfactor/(tpl*100))) + ceil(toasttuples/4.0) as bigint) as est_ff
from bloat_tuples""",
    "bloat": """
select instance_id, schema_name as schemaname, relname as tblname, pages*8192 as real_size,
 (pages-est)*8192 as extra_size,
 case when pages > 0 and pages > est then 100*(pages-est)/pages::double else 0.0::double end
   as extra_pct,
 fillfactor, case when pages > est_ff then (pages-est_ff)*8192 else 0 end as bloat_size,
 case when pages > 0 and pages > est_ff then 100*(pages-est_ff)/pages::double
   else 0.0::double end as bloat_pct,
 false as is_na
from bloat_pages""",
    "tracked": "select distinct instance_id from fx_ext where extname = 'pg_stat_statements'",
    "enabled": """select instance_id, bool_or(extname = 'pg_stat_statements') as enabled
from fx_ext group by 1""",
    "covering": rf"""
select * from (select *, {TOP.format(by='total_exec_time')} from fx_stmt
 where query ilike 'SELECT%' and regexp_matches(query, 'WHERE\s+\S+\s*=\s*\$[0-9]')
  and query not ilike 'SELECT *%' and query not ilike 'SELECT count(*)%' and calls >= 5
  and query not ilike '%pg_stat%' and query not ilike '%pg_class%'
  and query not ilike '%pg_index%' and query not ilike '%information_schema%') where rn <= 15""",
    "wildcards": f"""
select * from (select *, {TOP.format(by='total_exec_time')} from fx_stmt
 where has_wildcard and calls >= 2 and query not ilike '%pg_%'
  and query not ilike '%information_schema%') where rn <= 15""",
    "spills": f"""
select *, {TEMP_MB} as temp_mb from
 (select *, {TOP.format(by='temp_blks_written')} from fx_stmt where temp_blks_written > 0)
where rn <= 5 and {TEMP_MB} >= 1 and instance_id in (select instance_id from tracked)""",
    "top_time": f"""
select *, md5(query) as queryid from (select *, {TOP.format(by='total_exec_time')} from fx_stmt
 where total_exec_time >= 100)
where rn <= 5 and instance_id in (select instance_id from tracked)""",
    "scannable": f"""
select *, md5(query) as queryid from (select *, {TOP.format(by='total_exec_time')} from fx_stmt
 where (query ilike 'SELECT %' or query ilike 'INSERT %' or query ilike 'UPDATE %'
   or query ilike 'DELETE %' or query ilike 'WITH %')
  and query not ilike 'SELECT pg_%' and query not ilike 'SELECT current_database%'
  and query not ilike 'EXPLAIN %') where rn <= 20""",
    "explained": f"""
select e.instance_id, {STATEMENT.format(x='sql_text')} as query, {SIGNS}
from fx_plan p join fx_exec e on e.exec_id = p.plan_id and e.instance_id = p.instance_id
group by 1,2""",
    "top_selects": f"""
select t.*, x.sort_on_disk, x.batches from top_time t join explained x
 on x.instance_id = t.instance_id and x.query = {STATEMENT.format(x='t.query')}
where upper(trim(t.query)) like 'SELECT%'""",
    "scans": f"""
select t.*, x.scanned from scannable t join explained x
 on x.instance_id = t.instance_id and x.query = {STATEMENT.format(x='t.query')}
where x.scanned is not null""",
    "id_stmt": f"""
select instance_id, {EVENT_ID} as queryid, {CANONICAL} as query, {STMT_COLUMNS} from fx_exec group by 1,2,3""",
    "id_signs": f"""
select e.instance_id, {EVENT_ID.replace('instance_id', 'e.instance_id')} as queryid, {SIGNS}
from fx_plan p join (select instance_id, exec_id, event_type from fx_exec) e
 on e.exec_id = p.plan_id and e.instance_id = p.instance_id group by 1,2""",
    "id_top": f"""
select t.*, x.sort_on_disk, x.batches from (select *, {TOP.format(by='total_exec_time')} from id_stmt
 where total_exec_time >= 100) t join id_signs x on x.instance_id = t.instance_id and x.queryid = t.queryid
where rn <= 5 and t.instance_id in (select instance_id from tracked) and t.query like 'SELECT%'""",
    "id_scans": f"""
select t.*, x.scanned from (select *, {TOP.format(by='total_exec_time')} from id_stmt
 where (query like 'SELECT %' or query like 'INSERT %') and query not like 'SELECT pg_%') t
join id_signs x on x.instance_id = t.instance_id and x.queryid = t.queryid
where rn <= 20 and x.scanned is not null""",
    "settings": f"select *, {mb_of()} as value_mb, try_cast(setting as int) as limit_value from fx_set",
    "db_temp": f"""
select instance_id, datname, temp_files, {rounded('temp_bytes::double/1048576')} as temp_mb,
 {spill(rounded('temp_bytes::double/1048576'))} as severity
from fx_dbtemp where temp_files > 0""",
    "last_state": """
select instance_id, pid, max(state_change) as state_change,
 arg_max(state, (state_change, state, usename)) as state,
 arg_max(usename, (state_change, state, usename)) as usename
from fx_sess group by 1,2""",
    "aged_sessions": """
select *, date_diff('microsecond', state_change, (select max(state_change) from fx_sess))
  / 1000000.0 as secs
from last_state where state in ('active','idle in transaction') and usename = 'app'""",
    "long_sessions": f"""
select instance_id, pid as session_pid, state as session_state,
 {rounded('secs::double/60')} as idle_minutes,
 concat('Session ', pid, ' has been ', state, ' for ', {fixed('secs::double/60')},
   ' minutes and holds its resources.') as description,
 case when secs > 120 then 'HIGH' else 'MEDIUM' end as severity
from aged_sessions where secs > 60""",
}

_T = "concat(schema_name, '.', relname)"
_F = ("instance_id, category, detector, severity, object_name, title, evidence, recommendation, "
      "sql_fix, metric, weight")


def _finding(source: str, category: str, detector: str, severity: str, obj: str, title: str,
             evidence: str, recommendation: str, fix: str, metric: str, weight: str,
             where: str = "true") -> str:
    if obj == _STATEMENT:
        evidence = f"concat({evidence}, ' Statement: ', {_SAMPLE})"
    return f"""select instance_id, '{category}' as category, '{detector}' as detector,
 {severity} as severity, {obj} as object_name, {title} as title, {evidence} as evidence,
 {recommendation} as recommendation, {fix} as sql_fix, cast({metric} as double) as metric,
 cast({weight} as int) as weight from {source} where {where}"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_EXPLAIN = _q("EXPLAIN (ANALYZE, BUFFERS) <statement>;")
_SAMPLE = "left(query, 300)"
_STATEMENT = "md5(query)"
_MEAN2 = fixed(MEAN)
_CALLS = grouped("calls")
_SPILLW = "case when temp_mb >= 100 then 8 when temp_mb >= 10 then 5 else 0 end"
_QUOTE = "concat('''', replace(dominant_value, '''', ''''''), '''')"

FINDINGS = [
    _finding("bloat", "bloat", "table_bloat", "case when bloat_pct > 20 then 'MEDIUM' else 'OK' end",
             "concat(schemaname, '.', tblname)", "'Table bloat'",
             f"concat('Table ', schemaname, '.', tblname, ' is about ', {fixed('bloat_pct', 1)}, "
             f"'% bloat (', {grouped('bloat_size')}, ' bytes).')",
             "'Rewrite the table in a quiet hour.'",
             "concat('VACUUM FULL ', schemaname, '.', tblname, ';')", "bloat_pct",
             "case when bloat_pct > 20 then 5 else 0 end"),
    _finding("fx_rel", "bloat", "disabled_autovacuum", "'HIGH'", "relname",
             "'Autovacuum disabled on a table'",
             "concat('Table ', relname, ' switches autovacuum off in its options: ', reloptions, '.')",
             "'Let autovacuum run on this table again.'",
             "concat('ALTER TABLE ', relname, ' RESET (autovacuum_enabled);')", "null", "10",
             "reloptions like '%autovacuum_enabled=false%'"),
    _finding("fx_rel", "bloat", "dead_tuples",
             f"case when {DEAD} > 20 then 'HIGH' when {DEAD} > 10 then 'MEDIUM' else 'OK' end", _T,
             "'Dead rows'",
             f"concat('Table ', {_T}, ' holds ', {fixed(DEAD)}, '% dead rows (', "
             f"{grouped('n_dead_tup')}, ').')",
             f"concat('State: ', {BAND})",
             f"concat(case when {DEAD} > 20 then 'VACUUM FULL ANALYZE ' else 'VACUUM ANALYZE ' end, "
             f"{_T}, ';')", DEAD, f"case when {DEAD} > 10 then 5 else 0 end", USER),
    *[_finding("settings", "config", name, "'OK'", "name", f"'Current {name}'",
               f"concat('{name}', ' = ', setting, ' ', coalesce(unit, ''))", "'For information.'",
               "''", "value_mb", "0", f"name = '{name}'") for name in ("work_mem", "shared_buffers")],
    _finding("settings", "config", "work_mem_evaluation", "'MEDIUM'", "name", "'Low work_mem'",
             f"concat('work_mem is ', {fixed('value_mb')}, ' MB.')",
             "'Raise it with care; sorts and hashes that do not fit go to disk.'",
             _q("ALTER SYSTEM SET work_mem = '64MB';"), "value_mb", "8",
             "name = 'work_mem' and value_mb < 16"),
    _finding("settings", "config", "shared_buffers_evaluation", "'MEDIUM'", "name",
             "'Low shared_buffers'",
             f"concat('shared_buffers is about ', {fixed('value_mb')}, ' MB.')",
             "'Size it by the memory of the server.'",
             _q("ALTER SYSTEM SET shared_buffers = '256MB';"), "value_mb", "8",
             "name = 'shared_buffers' and value_mb < 256"),
    _finding("settings", "config", "pg_stat_max_evaluation", "'MEDIUM'", "name",
             "'Low pg_stat_statements.max'",
             "concat('pg_stat_statements.max is ', setting, '.')",
             "'Keep more statements to see the whole workload.'",
             "'ALTER SYSTEM SET pg_stat_statements.max = 5000;'", "limit_value", "5",
             "name = 'pg_stat_statements.max' and limit_value < 1000"),
    _finding("settings", "config", "pg_stat_limit",
             "case when limit_value < 500 then 'MEDIUM' else 'LOW' end", "name",
             "'Statements fall out of tracking'",
             "concat('Tracking stops at ', setting, ' statements, below the advised 1000.')",
             "'Raise the limit to 5000 to 10000; needs a restart.'",
             "'ALTER SYSTEM SET pg_stat_statements.max = 5000;'", "limit_value", "3",
             "name = 'pg_stat_statements.max' and limit_value < 1000 "
             "and instance_id in (select instance_id from tracked)"),
    _finding("settings", "config", "slow_query_logging", "'MEDIUM'", "name",
             "'Slow statements are not logged'", "concat(name, ' is ', setting, '.')",
             "'Log statements from 1000 ms.'",
             _q("ALTER SYSTEM SET log_min_duration_statement = '1000ms';"), "null", "5",
             "name = 'log_min_duration_statement' and setting = '-1'"),
    _finding("fx_rel", "health", "partitioning_candidates", "'MEDIUM'", _T, "'Table to partition'",
             f"concat('Table ', {_T}, ' (', {pretty('size_bytes')}, ') ', {REASONS}, '.')",
             "'Split the table by a date range and drop old partitions.'",
             f"concat('CREATE TABLE ', {_T}, '_partitioned (LIKE ', {_T}, "
             "' INCLUDING ALL) PARTITION BY RANGE (created_at);')", SIZE_MB, "2", CANDIDATE),
    _finding("long_sessions", "health", "idle_in_transaction", "severity",
             "cast(session_pid as varchar)", "'Long session'",
             f"concat('Session ', session_pid, ' has been ', session_state, ' for ', "
             f"{fixed('idle_minutes')}, ' minutes.')",
             "'End the session or set idle_in_transaction_session_timeout.'",
             "concat('SELECT pg_terminate_backend(', session_pid, ');')", "idle_minutes", "10"),
    _finding("partial_missing", "indexes", "missing_partial", "'MEDIUM'",
             "concat(table_name, '.', column_name)", "'Missing partial index'",
             f"concat('Column ', column_name, ' of ', table_name, ' is ', "
             f"{fixed('percent_occurrence', 1)}, '% the value ', {_QUOTE}, "
             "' and no partial index leaves it out.')",
             "'Index only the rows without the dominant value.'",
             "concat('CREATE INDEX CONCURRENTLY idx_', table_name, '_', column_name, '_partial ON ', "
             f"table_name, ' (', column_name, ') WHERE ', column_name, ' <> ', {_QUOTE}, ';')",
             "percent_occurrence", "3"),
    _finding("fk_described", "indexes", "missing_indexes", "'HIGH'", "constraint_name",
             "'Foreign key without index'",
             "concat('Foreign key ', constraint_name, ' on ', table_name, '.', column_name, "
             "' refers to ', referenced_table, ' and leads no index.')",
             "'Index the referring column.'",
             "concat('CREATE INDEX CONCURRENTLY idx_', replace(table_name, '.', '_'), '_', "
             "column_name, '_fk ON ', table_name, ' (', column_name, ');')", "null", "6",
             "has_index = 'no'"),
    _finding("duplicates", "indexes", "duplicate_indexes", "'MEDIUM'", "table_name",
             "'Duplicate indexes'",
             "concat('Table ', table_name, ' has ', count, ' indexes on (', columns, '): ', "
             "index_names, '.')", "concat('Keep ', keep_name, ' and drop the others.')",
             "array_to_string(list_transform(names[2:], lambda n: concat('DROP INDEX CONCURRENTLY ', n, "
             "';')), chr(10))", "count", "4"),
    _finding("unused", "indexes", "unused_indexes", "'LOW'", "index_name", "'Unused index'",
             "concat('Index ', index_name, ' on ', table_name, ' takes ', size, "
             "' and was never scanned.')", "'Drop it once its use is ruled out.'",
             "concat('DROP INDEX CONCURRENTLY ', index_name, ';')", "size_bytes", "3"),
    _finding("covering", "indexes", "covering_candidates", "'LOW'", _STATEMENT,
             "'Covering index candidate'",
             f"concat('Run ', {_CALLS}, ' times at ', {_MEAN2}, ' ms each with ', {fixed(HIT, 1)}, "
             "'% cache hits.')", "'Add the read columns to the index of the filter column.'",
             "'CREATE INDEX CONCURRENTLY idx_covering ON table_name (filter_column) "
             "INCLUDE (read_columns);'", HIT, "2"),
    _finding("stale", "indexes", "obsolete_stats", "stats_severity",
             "concat(schema_name, '.', table_name)", "'Stale planner statistics'",
             f"concat('Table ', schema_name, '.', table_name, ': the planner expects ', "
             f"{grouped('planner_estimate')}, ' rows, the collector counts ', "
             f"{grouped('stats_live_tuples')}, ', ', {fixed('coalesce(divergence_ratio, 0)', 1)}, "
             "' times apart.')",
             "'Refresh the statistics; raise the column targets if the gap returns.'",
             "concat('ANALYZE ', schema_name, '.', table_name, ';')", "divergence_ratio", "5"),
    _finding("wildcards", "indexes", "wildcard_searches", WILD_SEVERITY, _STATEMENT,
             "'Search with a leading wildcard'",
             f"concat({WILD_KIND}, ', run ', {_CALLS}, ' times at ', {_MEAN2}, ' ms each.')",
             "'Use a trigram index; ordinary indexes cannot serve this search.'",
             "concat('CREATE EXTENSION IF NOT EXISTS pg_trgm;', chr(10), 'CREATE INDEX CONCURRENTLY "
             "idx_trgm ON table_name USING gin (column_name gin_trgm_ops);')", MEAN, "3"),
    _finding("enabled", "queries", "pg_stat_statements", "'OK'", "'pg_stat_statements'",
             "'Statement statistics'",
             "concat('Statement statistics are ', case when enabled then 'enabled' "
             "else 'not enabled' end, '.')", "'For information.'", "''", "enabled::int", "0"),
    _finding("enabled", "queries", "temp_spills", "'LOW'", "'pg_stat_statements'",
             "'Statement statistics are not enabled'",
             "'The extension pg_stat_statements is missing.'",
             "'Enable it to see slow and spilling statements.'",
             "'CREATE EXTENSION IF NOT EXISTS pg_stat_statements;'", "null", "0", "not enabled"),
    _finding("spills", "queries", "temp_spills", spill("temp_mb"), _STATEMENT,
             "'Temporary files in use'",
             f"concat('Wrote ', temp_blks_written, ' temporary blocks, about ', {fixed('temp_mb')}, "
             "' MB.')", "'Check sorts, groupings and joins, and whether work_mem is enough.'",
             _EXPLAIN, "temp_mb", _SPILLW),
    _finding("scans", "queries", "seq_scans", "'MEDIUM'", _STATEMENT, "'Sequential scan'",
             f"concat('Statement ', queryid, ' scans ', scanned, ' in sequence and ran ', {_CALLS}, "
             "' times.')", "concat('Check whether ', scanned, ' needs an index.')",
             "concat('CREATE INDEX CONCURRENTLY idx_', scanned, '_filter ON ', scanned, "
             "' (filter_column);')", "calls", "4"),
    _finding("top_time", "queries", "top_time_queries", "'MEDIUM'", _STATEMENT,
             "'Statement with a high total time'",
             f"concat('Total ', {fixed('total_exec_time')}, ' ms over ', {_CALLS}, ' calls, mean ', "
             f"{_MEAN2}, ' ms.')", "'Study its plan.'", _EXPLAIN, "total_exec_time", "4"),
    _finding("db_temp", "queries", "db_temp_usage", "severity", "datname",
             "'Temporary files in the database'",
             f"concat('Database ', datname, ' wrote ', temp_files, ' temporary files, about ', "
             f"{fixed('temp_mb')}, ' MB.')", "'Check sorts, groupings and joins, and work_mem.'",
             "'SELECT query FROM pg_stat_statements ORDER BY temp_blks_written DESC;'", "temp_mb",
             "5"),
    _finding("top_selects", "queries", "explain_spills", "'HIGH'", _STATEMENT,
             "'Sort on disk in the plan'", "'A captured plan sorts on disk.'",
             "'Check ORDER BY, GROUP BY and DISTINCT, then work_mem.'", _EXPLAIN, "null", "6",
             "sort_on_disk"),
    _finding("top_selects", "queries", "explain_spills", "'HIGH'", _STATEMENT,
             "'Hash in batches in the plan'",
             "concat('A captured plan needs ', batches, ' batches for a hash.')",
             "'Check hash joins and groupings, then work_mem.'", _EXPLAIN, "batches", "6",
             "batches > 1"),
]

_INFO = "('work_mem','shared_buffers','pg_stat_statements')"
PARTS["findings"] = "\nunion all ".join(FINDINGS)
PARTS["instances"] = "\nunion ".join(
    f"select instance_id from fx_{n}" for n in ("rel", "exec", "plan", "sess", "set", "ext", "dbtemp"))
PARTS["counted"] = f"""
select instance_id, weight, (detector not in {_INFO}
 and not (detector = 'table_bloat' and metric <= 20)
 and not (detector = 'dead_tuples' and metric <= 10)) as counted
from findings"""
PARTS["scores"] = """
select i.instance_id, cast(coalesce(sum(case when counted then 1 else 0 end),0) as bigint)
   as total_findings,
 cast(coalesce(sum(weight),0) as bigint) as penalty,
 cast(greatest(0, 100 - coalesce(sum(weight),0)) as int) as health_score
from instances i left join counted c on c.instance_id = i.instance_id group by 1"""
PARTS["detector_names"] = """
select * from (values ('bloat','table_bloat'),('bloat','disabled_autovacuum'),
 ('bloat','dead_tuples'),('config','work_mem'),('config','work_mem_evaluation'),
 ('config','shared_buffers'),('config','shared_buffers_evaluation'),
 ('config','pg_stat_max_evaluation'),('config','pg_stat_limit'),('config','slow_query_logging'),
 ('health','partitioning_candidates'),('health','idle_in_transaction'),
 ('indexes','missing_partial'),('indexes','missing_indexes'),('indexes','duplicate_indexes'),
 ('indexes','unused_indexes'),('indexes','covering_candidates'),('indexes','obsolete_stats'),
 ('indexes','wildcard_searches'),('queries','pg_stat_statements'),('queries','temp_spills'),
 ('queries','seq_scans'),('queries','top_time_queries'),('queries','db_temp_usage'),
 ('queries','explain_spills')) v(category, detector)"""

_CARD = f"{_SAMPLE} as query_sample, calls, cast(total_exec_time as double) as total_exec_time"
_MEANC = f"{rounded(MEAN)} as mean_exec_time"

# Columns of the profiled tables, with their width (None: by the text itself).
PROFILED = {
    "lineitem": {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4,
                 "l_quantity": 8, "l_extendedprice": 8, "l_discount": 8, "l_tax": 8,
                 "l_returnflag": None, "l_linestatus": None, "l_shipdate": 8},
    "orders": {"o_orderkey": 8, "o_custkey": 8, "o_orderstatus": None, "o_totalprice": 8,
               "o_orderdate": 8, "o_orderpriority": None},
    "customer": {"c_custkey": 8, "c_name": None, "c_nationkey": 4, "c_acctbal": 8,
                 "c_mktsegment": None},
    "labels": {"doc_id": 8, "quality": 4, "toxic": 4},
    "documents": {"doc_id": 8, "text": None, "lang": None, "source": None, "n_chars": 8},
}


def _profile(table: str, column: str, width: int | None) -> str:
    text = f"cast({column} as varchar)"
    size = f"strlen({text})" if width is None else str(width)
    return f"""
select '{table}' as table_name, '{column}' as column_name, cast(sum(n) as bigint) as n_rows,
 sum(case when value is null then n else 0 end)::double / sum(n)::double as null_frac,
 {rounded('sum(n * width)::double / sum(case when value is not null then n end)::double', 4)}
   as avg_width,
 count(value) as n_distinct,
 (list(value order by n desc, value) filter (where value is not null))[1] as mcv1,
 max(n) filter (where value is not null)::double / sum(n)::double as mcf1
from (select {text} as value, case when {column} is not null then {size} end as width,
 count(*) as n from {table} group by 1, 2)"""


QUERIES = {
    "d01_missing_partial": "select * from partial_missing",
    "d02_fk_without_index": "select * exclude (has_index) from fk_described where has_index = 'no'",
    "d03_fk_index_coverage": "select * from fk_described",
    "d04_duplicate_indexes": "select * exclude (names) from duplicates",
    "d05_duplicate_strict": """
select r.instance_id, r.relname as table_name,
 string_agg(distinct i.index_name, ', ' order by i.index_name) as duplicate_indexes,
 concat_ws(' ', i.key1, i.key2) as column_ids, count(*) as count
from fx_idx i join fx_rel r on r.relid = i.relid
group by r.instance_id, r.relname, i.relid, i.key1, i.key2, i.indpred having count(*) > 1""",
    "d06_unused_indexes": "select * from unused",
    "c01_counter_changes": """
select instance_id, relid, index_name, cast(captured_at as date) as captured_at,
 cast(previous_at as date) as previous_at, idx_scan, idx_tup_read, idx_tup_fetch, size_bytes,
 was_reset, exact from idx_changes""",
    "d06_unused_over_captures": f"""
select r.instance_id, r.relname as table_name, i.index_name, i.scans as idx_scan,
 {pretty('i.size_bytes')} as size, i.size_bytes
from (select instance_id, relid, index_name, cast(sum(idx_scan) as bigint) as scans,
  arg_max(size_bytes, captured_at) as size_bytes, max(captured_at) as last from idx_changes
  group by 1, 2, 3 having bool_and(exact) and sum(idx_scan) = 0 and sum(idx_tup_read) = 0
  and sum(idx_tup_fetch) = 0) i
 join fx_rel r on r.relid = i.relid and r.instance_id = i.instance_id
where i.index_name not like '%_pkey' and r.{USER}
 and last = (select max(captured_at) from idx_times t where t.instance_id = i.instance_id)""",
    "d16_top_time_over_captures": f"""
select instance_id, 'Statement with a high total time' as title, 'MEDIUM' as severity, {_CARD},
 {_MEANC}, rows_out as rows
from (select *, {TOP.format(by='total_exec_time')} from (
  select instance_id, query, cast(sum(calls) as bigint) as calls, sum(total_exec_time) as total_exec_time,
   cast(sum(rows_out) as bigint) as rows_out from stmt_changes group by 1, 2)
  where calls > 0 and total_exec_time >= 100)
where rn <= 5 and instance_id in (select instance_id from tracked)""",
    "d07_unused_by_scan": f"""
select r.instance_id, r.schema_name, r.relname as table_name, i.index_name,
 i.idx_scan as total_scans, {pretty('i.size_bytes')} as index_size, i.size_bytes
from fx_idx i join fx_rel r on r.relid = i.relid
where i.idx_scan = 0 and r.relname not like 'pg_%' and r.{USER}""",
    "d08_covering_candidates": f"""
select instance_id, left(query,200) as query_sample, calls as total_executions,
 cast(total_exec_time as double) as total_time_ms, {rounded(MEAN)} as avg_time_ms,
 temp_blks_written as temp_blocks, {HIT} as cache_hit_pct from covering""",
    "d09_stale_stats": "select * from stale",
    "d10_leading_wildcard": f"""
select instance_id, left(query,250) as query_sample, calls as total_executions,
 cast(total_exec_time as double) as total_time_ms, {rounded(MEAN)} as avg_ms,
 {WILD_KIND} as anti_pattern_type, {WILD_SEVERITY} as severity from wildcards""",
    "d11_table_bloat": "select * from bloat",
    "d12_autovacuum_disabled": """
select instance_id, relname, reloptions from fx_rel
where reloptions like '%autovacuum_enabled=false%'""",
    "d13_dead_tuples": f"""
select instance_id, schema_name as schemaname, relname as table_name, n_live_tup, n_dead_tup,
 {DEAD} as dead_tuple_pct, {BAND} as band from fx_rel where {USER}""",
    "d14_statement_stats_enabled": "select * from enabled",
    "d15_temp_spills": f"""
select instance_id, 'Temporary files in use' as title, {spill('temp_mb')} as severity, temp_mb,
 {_CARD}, {_MEANC}, cast(null as bigint) as temp_blks_read, temp_blks_written from spills
union all
select instance_id, 'Statement statistics are not enabled', 'LOW', null, null, null, null, null,
 null, null from enabled where not enabled""",
    "d16_top_time": f"""
select instance_id, 'Statement with a high total time' as title, 'MEDIUM' as severity, {_CARD},
 {_MEANC}, rows_out as rows from top_time""",
    "d17_db_temp_usage": "select * from db_temp",
    "d18_explain_sort_spill": f"""
select instance_id, 'Sort on disk in the plan' as title, 'HIGH' as severity, {_CARD}, {_MEANC},
 rows_out as rows from top_selects where sort_on_disk""",
    "d19_explain_hash_batches": f"""
select instance_id, 'Hash in batches in the plan' as title, 'HIGH' as severity, {_CARD}, {_MEANC},
 rows_out as rows, batches as max_batches from top_selects where batches > 1""",
    "d20_seq_scan": """
select instance_id, concat('Sequential scan of ', scanned, ' by statement ', queryid) as title,
 scanned as table_name, left(query,200) as query, calls from scans""",
    "d18_sort_spill_by_id": f"""
select instance_id, 'Sort on disk in the plan' as title, 'HIGH' as severity, {_CARD}, {_MEANC},
 rows_out as rows from id_top where sort_on_disk""",
    "d19_hash_batches_by_id": f"""
select instance_id, 'Hash in batches in the plan' as title, 'HIGH' as severity, {_CARD}, {_MEANC},
 rows_out as rows, batches as max_batches from id_top where batches > 1""",
    "d20_seq_scan_by_id": """
select instance_id, concat('Sequential scan of ', scanned, ' by statement ', md5(query)) as title,
 scanned as table_name, left(query,200) as query, calls from id_scans""",
    "d21_top_statements": f"""
select instance_id, md5(query) as queryid, query, calls,
 cast(total_exec_time as double) as total_time
from (select *, {TOP.format(by='total_exec_time')} from fx_stmt
 where query not like 'SELECT pg_%' and query not like 'EXPLAIN %') where rn <= 20""",
    "d22_memory_settings": """
select instance_id, name, setting, unit from fx_set where name in ('work_mem','shared_buffers')""",
    "d23_setting_to_mb": """
select instance_id, name, setting, unit, value_mb from settings
where name in ('work_mem','shared_buffers')""",
    "d24_work_mem_low": """
select instance_id, name, setting, unit, value_mb, 'MEDIUM' as severity from settings
where name = 'work_mem' and value_mb < 16""",
    "d25_shared_buffers_low": """
select instance_id, name, setting, unit, value_mb, 'MEDIUM' as severity from settings
where name = 'shared_buffers' and value_mb < 256""",
    "d26_statement_max_low": """
select instance_id, name, setting, 'MEDIUM' as severity from settings
where name = 'pg_stat_statements.max' and limit_value < 1000""",
    "d27_statement_limit": """
select instance_id, name, setting, case when limit_value < 500 then 'MEDIUM' else 'LOW' end
 as severity from settings
where name = 'pg_stat_statements.max' and limit_value < 1000
 and instance_id in (select instance_id from tracked)""",
    "d28_slow_log_disabled": """
select instance_id, name, setting, 'MEDIUM' as severity from fx_set
where name = 'log_min_duration_statement' and setting = '-1'""",
    "d30_long_sessions": "select * from long_sessions",
    "p01_column_profile": "\nunion all".join(
        _profile(t, c, w) for t, columns in PROFILED.items() for c, w in columns.items()),
    "p01_approx_exact_fields": "\nunion all".join(
        f"\nselect column_name, n_rows, null_frac, avg_width from ({_profile('orders', c, w)})"
        for c, w in PROFILED["orders"].items()),
    "p02_statement_rollup": """
select * replace (cast(total_exec_time as double) as total_exec_time) from fx_stmt""",
    "p02_statement_rollup_all_literals": f"""
select * replace (cast(total_exec_time as double) as total_exec_time) from
 (select instance_id, {CANONICAL} as query, {STMT_COLUMNS} {SAMPLE_ID} from fx_exec group by 1,2)""",
    "p02_statement_lexer": """
select instance_id, concat(case event_id % 9 // 3
  when 0 then 'SELECT id, "col 1" FROM t' when 1 then 'INSERT INTO t' else 'SELECT count(*) FROM t' end,
  instance_id % 5, case event_id % 9 // 3
  when 0 then ' WHERE note = $1' when 1 then ' VALUES ($1)'
  else ' WHERE a - $1 IN ($1) OR a <= $1' end) as query, count(*) as calls
from (select user_id as instance_id, event_id from events) group by 1, 2""",
    "p03_pretty_size": f"""
select relid, size_bytes, {pretty('size_bytes')} as as_bytes,
 {pretty('size_bytes*n_dead_tup')} as as_product, {pretty('n_dead_tup')} as as_small from fx_rel""",
    "p04_retention_audit": """
select 'orders' as table_name, count(*) as n_rows, cast(min(o_orderdate) as date) as oldest,
 cast(max(o_orderdate) as date) as newest,
 count(*) filter (where o_orderdate < (select max(o_orderdate) from orders) - interval 730 days)
   as rows_past_limit,
 avg(case when o_orderdate < (select max(o_orderdate) from orders) - interval 730 days
   then 1.0 else 0.0 end)::double as share_past_limit from orders
union all
select 'events', count(*), cast(min(ts) as date), cast(max(ts) as date),
 count(*) filter (where ts < (select max(ts) from events) - interval 14 days),
 count(*) filter (where ts < (select max(ts) from events) - interval 14 days)::double / count(*)
from events""",
    "r01_findings": f"select {_F} from findings",
    "r02_evidence_text": "select instance_id, detector, object_name, evidence from findings",
    "r03_fix_sql_text": "select instance_id, detector, object_name, sql_fix from findings",
    "r04_category_counts": """
select instance_id, category, detector, count(*) as findings from findings group by 1,2,3
union all
select instance_id, category, null, count(*) from findings group by 1,2""",
    "r05_total_findings": "select instance_id, total_findings from scores",
    "r06_health_score": "select instance_id, penalty, health_score from scores",
    "r07_score_label": """
select instance_id, health_score, case when health_score >= 80 then 'Healthy'
 when health_score >= 60 then 'Acceptable' when health_score >= 40 then 'Needs attention'
 else 'Critical' end as label from scores""",
    "r08_severity_map": """
select instance_id, case when severity in ('HIGH','CRITICAL') then 'high'
 when severity in ('MEDIUM','WARNING') then 'medium' when severity = 'LOW' then 'low'
 else 'ok' end as severity_level, count(*) as findings from findings group by 1,2""",
    "r09_detector_status": f"""
select i.instance_id, d.category, d.detector,
 case when d.detector in {_INFO} then 'ok'
  when d.detector = 'dead_tuples' then case when max(f.metric) > 0 then 'warning' else 'ok' end
  when count(f.detector) > 0 then 'warning' else 'ok' end as status,
 count(f.detector) as findings
from instances i cross join detector_names d left join findings f
 on f.instance_id = i.instance_id and f.detector = d.detector group by 1,2,3""",
    "r09_isolated_audit": f"""
select i.instance_id, d.category, d.detector,
 case when d.detector in ('db_temp_usage', 'disabled_autovacuum', 'table_bloat') then 'error'
  when d.detector in {_INFO} then 'ok'
  when d.detector = 'dead_tuples' then case when max(f.metric) > 0 then 'warning' else 'ok' end
  when count(f.detector) > 0 then 'warning' else 'ok' end as status,
 count(f.detector) as findings
from instances i cross join detector_names d left join findings f
 on f.instance_id = i.instance_id and f.detector = d.detector
 and f.detector not in ('db_temp_usage', 'disabled_autovacuum', 'table_bloat') group by 1,2,3""",
    "r10_report_contents": """
select i.instance_id, d.detector, count(f.detector) as stated, count(f.detector) as listed,
 count(distinct f.object_name) as objects
from instances i cross join detector_names d left join findings f
 on f.instance_id = i.instance_id and f.detector = d.detector group by 1,2""",
    "s03_plan_log": "select instance_id, plan_id, cast(1 as int) as line_no, line from fx_plan",
    "s06_report_sink": "select instance_id, category, detector, object_name, sql_fix from findings",
    "w01_count_by_key": "select o_custkey, count(*) as n from orders group by 1",
    "w02_filtered_count": """
select count(*) as n from part where p_brand = 'Brand#13' and p_size > 10""",
    "w03_sum_sorted": """
select l_orderkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total
from lineitem group by 1 order by 2 desc, 1""",
    "w04_full_sort": """
select o_orderkey, o_totalprice, cast(o_orderdate as date) as o_orderdate from orders
order by o_totalprice desc, o_orderdate, o_orderkey""",
    "w05_join_sorted": """
select o_orderkey, c_name, o_totalprice from orders join customer on c_custkey = o_custkey
order by o_totalprice desc, o_orderkey""",
    "w06_contains_count": "\nunion all ".join(
        f"select '{t}' as term, count(*) filter (where contains(text, '{t}')) as n from documents"
        for t in fx.SEARCH_TERMS),
    "w07_missing_child": """
select o_orderkey from orders left join lineitem on l_orderkey = o_orderkey
where l_orderkey is null""",
    "w07_not_in": """
select o_orderkey from orders where o_orderkey not in
 (select l_orderkey from lineitem where l_orderkey is not null)""",
    "w08_lateral_expand": """
select o_orderkey, cast(n as int) as n from orders
cross join lateral (select unnest(generate_series(1, 1 + o_orderkey % 5)) as n)""",
    "w09_random_subset": """
select o_orderkey, o_custkey from orders
order by md5(concat('7:', cast(o_orderkey as varchar))), o_orderkey limit 300""",
    "w09_random_delete": """
select o_orderkey, o_custkey from orders where o_orderkey not in (select o_orderkey from orders
 order by md5(concat('7:', cast(o_orderkey as varchar))), o_orderkey limit 300)""",
    "w10_json_merge": """
select event_id, cast(json_merge_patch(props, json_object('iteration', event_id % 5)) as varchar)
 as merged from events""",
    "w10_json_merge_mixed": """
select c_custkey, case when c_custkey % 7 <> 0 then concat('{"page":"/p/', c_custkey, '","old":{"a":[',
 c_custkey, ',"x",null]},"ratio":', c_custkey, '.25,"none":null,"iteration":', c_custkey % 5, '}') end
 as merged from customer""",
    "w11_derived_columns": """
select p_partkey, concat('SKU-', lpad(cast(p_partkey as varchar), 6, '0')) as sku,
 concat('Product ', p_partkey, ' - ',
  ['Premium','Standard','Economy','Deluxe','Basic'][1 + p_partkey % 5]) as name,
 concat(repeat(concat(p_name, '. '), 3), case when p_partkey % 50 = 0 then 'SPECIAL EDITION ITEM'
  else '' end) as description,
 md5(cast(p_partkey as varchar)) as token,
 date '1960-01-01' + cast(p_partkey % 20000 as int) as made_on,
 cast(cast(p_retailprice as decimal(10,2)) as double) as price, p_partkey % 20 <> 0 as is_active,
 case when p_retailprice < 950 then 'low' when p_retailprice < 1050 then 'middle' else 'high' end
  as price_band from part""",
}
# Streams give out what the watermark has passed: newest row in milliseconds, less the delay.
QUERIES["t01_stream_statement_rollup"] = f"""
select * replace (cast(total_exec_time as double) as total_exec_time)
from (select cast(ts as date) as window_start, cast(ts as date) + 1 as window_end,
 instance_id, {OPERANDS} as query, {STMT_COLUMNS} from fx_exec group by 1,2,3,4)
where epoch_ms(cast(window_end as timestamp)) <= (select epoch_ms(max(ts)) - 3600000 from events)"""
QUERIES["t02_stream_long_sessions"] = """
select instance_id, pid as session_pid, state as session_state, change_us as since_us
from (select *, lead(change_us) over (partition by instance_id, pid order by change_us, state, usename)
   as next_us, (select (epoch_ms(max(state_change)) - 600000) * 1000 from fx_sess
) as mark_us
 from (select *, epoch_us(state_change) as change_us from fx_sess))
where usename = 'app' and state in ('active','idle in transaction')
 and least(coalesce(next_us, mark_us), mark_us) - change_us > 60000000"""
for _name, _condition in (("d29_partition_candidates", CANDIDATE),
                          ("d29_partition_candidates_any", CANDIDATE_ANY)):
    QUERIES[_name] = f"""
select instance_id, schema_name as schemaname, relname as table_name,
 {pretty('size_bytes')} as total_table_size, {SIZE_MB} as size_mb,
 n_tup_ins as total_inserts_history, n_tup_del as total_deletes_history,
 {DELETES} as delete_ratio_pct, {REASONS} as reasons, size_bytes from fx_rel where {_condition}"""


def _needed(text: str, found: list[str]) -> None:
    for name in PARTS:
        if name not in found and re.search(rf"\b(from|join)\s+{name}\b", text):
            _needed(PARTS[name], found)
            if name not in found:
                found.append(name)


def compose(text: str) -> str:
    """A query with the subqueries it needs, in order."""
    found: list[str] = []
    _needed(text, found)
    if not found:
        return text.strip()
    parts = ",\n".join(f"{name} as ({PARTS[name].strip()})" for name in found)
    return f"with {parts}\n{text.strip()}"


def all_texts() -> dict[str, str]:
    return {name: compose(text) for name, text in QUERIES.items()}
