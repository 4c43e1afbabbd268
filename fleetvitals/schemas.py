"""The telemetry relations the operators accept, and their check on entry.

Every relation may also carry ``captured_at TIMESTAMP`` when several captures
are kept; operators then treat each (instance, capture) on its own. Relations
below an instance's tables (`col`, `idx`, `fk`) may carry ``instance_id``; where
they do not, ``relid`` must be unique over the fleet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_B, _S, _I, _D, _F = T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TS = T.TimestampNTZType()
_MONEY = T.DecimalType(28, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


RELATIONS: dict[str, T.StructType] = {
    "rel": _schema(
        instance_id=_B, relid=_B, schema_name=_S, relname=_S, relkind=_S, relispartition=_F,
        reltuples=_B, n_live_tup=_B, n_dead_tup=_B, n_tup_ins=_B, n_tup_del=_B, size_bytes=_B,
        relpages=_B, toastpages=_B, toasttuples=_B, reloptions=_S,
    ),
    "col": _schema(
        relid=_B, attnum=_I, attname=_S, null_frac=_D, avg_width=_B, mcf1=_D, mcv1=_S,
        n_distinct=_D, has_stats=_F,
    ),
    "idx": _schema(
        index_name=_S, relid=_B, key1=_I, key2=_I, indpred=_S, idx_scan=_B, idx_tup_read=_B,
        idx_tup_fetch=_B, size_bytes=_B,
    ),
    "fk": _schema(constraint_name=_S, relid=_B, attnum=_I, ref_relid=_B),
    "exec": _schema(
        instance_id=_B, exec_id=_B, ts=_TS, exec_ms=_D, sql_text=_S, rows_out=_B,
        temp_blks_written=_B, shared_blks_hit=_B, shared_blks_read=_B,
    ),
    "stmt": _schema(
        instance_id=_B, query=_S, calls=_B, total_exec_time=_MONEY, rows_out=_B,
        temp_blks_written=_B, shared_blks_hit=_B, shared_blks_read=_B,
        has_wildcard=_F, has_ilike=_F,
    ),
    "plan": _schema(instance_id=_B, plan_id=_B, line_no=_I, line=_S),
    "sess": _schema(instance_id=_B, pid=_B, state_change=_TS, state=_S, usename=_S),
    "setting": _schema(instance_id=_B, name=_S, setting=_S, unit=_S),
    "ext": _schema(instance_id=_B, extname=_S),
    "dbtemp": _schema(instance_id=_B, datname=_S, temp_files=_B, temp_bytes=_B),
}

# Columns a capture may leave out, with the value taken then.
OPTIONAL = {
    "idx": {"key2": None, "indpred": None},
    "plan": {"line_no": 1},
    "setting": {"unit": None},
    "exec": {"rows_out": 0, "temp_blks_written": 0, "shared_blks_hit": 0, "shared_blks_read": 0},
}


class RelationError(ValueError):
    """A relation lacks a column or holds a type that cannot be widened."""


def _family(kind: T.DataType) -> str:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(kind, T.NumericType):
        return "number"
    return kind.typeName()


def conform(name: str, df: DataFrame) -> DataFrame:
    """Check a relation against its schema and return it with the agreed types.

    Narrower numbers are widened; a column of another family is an error, as is
    a missing column that has no default. Further columns (scope, key lists,
    operator classes) pass through.
    """
    wanted = RELATIONS[name]
    if dict(df.dtypes).get("reloptions") == "array<string>":
        df = df.withColumn("reloptions", F.array_join("reloptions", " "))
    present = {field.name: field.dataType for field in df.schema}
    defaults = OPTIONAL.get(name, {})
    if name == "idx" and "indkey" in present:
        defaults = {**defaults, "key1": None}
    changed, problems = {}, []
    for field in wanted:
        kind = field.dataType.simpleString()
        if field.name not in present:
            if field.name in defaults:
                value = "null" if defaults[field.name] is None else str(defaults[field.name])
                changed[field.name] = f"cast({value} as {kind})"
            else:
                problems.append(f"{field.name} is missing")
        elif _family(present[field.name]) != _family(field.dataType):
            problems.append(
                f"{field.name} is {present[field.name].simpleString()}, not {kind}")
        elif present[field.name] != field.dataType and not isinstance(
            field.dataType, (T.TimestampNTZType, T.DecimalType)
        ):
            changed[field.name] = f"cast({field.name} as {kind})"
    if problems:
        raise RelationError(f"relation {name}: " + "; ".join(problems))
    if not changed:
        return df
    kept = [c for c in df.columns if c not in changed]
    return df.selectExpr(*[f"`{c}`" for c in kept], *[f"{v} as {k}" for k, v in changed.items()])
