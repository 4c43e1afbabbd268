"""Every rule's rows under one findings schema, with evidence and suggested SQL."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    fixed, grouped, is_user_object, pretty_size, query_id, quoted, scope_of, spill_severity,
)
from ..operators import bloat, config, health, indexes, plans, statements
from .catalog import BY_NAME, COUNTED_ABOVE, DETECTORS, INFORMATIONAL, SPILL_WEIGHTS

FINDING_COLUMNS = (
    "category", "detector", "severity", "object_name", "title", "evidence", "recommendation",
    "sql_fix", "metric", "weight",
)
Relations = Mapping[str, DataFrame]
# Characters of a statement that its findings show; the object is the statement's id.
SAMPLE_CHARS = 300


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


TEXT_COLUMNS = ("title", "evidence", "recommendation", "sql_fix")


def is_counted(detector: Column, metric: Column) -> Column:
    """Whether a finding enters the total: not informational, and above its detector's limit."""
    counted = ~detector.isin(*INFORMATIONAL)
    for name, limit in COUNTED_ABOVE.items():
        counted = counted & ~((detector == name) & (metric <= limit))
    return counted


Field = Column | str | Callable[[], Column]


@dataclass(frozen=True)
class Card:
    """How rows of an input become findings of one detector.

    Fields given as functions are built only when a step asks for them.
    """

    detector: str
    title: Field
    severity: Field
    object_name: Field
    evidence: Field
    recommendation: Field
    sql_fix: Field
    metric: Callable[[], Column]
    condition: Callable[[], Column] | None = None
    weight: Callable[[], Column] | None = None

    def counted(self) -> Column | None:
        """When a row enters the total; None means always."""
        if BY_NAME[self.detector].informational:
            return F.lit(False)
        if self.detector in COUNTED_ABOVE:
            return self.metric() > COUNTED_ABOVE[self.detector]
        return None

    def matches(self, counted_only: bool) -> Column:
        parts = [] if self.condition is None else [self.condition()]
        counted = self.counted() if counted_only else None
        if counted is not None:
            parts.append(counted)
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def _weight(self) -> Column:
        weight = F.lit(BY_NAME[self.detector].weight) if self.weight is None else self.weight()
        counted = self.counted()
        return weight if counted is None else F.when(counted, weight).otherwise(F.lit(0))

    def _field(self, name: str) -> Column:
        if name == "category":
            return F.lit(BY_NAME[self.detector].category)
        if name == "detector":
            return F.lit(self.detector)
        if name == "metric":
            return self.metric().cast("double")
        if name == "weight":
            return self._weight()
        value = getattr(self, name)
        value = value() if callable(value) else value
        return F.lit(value) if isinstance(value, str) else value

    def fields(self, columns: Sequence[str]) -> list[Column]:
        return [self._field(name).alias(name) for name in columns]


def emit(
    df: DataFrame, cards: Sequence[Card], columns: Sequence[str], counted_only: bool
) -> DataFrame:
    """The findings of all cards from one pass over their input."""
    scope = scope_of(df)
    if len(cards) == 1:
        card = cards[0]
        return df.where(card.matches(counted_only)).select(*scope, *card.fields(columns))
    made = [F.when(c.matches(counted_only), F.struct(*c.fields(columns))) for c in cards]
    return df.select(*scope, F.inline(F.array_compact(F.array(*made))))


# Cards by input. Each list holds what one pass over that input can report.


def _col(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _no_metric() -> Column:
    return F.lit(None)


def _measured_tables(rel: DataFrame) -> DataFrame:
    """Tables with the measures several cards and fields share, computed once per row."""
    return rel.withColumns({
        "divergence_ratio": indexes.divergence_ratio(),
        "dead_tuple_pct": bloat.dead_tuple_pct(),
        "table_name": text(F.col("schema_name"), ".", F.col("relname")),
    })


def _table_cards(partition_mode: str) -> list[Card]:
    table, dead, ratio = F.col("table_name"), F.col("dead_tuple_pct"), F.col("divergence_ratio")

    def by_dead(alarming: str, elevated: str, other: str) -> Column:
        return (F.when(dead > bloat.DEAD_ALARMING_PCT, F.lit(alarming))
                .when(dead > bloat.DEAD_ELEVATED_PCT, F.lit(elevated)).otherwise(F.lit(other)))

    return [
        Card(
            "obsolete_stats", "Stale planner statistics",
            lambda: indexes.stale_severity(ratio), table,
            lambda: text(
                "Table ", table, ": the planner expects ", grouped(F.col("reltuples")),
                " rows, the collector counts ", grouped(F.col("n_live_tup")), ", ",
                fixed(F.coalesce(ratio, F.lit(0.0)), 1), " times apart."),
            "Refresh the statistics; raise the column targets if the gap returns.",
            lambda: text("ANALYZE ", table, ";"),
            lambda: ratio, lambda: indexes.has_stale_statistics(ratio),
        ),
        Card(
            "disabled_autovacuum", "Autovacuum disabled on a table", "HIGH", _col("relname"),
            lambda: text("Table ", F.col("relname"), " switches autovacuum off in its options: ",
                         F.col("reloptions"), "."),
            "Let autovacuum run on this table again.",
            lambda: text("ALTER TABLE ", F.col("relname"), " RESET (autovacuum_enabled);"),
            _no_metric, bloat.autovacuum_is_off,
        ),
        Card(
            "dead_tuples", "Dead rows", lambda: by_dead("HIGH", "MEDIUM", "OK"), table,
            lambda: text("Table ", table, " holds ", fixed(dead), "% dead rows (",
                         grouped(F.col("n_dead_tup")), ")."),
            lambda: text("State: ", bloat.dead_tuple_band(dead)),
            lambda: text(by_dead("VACUUM FULL ANALYZE ", "VACUUM ANALYZE ", "VACUUM ANALYZE "),
                         table, ";"),
            lambda: dead, is_user_object,
        ),
        Card(
            "partitioning_candidates", "Table to partition", "MEDIUM", table,
            lambda: text("Table ", table, " (", pretty_size(F.col("size_bytes")), ") ",
                         health.partition_reasons(), "."),
            "Split the table by a date range and drop old partitions.",
            lambda: text("CREATE TABLE ", table, "_partitioned (LIKE ", table,
                         " INCLUDING ALL) PARTITION BY RANGE (created_at);"),
            health.size_mb, lambda: health.is_partition_candidate(partition_mode),
        ),
    ]


def _bloat_card() -> Card:
    table = text(F.col("schemaname"), ".", F.col("tblname"))
    pct = F.col("bloat_pct")
    limit = COUNTED_ABOVE["table_bloat"]
    return Card(
        "table_bloat", "Table bloat",
        lambda: F.when(pct > limit, F.lit("MEDIUM")).otherwise(F.lit("OK")), table,
        lambda: text("Table ", table, " is about ", fixed(pct, 1), "% bloat (",
                     grouped(F.col("bloat_size")), " bytes)."),
        "Rewrite the table in a quiet hour.", lambda: text("VACUUM FULL ", table, ";"),
        lambda: pct,
    )


def _partial_index_card() -> Card:
    table, column = F.col("table_name"), F.col("column_name")
    share = F.col("percent_occurrence")

    def value() -> Column:
        return quoted(F.col("dominant_value"))

    return Card(
        "missing_partial", "Missing partial index", "MEDIUM", lambda: text(table, ".", column),
        lambda: text("Column ", column, " of ", table, " is ", fixed(share, 1), "% the value ",
                     value(), " and no partial index leaves it out."),
        "Index only the rows without the dominant value.",
        lambda: text("CREATE INDEX CONCURRENTLY idx_", table, "_", column, "_partial ON ", table,
                     " (", column, ") WHERE ", column, " <> ", value(), ";"),
        lambda: share,
    )


def _foreign_key_card() -> Card:
    table, column, parent = F.col("table_name"), F.col("column_name"), F.col("referenced_table")
    return Card(
        "missing_indexes", "Foreign key without index", "HIGH", _col("constraint_name"),
        lambda: text("Foreign key ", F.col("constraint_name"), " on ", table, ".", column,
                     " refers to ", parent, " and leads no index."),
        "Index the referring column.",
        lambda: text("CREATE INDEX CONCURRENTLY idx_",
                     F.replace(table, F.lit("."), F.lit("_")), "_", column, "_fk ON ", table,
                     " (", column, ");"),
        _no_metric,
    )


def _drop_statements() -> Column:
    dropped = F.slice("names", F.lit(2), F.size("names"))
    return F.array_join(
        F.transform(dropped, lambda n: text("DROP INDEX CONCURRENTLY ", n, ";")), "\n")


def _duplicate_card() -> Card:
    return Card(
        "duplicate_indexes", "Duplicate indexes", "MEDIUM", _col("table_name"),
        lambda: text("Table ", F.col("table_name"), " has ", F.col("count").cast("string"),
                     " indexes on (", F.col("columns"), "): ", F.col("index_names"), "."),
        lambda: text("Keep ", F.col("keep_name"), " and drop the others."),
        _drop_statements, _col("count"),
    )


def _unused_index_card() -> Card:
    return Card(
        "unused_indexes", "Unused index", "LOW", _col("index_name"),
        lambda: text("Index ", F.col("index_name"), " on ", F.col("table_name"), " takes ",
                     F.col("size"), " and was never scanned."),
        "Drop it once its use is ruled out.",
        lambda: text("DROP INDEX CONCURRENTLY ", F.col("index_name"), ";"), _col("size_bytes"),
    )


def _setting_cards() -> list[Card]:
    name, value = F.col("name"), F.col("setting")

    def mb() -> Column:
        return fixed(config.value_mb())

    def limit() -> Column:
        return value.try_cast("int")

    def current(setting: str) -> Card:
        return Card(setting, f"Current {setting}", "OK", name,
                    lambda: text(setting, " = ", value, " ", F.coalesce("unit", F.lit(""))),
                    "For information.", "", config.value_mb, lambda: name == setting)

    return [
        current("work_mem"),
        Card("work_mem_evaluation", "Low work_mem", "MEDIUM", name,
             lambda: text("work_mem is ", mb(), " MB."),
             "Raise it with care; sorts and hashes that do not fit go to disk.",
             "ALTER SYSTEM SET work_mem = '64MB';", config.value_mb, config.work_mem_is_low),
        current("shared_buffers"),
        Card("shared_buffers_evaluation", "Low shared_buffers", "MEDIUM", name,
             lambda: text("shared_buffers is about ", mb(), " MB."),
             "Size it by the memory of the server.",
             "ALTER SYSTEM SET shared_buffers = '256MB';", config.value_mb,
             config.shared_buffers_are_low),
        Card("pg_stat_max_evaluation", "Low pg_stat_statements.max", "MEDIUM", name,
             lambda: text("pg_stat_statements.max is ", value, "."),
             "Keep more statements to see the whole workload.",
             "ALTER SYSTEM SET pg_stat_statements.max = 5000;", limit,
             config.tracking_limit_is_low),
        Card("pg_stat_limit", "Statements fall out of tracking", config.tracking_limit_severity,
             name,
             lambda: text("Tracking stops at ", value, " statements, below the advised ",
                          str(config.MIN_TRACKED_STATEMENTS), "."),
             "Raise the limit to 5000 to 10000; needs a restart.",
             "ALTER SYSTEM SET pg_stat_statements.max = 5000;", limit,
             lambda: config.tracking_limit_is_low() & F.col("tracked")),
        Card("slow_query_logging", "Slow statements are not logged", "MEDIUM", name,
             lambda: text(name, " is ", value, "."), "Log statements from 1000 ms.",
             "ALTER SYSTEM SET log_min_duration_statement = '1000ms';", _no_metric,
             config.slow_log_is_off),
    ]


def _session_card() -> Card:
    pid = F.col("session_pid").cast("string")
    return Card(
        "idle_in_transaction", "Long session", _col("severity"), pid,
        lambda: text("Session ", pid, " has been ", F.col("session_state"), " for ",
                     fixed(F.col("idle_minutes")), " minutes."),
        "End the session or set idle_in_transaction_session_timeout.",
        lambda: text("SELECT pg_terminate_backend(", pid, ");"), _col("idle_minutes"),
    )


def _extension_cards() -> list[Card]:
    enabled = F.col("enabled")
    return [
        Card("pg_stat_statements", "Statement statistics", "OK", config.TRACKING_EXTENSION,
             lambda: text("Statement statistics are ",
                          F.when(enabled, F.lit("enabled")).otherwise(F.lit("not enabled")), "."),
             "For information.", "", lambda: enabled.cast("int")),
        Card("temp_spills", "Statement statistics are not enabled", "LOW",
             config.TRACKING_EXTENSION, "The extension pg_stat_statements is missing.",
             "Enable it to see slow and spilling statements.",
             "CREATE EXTENSION IF NOT EXISTS pg_stat_statements;", _no_metric, lambda: ~enabled,
             lambda: F.lit(SPILL_WEIGHTS["LOW"])),
    ]


def _spill_weight() -> Column:
    severity, weight = spill_severity(statements.temp_mb()), F.lit(SPILL_WEIGHTS["LOW"])
    for level in ("MEDIUM", "HIGH"):
        weight = F.when(severity == level, F.lit(SPILL_WEIGHTS[level])).otherwise(weight)
    return weight


def _statement_cards() -> list[Card]:
    scanned = F.col("scanned")
    explain = "EXPLAIN (ANALYZE, BUFFERS) <statement>;"

    def statement() -> Column:
        return query_id(F.col("query"))

    def shown(*parts: Column | str) -> Column:
        """Evidence with the beginning of the statement, which the id stands for."""
        return text(*parts, " Statement: ", F.left("query", F.lit(SAMPLE_CHARS)))

    def calls() -> Column:
        return grouped(F.col("calls"))

    def mean() -> Column:
        return fixed(statements.mean_exact())

    def of(rule: statements.StatementRule) -> Column:
        return F.col("rule") == rule.name

    def explained(sign: Column) -> Column:
        return of(statements.TOP_TIME) & F.col("tracked") & plans.is_select() & sign

    return [
        Card("covering_candidates", "Covering index candidate", "LOW", statement,
             lambda: shown("Run ", calls(), " times at ", mean(), " ms each with ",
                          fixed(statements.cache_hit_pct(), 1), "% cache hits."),
             "Add the read columns to the index of the filter column.",
             "CREATE INDEX CONCURRENTLY idx_covering ON table_name (filter_column) "
             "INCLUDE (read_columns);",
             statements.cache_hit_pct, lambda: of(statements.COVERING)),
        Card("wildcard_searches", "Search with a leading wildcard", statements.wildcard_severity,
             statement,
             lambda: shown(statements.wildcard_kind(), ", run ", calls(), " times at ", mean(),
                          " ms each."),
             "Use a trigram index; ordinary indexes cannot serve this search.",
             "CREATE EXTENSION IF NOT EXISTS pg_trgm;\n"
             "CREATE INDEX CONCURRENTLY idx_trgm ON table_name USING gin (column_name gin_trgm_ops);",
             statements.mean_ms, lambda: of(statements.WILDCARD)),
        Card("temp_spills", "Temporary files in use",
             lambda: spill_severity(statements.temp_mb()), statement,
             lambda: shown("Wrote ", F.col("temp_blks_written").cast("string"),
                          " temporary blocks, about ", fixed(statements.temp_mb()), " MB."),
             "Check sorts, groupings and joins, and whether work_mem is enough.",
             explain, statements.temp_mb,
             lambda: of(statements.SPILL) & F.col("tracked")
             & (statements.temp_mb() >= statements.MIN_SPILL_MB),
             _spill_weight),
        Card("top_time_queries", "Statement with a high total time", "MEDIUM", statement,
             lambda: shown("Total ", fixed(F.col("total_exec_time")), " ms over ", calls(),
                          " calls, mean ", mean(), " ms."),
             "Study its plan.", explain, statements.total_ms,
             lambda: of(statements.TOP_TIME) & F.col("tracked")),
        Card("explain_spills", "Sort on disk in the plan", "HIGH", statement,
             lambda: shown("A captured plan sorts on disk."),
             "Check ORDER BY, GROUP BY and DISTINCT, then work_mem.", explain, _no_metric,
             lambda: explained(F.coalesce("sort_on_disk", F.lit(False)))),
        Card("explain_spills", "Hash in batches in the plan", "HIGH", statement,
             lambda: shown("A captured plan needs ", F.col("batches").cast("string"),
                          " batches for a hash."),
             "Check hash joins and groupings, then work_mem.", explain, _col("batches"),
             lambda: explained(F.coalesce("batches", F.lit(0)) > 1)),
        Card("seq_scans", "Sequential scan", "MEDIUM", statement,
             lambda: shown("Statement ", query_id(F.col("query")), " scans ", scanned,
                          " in sequence and ran ", calls(), " times."),
             lambda: text("Check whether ", scanned, " needs an index."),
             lambda: text("CREATE INDEX CONCURRENTLY idx_", scanned, "_filter ON ", scanned,
                          " (filter_column);"),
             _col("calls"), lambda: of(statements.SCANS) & scanned.isNotNull()),
    ]


def _database_card() -> Card:
    return Card(
        "db_temp_usage", "Temporary files in the database", _col("severity"), _col("datname"),
        lambda: text("Database ", F.col("datname"), " wrote ",
                     F.col("temp_files").cast("string"), " temporary files, about ",
                     fixed(F.col("temp_mb")), " MB."),
        "Check sorts, groupings and joins, and work_mem.",
        "SELECT query FROM pg_stat_statements ORDER BY temp_blks_written DESC;", _col("temp_mb"),
    )


def _with_tracking(df: DataFrame, ext: DataFrame | None) -> DataFrame:
    """Rows marked by whether their instance has statement tracking."""
    if ext is None:
        return df.withColumn("tracked", F.lit(False))
    tracked = config.tracked_instances(ext).withColumn("tracked", F.lit(True))
    joined = df.join(tracked, [c for c in scope_of(df) if c in tracked.columns], "left")
    return joined.withColumn("tracked", F.coalesce("tracked", F.lit(False)))


def available(relations: Relations) -> list[str]:
    """The detectors whose input relations are all there.

    The statement log only ties plans to statements, so it may be absent where both
    carry the server's statement ids.
    """
    given = set(relations)
    if {"stmt", "plan"} <= given and plans.share_ids(relations["stmt"], relations["plan"]):
        given.add("exec")
    return [d.name for d in DETECTORS if given.issuperset(d.inputs)]


def _statement_input(relations: Relations, names: set[str]) -> DataFrame:
    wanted = {
        "covering_candidates": (statements.COVERING,), "wildcard_searches": (statements.WILDCARD,),
        "temp_spills": (statements.SPILL,), "top_time_queries": (statements.TOP_TIME,),
        "explain_spills": (statements.TOP_TIME,), "seq_scans": (statements.SCANS,),
    }
    rules = list(dict.fromkeys(r for name, rs in wanted.items() if name in names for r in rs))
    ranked = _with_tracking(
        statements.rank_statements(relations["stmt"], rules), relations.get("ext")
    )
    if not names & {"explain_spills", "seq_scans"}:
        return ranked.withColumns({"sort_on_disk": F.lit(None).cast("boolean"),
                                   "batches": F.lit(None).cast("int"),
                                   "scanned": F.lit(None).cast("string")})
    explained = ranked.where(F.col("rule").isin(statements.TOP_TIME.name, statements.SCANS.name))
    signals = plans.statement_signals(explained, relations["plan"], relations.get("exec"))
    ranked = plans.with_statement_key(ranked, relations["plan"])
    by = [c for c in scope_of(ranked) if c in signals.columns]
    return ranked.join(signals, [*by, "statement"], "left")


def all_findings(
    relations: Relations,
    columns: Sequence[str] = FINDING_COLUMNS,
    counted_only: bool = False,
    session_user: str | None = None,
    as_of: Column | None = None,
    partition_mode: str = "all",
    instances: DataFrame | None = None,
    only: Collection[str] | None = None,
) -> DataFrame:
    """The findings of every detector whose inputs are there, or of those in `only`.

    Each input relation is read once for all the rules that need it alone.
    `columns` builds only what a later step needs, `counted_only` only what
    enters totals and score: a score over a fleet writes no evidence text.
    """
    names = set(available(relations))
    if only is not None:
        names &= set(only)
    parts: list[DataFrame] = []

    def add(df: DataFrame, cards: Sequence[Card]) -> None:
        cards = [c for c in cards if c.detector in names]
        if counted_only:
            cards = [c for c in cards if c.detector not in INFORMATIONAL]
        if cards:
            parts.append(emit(df, cards, columns, counted_only))

    def wanted(name: str, cards: Sequence[Card]) -> bool:
        return name in relations and any(c.detector in names for c in cards)

    if wanted("rel", cards := _table_cards(partition_mode)):
        add(_measured_tables(relations["rel"]), cards)
    if "table_bloat" in names:
        add(bloat.table_bloat(relations["col"], relations["rel"]), [_bloat_card()])
    if "missing_partial" in names:
        add(indexes.missing_partial_indexes(relations["col"], relations["rel"], relations["idx"]),
            [_partial_index_card()])
    # Names that only appear in texts are joined and listed only for texts.
    described = bool(set(columns) & set(TEXT_COLUMNS))
    if "missing_indexes" in names:
        inputs = [relations[n] for n in ("fk", "idx", "rel")]
        uncovered = (indexes.foreign_keys_without_index(*inputs, relations.get("col"))
                     if described else indexes.bare_foreign_keys(*inputs))
        add(uncovered, [_foreign_key_card()])
    if "duplicate_indexes" in names:
        if described:
            duplicates = indexes.duplicate_indexes(
                relations["idx"], relations["rel"], relations.get("col"))
        else:
            duplicates = indexes.duplicate_index_groups(relations["idx"], relations["rel"])
        add(duplicates, [_duplicate_card()])
    if "unused_indexes" in names:
        add(indexes.unused_indexes(relations["idx"], relations["rel"]), [_unused_index_card()])
    if wanted("setting", cards := _setting_cards()):
        audited = relations["setting"].where(F.col("name").isin(*config.AUDITED_SETTINGS))
        add(_with_tracking(audited, relations.get("ext")), cards)
    if "idle_in_transaction" in names:
        add(health.long_sessions(relations["sess"], session_user, as_of), [_session_card()])
    if wanted("ext", cards := _extension_cards()):
        if "temp_spills" not in names:
            cards = cards[:1]
        add(config.tracking_enabled(relations["ext"], instances), cards)
    if wanted("stmt", cards := _statement_cards()):
        add(_statement_input(relations, names), cards)
    if "db_temp_usage" in names:
        add(statements.database_temp_usage(relations["dbtemp"]), [_database_card()])
    if not parts:
        raise ValueError("no relation to audit")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
