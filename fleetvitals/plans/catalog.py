"""The detectors of a full audit: where they belong, what they read, what they cost."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Detector:
    name: str
    category: str
    label: str
    inputs: tuple[str, ...]
    weight: int = 0
    informational: bool = False


# Category keys in report order, with their labels.
CATEGORIES = {
    "bloat": "Bloat and maintenance",
    "config": "Configuration",
    "health": "General health",
    "indexes": "Index audit",
    "queries": "Problem statements",
}

# Names and weights of the audit (fixed values). A weight is the penalty of one
# finding; spills take theirs from SPILL_WEIGHTS.
DETECTORS = (
    Detector("table_bloat", "bloat", "Table bloat", ("col", "rel"), 5),
    Detector("disabled_autovacuum", "bloat", "Autovacuum disabled", ("rel",), 10),
    Detector("dead_tuples", "bloat", "Dead rows", ("rel",), 5),
    Detector("work_mem", "config", "Current work_mem", ("setting",), informational=True),
    Detector("work_mem_evaluation", "config", "Low work_mem", ("setting",), 8),
    Detector("shared_buffers", "config", "Current shared_buffers", ("setting",),
             informational=True),
    Detector("shared_buffers_evaluation", "config", "Low shared_buffers", ("setting",), 8),
    Detector("pg_stat_max_evaluation", "config", "Low pg_stat_statements.max", ("setting",), 5),
    Detector("pg_stat_limit", "config", "Statement tracking limit", ("setting", "ext"), 3),
    Detector("slow_query_logging", "config", "Slow statement logging", ("setting",), 5),
    Detector("partitioning_candidates", "health", "Partitioning candidates", ("rel",), 2),
    Detector("idle_in_transaction", "health", "Long sessions", ("sess",), 10),
    Detector("missing_partial", "indexes", "Missing partial indexes", ("col", "rel", "idx"), 3),
    Detector("missing_indexes", "indexes", "Foreign keys without index", ("fk", "idx", "rel"), 6),
    Detector("duplicate_indexes", "indexes", "Duplicate indexes", ("idx", "rel"), 4),
    Detector("unused_indexes", "indexes", "Unused indexes", ("idx", "rel"), 3),
    Detector("covering_candidates", "indexes", "Covering index candidates", ("stmt",), 2),
    Detector("obsolete_stats", "indexes", "Stale statistics", ("rel",), 5),
    Detector("wildcard_searches", "indexes", "Leading wildcard searches", ("stmt",), 3),
    Detector("pg_stat_statements", "queries", "Statement statistics", ("ext",),
             informational=True),
    Detector("temp_spills", "queries", "Temporary file spills", ("stmt", "ext")),
    Detector("seq_scans", "queries", "Sequential scans", ("stmt", "plan", "exec"), 4),
    Detector("top_time_queries", "queries", "Slowest statements", ("stmt", "ext"), 4),
    Detector("db_temp_usage", "queries", "Database temporary files", ("dbtemp",), 5),
    Detector("explain_spills", "queries", "Spills in plans", ("stmt", "ext", "plan", "exec"), 6),
)

# Detectors that one pass over their input serves together; the others have a pass each.
_SHARED = (
    ("obsolete_stats", "disabled_autovacuum", "dead_tuples", "partitioning_candidates"),
    ("work_mem", "work_mem_evaluation", "shared_buffers", "shared_buffers_evaluation",
     "pg_stat_max_evaluation", "pg_stat_limit", "slow_query_logging"),
    ("top_time_queries", "covering_candidates", "wildcard_searches", "temp_spills",
     "pg_stat_statements", "seq_scans", "explain_spills"),
)
PASSES = _SHARED + tuple(
    (d.name,) for d in DETECTORS if not any(d.name in together for together in _SHARED))

SPILL_WEIGHTS = {"HIGH": 8, "MEDIUM": 5, "LOW": 0}
# Findings of these two count only above a limit on their metric, in percent.
COUNTED_ABOVE = {"table_bloat": 20, "dead_tuples": 10}

BY_NAME = {d.name: d for d in DETECTORS}
INFORMATIONAL = tuple(d.name for d in DETECTORS if d.informational)
