"""Cumulative counters of several captures to what happened between them.

A server's counters only grow until somebody resets them, at a time no single capture
tells. Differences between the captures of one object need no such time: where a counter
falls, or the stated time of the reset changes, it began anew, and what it shows now is the
least that happened. Rules then run on the activity of a stated span instead of totals
since an unknown day.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indexes import unused_indexes

# What names an object of a relation inside its instance, and which columns only grow.
OBJECTS: dict[str, tuple[str, ...]] = {
    "rel": ("relid",), "idx": ("relid", "index_name"), "stmt": ("query",), "dbtemp": ("datname",),
}
COUNTERS: dict[str, tuple[str, ...]] = {
    "rel": ("n_tup_ins", "n_tup_del"),
    "idx": ("idx_scan", "idx_tup_read", "idx_tup_fetch"),
    "stmt": ("calls", "total_exec_time", "rows_out", "temp_blks_read", "temp_blks_written",
             "shared_blks_hit", "shared_blks_read"),
    "dbtemp": ("temp_files", "temp_bytes"),
}
# Relations whose objects may leave a capture without being dropped: the server forgets
# rare statements. What they did stays part of the activity.
FORGETFUL = ("stmt",)


def _home(df: DataFrame) -> list[str]:
    return [c for c in ("instance_id",) if c in df.columns]


def _object_keys(df: DataFrame, name: str) -> list[str]:
    own = [c for c in ("queryid",) if name == "stmt" and c in df.columns]
    return [*_home(df), *own, *OBJECTS[name]]


def _counters(df: DataFrame, name: str) -> list[str]:
    return [c for c in COUNTERS[name] if c in df.columns]


def _one_row_each(captures: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """One row per object and capture: of repeated rows the one with the largest counters.

    Rows need to lie together by object only, so those that a join has left so need no move.
    """
    others = [c for c in captures.columns if c not in (*keys, "captured_at", *counters)]
    order = [F.col(c).desc_nulls_last() for c in (*counters, *others)]
    in_time = Window.partitionBy(*keys).orderBy("captured_at", *order)
    again = F.lag("captured_at").over(in_time).eqNullSafe(F.col("captured_at"))
    return (captures.where("captured_at is not null")
            .withColumn("_again", again).where(~F.col("_again")).drop("_again"))


def _with_previous(captures: DataFrame, name: str) -> DataFrame:
    """Every object's rows with the change of each counter since the object's row before.

    Adds _before (that row's time), _fell and change_<counter>. One exchange, by object,
    serves the removal of repeats and the differences.
    """
    keys, counters = _object_keys(captures, name), _counters(captures, name)
    rows = _one_row_each(captures, keys, counters)
    in_time = Window.partitionBy(*keys).orderBy("captured_at")
    before = {c: F.lag(F.coalesce(F.col(c), F.lit(0))).over(in_time) for c in counters}
    rows = rows.withColumns({"_before": F.lag("captured_at").over(in_time),
                             **{f"_was_{c}": v for c, v in before.items()}})
    fell = F.lit(False)
    for c in counters:
        fell |= F.coalesce(F.coalesce(F.col(c), F.lit(0)) < F.col(f"_was_{c}"), F.lit(False))
    if "stats_reset" in rows.columns:
        stated = F.lag("stats_reset").over(in_time)
        rows = rows.withColumn("_stated", F.col("_before").isNotNull()
                               & ~F.col("stats_reset").eqNullSafe(stated))
        fell |= F.col("_stated")
    rows = rows.withColumn("_fell", fell)
    # An object that began anew, or was not there before, did at least what it shows.
    changes = {f"change_{c}": F.coalesce(F.col(c), F.lit(0)) - F.when(
        F.col("_fell"), F.lit(0)).otherwise(F.coalesce(F.col(f"_was_{c}"), F.lit(0)))
        for c in counters}
    return rows.withColumns(changes).drop("_stated", *[f"_was_{c}" for c in counters])


def _spans(rows: DataFrame) -> DataFrame:
    """Every capture of an instance: the one before, the first, the last, the last one until
    then at which a counter of the instance had fallen.

    A row per instance and capture, whatever the number of objects.
    """
    home = _home(rows)
    each = rows.groupBy(*home, "captured_at").agg(F.max(F.col("_fell").cast("int")).alias("_fallen"))
    whole = Window.partitionBy(*(home or [F.lit(0)]))
    in_time = whole.orderBy("captured_at")
    return each.select(
        *home, "captured_at", F.lag("captured_at").over(in_time).alias("previous_at"),
        F.min("captured_at").over(whole).alias("first_at"),
        F.max("captured_at").over(whole).alias("last_at"),
        F.max(F.when(F.col("_fallen") == 1, F.col("captured_at"))).over(in_time).alias("fell_at"))


def _with_spans(rows: DataFrame, spans: DataFrame, at: str, **taken: str) -> DataFrame:
    """`rows` with columns of the capture that their column `at` names; null is a value of ids.

    Captures are few beside rows: they are hashed, and the rows need no sort.
    """
    left, right = rows.alias("r"), spans.alias("s")
    same = F.col(f"r.{at}") == F.col("s.captured_at")
    for c in _home(rows):
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    return left.join(right.hint("shuffle_hash"), same, "left").select(
        "r.*", *[F.col(f"s.{source}").alias(name) for name, source in taken.items()])


def _typed(rows: DataFrame, captures: DataFrame, name: str) -> DataFrame:
    """`rows` with every counter replaced by its change."""
    return rows.withColumns({c: F.col(f"change_{c}").cast(captures.schema[c].dataType)
                             for c in _counters(captures, name)})


def _is_exact(since: str) -> Column:
    """Whether no counter of the instance fell after `since` until the capture joined."""
    return F.coalesce(F.col("_fell_at") <= F.col(since), F.lit(True))


def counter_changes(captures: DataFrame, name: str) -> DataFrame:
    """What every object did between two captures of its instance.

    `captures` is the relation `name` (rel, idx, stmt or dbtemp) with captured_at. One row per
    object and capture but for an instance's first, which nothing precedes: the columns of
    the relation with every counter replaced by its change, and previous_at (the object's row
    before; for a new object the instance's capture before), was_reset (this object's
    counters began anew) and exact. Changes are exact where no counter of the instance fell
    from previous_at on; otherwise they are the least that happened, since counts between
    the earlier capture and the reset are lost.

    Null counters are 0, of repeated rows of one capture the one with the largest counters
    stands, rows without captured_at are left out, null keys are keys like others. An empty
    relation gives an empty result. A relation without instance_id is one instance.
    """
    rows = _with_previous(captures, name)
    rows = _with_spans(rows, _spans(rows), "captured_at", _previous="previous_at",
                       _first="first_at", _fell_at="fell_at").where("captured_at > _first")
    changes = _typed(rows, captures, name).withColumns({
        "previous_at": F.coalesce("_before", "_previous"), "was_reset": F.col("_fell")})
    return changes.withColumn("exact", _is_exact("previous_at")).select(
        *captures.columns, "previous_at", "was_reset", "exact")


def activity(captures: DataFrame, name: str) -> DataFrame:
    """The relation with its counters replaced by what happened from first to last capture.

    Other columns are those of the object's last capture; captured_at gives way to
    observed_from, observed_to, resets (of this object) and exact (as in `counter_changes`, for
    every capture between). Restrict `captures` by captured_at for another span. Objects that
    an instance's last capture lacks are gone and left out, but for statements, which the
    server only forgets; statements without a call are left out. An instance with a
    single capture has no activity that is known, and no row.
    """
    counters, keys = _counters(captures, name), _object_keys(captures, name)
    rows = _with_previous(captures, name)
    spans = _spans(rows)
    # Objects are summed up where their rows lie; one row of each meets the captures.
    whole = Window.partitionBy(*keys)
    later, in_time = F.col("_before").isNotNull(), whole.orderBy("captured_at")
    sums = {f"_sum_{c}": F.sum(F.when(later, F.col(c))).over(whole) for c in counters}
    firsts = {f"_new_{c}": F.max(F.when(~later, F.col(c))).over(whole) for c in counters}
    found = _typed(rows, captures, name).withColumns({
        **sums, **firsts, "_begun": F.min("captured_at").over(whole),
        "resets": F.sum(F.col("_fell").cast("bigint")).over(whole),
        "_next": F.lead("captured_at").over(in_time)}).where("_next is null")
    found = _with_spans(found, spans, "captured_at", _first="first_at", _last="last_at",
                        _fell_at="fell_at").where("captured_at > _first")
    found = _with_spans(found, spans, "_begun", _previous="previous_at")
    # What an object shows at the instance's first capture was before it.
    known = F.coalesce("_previous", "_begun")
    new = F.col("_begun") > F.col("_first")
    totals = {c: (F.coalesce(f"_sum_{c}", F.lit(0))
                  + F.when(new, F.col(f"_new_{c}")).otherwise(F.lit(0))
                  ).cast(captures.schema[c].dataType) for c in counters}
    found = found.withColumns({**totals, "observed_from": known}).withColumn(
        "exact", _is_exact("observed_from"))
    if name not in FORGETFUL:
        found = found.where("captured_at = _last")
    elif "calls" in counters:
        found = found.where("calls > 0")
    kept = [c for c in captures.columns if c not in ("captured_at", "stats_reset")]
    return found.select(*kept, "observed_from", F.col("captured_at").alias("observed_to"),
                        "resets", "exact")


def latest(captures: DataFrame) -> DataFrame:
    """The rows of each instance's last capture, without captured_at."""
    home = _home(captures)
    last = captures.groupBy(*home).agg(F.max("captured_at").alias("captured_at"))
    rows = _with_spans(captures, last, "captured_at", _found="captured_at")
    return rows.where("_found is not null").drop("_found", "captured_at")


def activity_of_relations(relations: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Relations of several captures as one that rules and the audit take: counters as
    `activity`, all others as `latest`; relations without captured_at stay as they are."""
    found = {}
    for name, df in relations.items():
        if "captured_at" not in df.columns or name in ("exec", "plan", "sess"):
            found[name] = df
        else:
            found[name] = activity(df, name) if name in COUNTERS else latest(df)
    return found


def unused_over_captures(idx: DataFrame, rel: DataFrame) -> DataFrame:
    """Indexes that nothing scanned, read or fetched from over captures that miss no count.

    `idx` has captured_at, `rel` the tables of now. Other than `unused_indexes` this neither
    spares an index that was last used before the first capture, nor names one whose
    counters may have been reset in between.
    """
    return unused_indexes(activity(idx, "idx").where("exact"), rel)
