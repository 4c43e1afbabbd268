"""Counts, score, status and the nested report over findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scope_of, spread
from ..session import brief_shuffles, new_folder, stored
from .catalog import BY_NAME, CATEGORIES, DETECTORS, INFORMATIONAL, PASSES
from .findings import (
    FINDING_COLUMNS, Relations, all_findings, available, is_counted,
)

# Lower bounds of the score labels, best first (fixed values).
SCORE_LABELS = ((80, "Healthy"), (60, "Acceptable"), (40, "Needs attention"))
LOWEST_LABEL = "Critical"


def instance_rows(relations: Relations) -> DataFrame:
    """Every audited instance once: those given, or all that any relation names."""
    if "instances" in relations:
        return relations["instances"].select(*scope_of(relations["instances"])).distinct()
    named = [df for df in relations.values() if "instance_id" in df.columns]
    width = max(len(scope_of(df)) for df in named)
    # Made distinct in every relation first: a log adds one row per instance and task.
    return reduce(lambda a, b: a.unionByName(b), [
        df.select(*scope_of(df)).distinct() for df in named if len(scope_of(df)) == width
    ]).distinct()


def severity_level(severity: Column) -> Column:
    """The four display levels; unknown or missing counts as OK."""
    upper = F.upper(severity)
    return (
        F.when(upper.isin("HIGH", "CRITICAL"), F.lit("high"))
        .when(upper.isin("MEDIUM", "WARNING"), F.lit("medium"))
        .when(upper == "LOW", F.lit("low"))
        .otherwise(F.lit("ok"))
    )


def score_label(score: Column) -> Column:
    label = F.lit(LOWEST_LABEL)
    for bound, name in reversed(SCORE_LABELS):
        label = F.when(score >= bound, F.lit(name)).otherwise(label)
    return label


def category_counts(findings: DataFrame) -> DataFrame:
    """Findings per detector and per category (detector null) of each instance.

    Counted once per detector first; the category totals are sums over those
    few rows.
    """
    scope = scope_of(findings)
    per_detector = findings.groupBy(*scope, "category", "detector").agg(F.count("*").alias("n"))
    keys = [*scope, "category", "detector"]
    return (
        per_detector.groupingSets([keys, keys[:-1]], *keys)
        .agg(F.sum("n").alias("findings"))
    )


def _scored(findings: DataFrame, instances: DataFrame, *more: Column) -> DataFrame:
    """What every finding counts and weighs; instances enter as rows of weight zero, so no
    join is needed to keep those without findings."""
    scope = scope_of(findings)
    counted = is_counted(F.col("detector"), F.col("metric"))
    scored = findings.select(*scope, counted.cast("int").alias("counted"), "weight", *more)
    idle = instances.select(*scope, F.lit(0).alias("counted"), F.lit(0).alias("weight"))
    return scored.unionByName(idle, allowMissingColumns=True)


def _sums() -> list[Column]:
    return [F.sum("counted").alias("total_findings"), F.sum("weight").alias("penalty")]


def _labelled(summed: DataFrame) -> DataFrame:
    score = F.greatest(F.lit(0), 100 - F.col("penalty"))
    return summed.withColumn("health_score", score.cast("int")).withColumn(
        "label", score_label(F.col("health_score"))
    )


def totals(findings: DataFrame, instances: DataFrame) -> DataFrame:
    """Total findings and penalty per instance, zero where there is none.

    An instance with very many findings is summed by every task.
    """
    return _scored(findings, instances).groupBy(*scope_of(findings)).agg(*_sums())


def health_scores(findings: DataFrame, instances: DataFrame) -> DataFrame:
    """100 less the penalties, never below 0, with its label."""
    return _labelled(totals(findings, instances))


def fleet_scores(relations: Relations, **options) -> DataFrame:
    """Scores straight from the relations: only counted findings, no texts."""
    lean = all_findings(relations, columns=("detector", "metric", "weight"), counted_only=True,
                        **options)
    return health_scores(lean, instance_rows(relations))


def detector_status(
    findings: DataFrame, instances: DataFrame, usable: Sequence[str],
    unread: DataFrame | None = None,
) -> DataFrame:
    """Every detector of every instance: ok, warning or error, and its count.

    A detector without its input is in error with no findings and no penalty. So is one
    of an instance whose relation could not be read (`unread`: instance_id, relation).
    `instances` are counted, so they should be stored. Ids are few bytes, so that a task would
    take very many; they are spread by the rows they become.
    """
    scope = scope_of(findings)
    detector, metric = F.col("detector"), F.col("metric")
    alarming = (
        F.when(detector.isin(*INFORMATIONAL), F.lit(False))
        .when(detector == "dead_tuples", metric > 0)
        .otherwise(F.lit(True))
    )
    found = findings.select(
        *scope, "detector", F.lit(1).alias("n"), alarming.alias("warn"), F.lit(False).alias("lost")
    )
    names = F.array(*[F.lit(d.name) for d in DETECTORS])
    spaced = spread(instances.select(*scope), instances.count() * len(DETECTORS), *scope)
    listed = spaced.distinct().select(
        *scope, F.explode(names).alias("detector"), F.lit(0).alias("n"), F.lit(False).alias("warn"),
        F.lit(False).alias("lost")
    )
    rows = found.unionByName(listed)
    if unread is not None:
        rows = rows.unionByName(_lost_detectors(unread), allowMissingColumns=True)
    summed = rows.groupBy(*scope, "detector").agg(
        F.sum("n").alias("findings"), F.bool_or("warn").alias("warn"), F.bool_or("lost").alias("lost")
    )
    category = F.lit(None).cast("string")
    for d in DETECTORS:
        category = F.when(detector == d.name, F.lit(d.category)).otherwise(category)
    status = (
        F.when(~detector.isin(*usable) | F.col("lost"), F.lit("error"))
        .when(F.col("warn"), F.lit("warning"))
        .otherwise(F.lit("ok"))
    )
    return summed.select(*scope, category.alias("category"), "detector",
                         status.alias("status"), "findings")


def _lost_detectors(unread: DataFrame) -> DataFrame:
    """The detectors that need a relation which could not be read of an instance."""
    needs = F.array(*[F.struct(F.lit(d.name).alias("detector"), F.lit(name).alias("needed"))
                      for d in DETECTORS for name in d.inputs])
    needing = F.filter(needs, lambda n: n["needed"] == F.col("relation"))
    return unread.select("instance_id", F.explode(needing["detector"]).alias("detector"),
                         F.lit(0).alias("n"), F.lit(False).alias("warn"), F.lit(True).alias("lost"))


def audit_status(relations: Relations, **options) -> DataFrame:
    findings = all_findings(relations, columns=("detector", "metric"), **options)
    instances = stored(instance_rows(relations), "instances")
    return detector_status(findings, instances, available(relations))


def stored_findings(relations: Relations, **options) -> DataFrame:
    """All findings, written to the shared folder pass by pass and read back.

    The shuffle files of a pass go before the next pass begins: a report that moves its
    findings then needs disk for them and for one pass, not for the joins of all passes.
    """
    given, parts = set(available(relations)), []
    for together in PASSES:
        if names := given.intersection(together):
            found = all_findings(relations, only=names, **options)
            spark = found.sparkSession
            path = f"{new_folder(spark, 'findings')}/rows"
            with brief_shuffles(spark):
                found.write.option("compression", "zstd").parquet(path)
            parts.append(spark.read.schema(found.schema).parquet(path))
    if not parts:
        raise ValueError("no relation to audit")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def nested_report(findings: DataFrame, instances: DataFrame) -> DataFrame:
    """The report of each instance as JSON: score, totals, findings by category and detector.

    One document per instance holds all of its findings, as a finding list of any
    length is one value of the report. Findings are read once and moved once, to
    their instance; rows without an instance have a score and no lists.
    """
    scope = scope_of(findings)
    item_columns = [c for c in FINDING_COLUMNS if c not in ("category", "detector")]
    items = F.struct(*item_columns).alias("item")
    rows = _scored(findings, instances, F.col("detector"), items).repartition(*scope)
    lists = rows.groupBy(*scope, "detector").agg(
        *_sums(), F.array_sort(F.collect_list("item")).alias("items"))
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*scope, "detector")])
    full = _labelled(lists.groupBy(*scope).agg(
        F.sum("total_findings").alias("total_findings"), F.sum("penalty").alias("penalty"),
        F.map_from_entries(F.collect_list(F.when(named, F.struct("detector", "items")))).alias("lists")))

    def detector_entry(name: str) -> Column:
        empty = F.from_json(F.lit("[]"), lists.schema["items"].dataType)
        data = F.coalesce(F.try_element_at("lists", F.lit(name)), empty)
        return F.struct(
            F.lit(BY_NAME[name].label).alias("label"),
            F.size(data).cast("bigint").alias("count"),
            data.alias("data"),
        ).alias(name)

    categories = F.struct(*[
        F.struct(
            F.lit(label).alias("label"),
            F.struct(*[detector_entry(d.name) for d in DETECTORS if d.category == key])
            .alias("detectors"),
        ).alias(key)
        for key, label in CATEGORIES.items()
    ])
    report = F.struct("health_score", "label", "total_findings", categories.alias("categories"))
    return full.select(*scope, F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))
