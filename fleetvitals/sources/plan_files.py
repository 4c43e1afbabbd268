"""Captured execution plans: a log of many plans per file, or one small file for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import conform

# Where a plan file says whose plan it is.
FILE_PATTERN = r"instance=(\d+)/plan=(\d+)\.txt"
# How a plan shown with its statement's id says so.
QUERY_IDENTIFIER = r"(?m)^\s*Query Identifier:\s*(-?\d+)\s*$"
# Folders of a plan log.
LOG_PARTS = 16


def read_plan_files(spark: SparkSession, folder: str, query_ids: bool = False) -> DataFrame:
    """One row per plan line from ``instance=<id>/plan=<id>.txt`` files.

    `query_ids` adds ``queryid`` from the plan's line ``Query Identifier: …``, null without one.

    A file is one short text, read whole so that its lines keep their numbers; a file
    whose path names no plan stops the read. For many plans use the plan log.
    """
    files = (spark.read.format("text").option("wholetext", True)
             .option("recursiveFileLookup", True).load(folder))
    path = F.col("_metadata.file_path")
    unnamed = F.raise_error(F.concat(F.lit("no instance and plan in "), path)).cast("bigint")
    own = [F.coalesce(F.regexp_extract(path, FILE_PATTERN, i).try_cast("bigint"), unnamed)
           for i in (1, 2)]
    named = F.regexp_extract("value", QUERY_IDENTIFIER, 1).try_cast("bigint").alias("queryid")
    lines = files.select(
        own[0].alias("instance_id"), own[1].alias("plan_id"), *([named] if query_ids else []),
        F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"),
    )
    return conform("plan", lines.where(F.col("line") != "").withColumn(
        "line_no", F.col("line_no") + 1))


def write_plan_log(plan: DataFrame, folder: str, mode: str = "append") -> None:
    """Plans as lines ``instance_id<TAB>plan_id<TAB>line_no<TAB>text``, many instances to a file.

    Where the relation has ``queryid``, the second field is ``plan_id:queryid``. Instances
    are dealt to LOG_PARTS folders, so a task writes that many files at most, however large
    the fleet is.
    """
    own = ["plan_id", "queryid"] if "queryid" in plan.columns else ["plan_id"]
    named = F.concat_ws(":", *[F.col(c).cast("string") for c in own])
    instance = F.coalesce(F.col("instance_id").cast("string"), F.lit(""))
    line = F.concat_ws("\t", instance, named, F.col("line_no").cast("string"),
                       F.coalesce("line", F.lit("")))
    part = F.pmod("instance_id", F.lit(LOG_PARTS)).alias("part")
    plan.select(part, line.alias("value")).write.mode(mode).partitionBy("part").text(folder)


def read_plan_log(spark: SparkSession, folder: str, query_ids: bool = False) -> DataFrame:
    """The lines of a plan log. Files are split between tasks.

    `query_ids` adds ``queryid``, null where a line has none.
    """
    lines = spark.read.schema("value string, part int").text(folder)
    parts = F.split("value", "\t", 4)
    own = F.split(parts[1], ":", 2)
    named = [F.get(own, F.lit(1)).try_cast("bigint").alias("queryid")] if query_ids else []
    return conform("plan", lines.select(
        F.nullif(parts[0], F.lit("")).cast("bigint").alias("instance_id"),
        own[0].cast("bigint").alias("plan_id"), *named, parts[2].cast("int").alias("line_no"),
        parts[3].alias("line")))
