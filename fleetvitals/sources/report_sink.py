"""Writing findings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_findings(
    findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options: str
) -> None:
    """Findings by category, straight from the tasks that found them.

    No shuffle comes before the write, so a category with most findings is
    written by all tasks. A later report reads the files instead of auditing again.
    """
    findings.write.format(fmt).mode(mode).options(**options).partitionBy("category").save(path)


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per line."""
    reports.select("report").write.mode(mode).text(path)
