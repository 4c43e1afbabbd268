"""A whole audit as a job: every step is written before the next one reads it.

Detectors that share a pass over their input run as one Spark job; several such groups run
at a time. A group that fails while running is run again detector by detector, so one bad
value costs the detector that trips over it and no other. Every step leaves Spark's
success marker behind; a resumed audit keeps what is marked and goes on from there. The shuffle
files of a step go when it is written, and steps are compressed well, so that the disk holds the
steps and what is being moved for the next ones.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions import scope_of
from ..operators.rollup import statement_rollup
from ..schemas import RelationError, conform
from ..session import brief_shuffles, path_exists, remove_path
from ..sources.report_sink import write_findings
from .catalog import PASSES
from .findings import FINDING_COLUMNS, Relations, all_findings, available
from .report import category_counts, detector_status, health_scores, instance_rows, nested_report

WORKERS = 4
CAPTURE_NAME = r"[\w.-]+"
WRITTEN, KEPT, FAILED = "written", "kept", "failed"
# So much of a failure is kept with its detector.
PROBLEM_CHARS = 2_000
STEP_OPTIONS = {"compression": "zstd"}


@dataclass(frozen=True)
class Outcome:
    """What became of one detector's findings."""

    detector: str
    step: str
    state: str
    problem: str | None = None


class AuditFolder:
    """The written steps of one audit: ``<folder>/<step>[/capture=<name>]``.

    With `resume`, a step that carries its success marker is kept; from the first step
    written anew on, all later ones are written as well.
    """

    def __init__(self, spark: SparkSession, folder: str, capture: str | None, resume: bool):
        if capture is not None and not re.fullmatch(CAPTURE_NAME, capture):
            raise ValueError(f"no name of a capture: {capture!r}")
        self.spark, self.resume = spark, resume
        self._folder, self._capture = folder.rstrip("/"), capture

    def path(self, step: str) -> str:
        own = "" if self._capture is None else f"/capture={self._capture}"
        return f"{self._folder}/{step}{own}"

    def is_kept(self, path: str) -> bool:
        return self.resume and path_exists(self.spark, f"{path}/_SUCCESS")

    def stored(self, step: str, df: DataFrame) -> DataFrame:
        path = self.path(step)
        if not self.is_kept(path):
            self.resume = False
            df.write.mode("overwrite").options(**STEP_OPTIONS).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def usable_relations(relations: Relations) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The relations that fit their schemas, and what is wrong with the others."""
    usable, problems = {}, {}
    for name, df in relations.items():
        try:
            usable[name] = df if name == "instances" else conform(name, df)
        except RelationError as problem:
            problems[name] = str(problem)
    return usable, problems


class _Findings:
    """The findings of one audit, a folder per step below one folder."""

    def __init__(self, folder: AuditFolder, build: Callable[[set[str]], DataFrame]):
        self.folder, self.build = folder, build
        self.path = folder.path("findings")
        self.schemas: list[StructType] = []
        self.changed = False

    def _step(self, name: str) -> str:
        return f"{self.path}/step={name}"

    def _write(self, step: str, names: Iterable[str]) -> str:
        found = self.build(set(names))
        self.schemas.append(found.schema)
        if self.folder.is_kept(self._step(step)):
            return KEPT
        self.changed = True
        write_findings(found, self._step(step), **STEP_OPTIONS)
        return WRITTEN

    def run(self, step: str, names: tuple[str, ...], job_group: str) -> list[Outcome]:
        """Write the findings of these detectors, at once or, where that fails, one by one."""
        context = self.folder.spark.sparkContext
        context.setJobGroup(job_group, f"findings of {step}", interruptOnCancel=True)
        alone = len(names) == 1
        # What an earlier run wrote one by one is not to be written once more together.
        apart = not alone and any(self.folder.is_kept(self._step(n)) for n in names)
        try:
            if not apart:
                state = self._write(step, names)
                return [Outcome(n, step, state) for n in names]
        except Exception as problem:  # noqa: BLE001 - becomes the outcome of a detector
            if context._jsc is None or context._jsc.sc().isStopped():
                raise
            if alone:
                return [Outcome(step, step, FAILED, str(problem)[:PROBLEM_CHARS])]
        return [outcome for n in names for outcome in self.run(n, (n,), job_group)]

    def read(self, scope: list[str]) -> DataFrame:
        fields = {f.name: f for schema in self.schemas for f in schema}
        columns = [*scope, *FINDING_COLUMNS]
        schema = StructType([fields[c] for c in columns if c in fields])
        if not path_exists(self.folder.spark, self.path):
            return self.folder.spark.createDataFrame([], schema)
        return self.folder.spark.read.schema(schema).parquet(self.path).select(*schema.fieldNames())


def write_all_findings(
    folder: AuditFolder, build: Callable[[set[str]], DataFrame], names: Iterable[str],
    scope: list[str], workers: int = WORKERS,
) -> tuple[DataFrame, list[Outcome]]:
    """Findings of the named detectors, written pass by pass, and what became of each.

    `build` gives the findings of a set of detectors. Up to `workers` passes run at a time,
    each under a job group of its own; an interrupt cancels them all.
    """
    findings, names = _Findings(folder, build), set(names)
    if not folder.resume:
        remove_path(folder.spark, findings.path)
    parts = [tuple(n for n in together if n in names) for together in PASSES]
    passes = [(part[0] if len(part) == 1 else f"{part[0]}-pass", part) for part in parts if part]
    run = uuid.uuid4().hex
    groups = [f"audit-{run}-{step}" for step, _ in passes]
    with ThreadPoolExecutor(workers) as pool:
        waiting = [pool.submit(findings.run, step, part, group)
                   for (step, part), group in zip(passes, groups, strict=True)]
        try:
            outcomes = [o for done in waiting for o in done.result()]
        except BaseException:
            for done, group in zip(waiting, groups, strict=True):
                done.cancel()
                folder.spark.sparkContext.cancelJobGroup(group)
            raise
    folder.resume &= not findings.changed
    return findings.read(scope), outcomes


def run_audit(
    spark: SparkSession, relations: Relations, folder: str, capture: str | None = None,
    resume: bool = False, unread: DataFrame | None = None, workers: int = WORKERS, **options,
) -> dict[str, DataFrame]:
    """Roll the log up once, find once, and report from the stored findings.

    `folder` must be one every executor can reach: a lost executor then costs
    its tasks, not the steps before. A relation that does not fit its schema puts the
    detectors that need it in error, as a failure while running does with its detector;
    neither costs a penalty, and the others go on. `unread` (instance_id, relation) are
    relations that could not be read of single servers: there, their detectors are in error.

    With `capture`, every step has a folder for that capture and leaves those of others
    alone. `resume` goes on with an audit of the same relations that was stopped: what is
    complete is kept, what failed is tried again. Returns the stored findings, scores,
    counts, statuses, documents, the problems found and the outcome of every detector.
    """
    with brief_shuffles(spark):
        return _run_audit(
            AuditFolder(spark, folder, capture, resume), relations, unread, workers, **options)


def _run_audit(
    steps: AuditFolder, relations: Relations, unread: DataFrame | None, workers: int, **options,
) -> dict[str, DataFrame]:
    spark = steps.spark
    usable, problems = usable_relations(relations)
    if "stmt" not in relations and "exec" in usable:
        usable["stmt"] = conform("stmt", steps.stored("stmt", statement_rollup(usable["exec"], "all")))
    instances = instance_rows(usable)
    if unread is not None:
        instances = instances.unionByName(
            unread.select("instance_id"), allowMissingColumns=True).distinct()
    instances = steps.stored("instances", instances)
    given = available(usable)
    found, outcomes = write_all_findings(
        steps, lambda names: all_findings(usable, instances=instances, only=names, **options),
        given, scope_of(instances), workers)
    failed = {o.detector for o in outcomes if o.state == FAILED}
    status = detector_status(found, instances, [n for n in given if n not in failed], unread)
    noted = spark.createDataFrame(sorted(problems.items()), "relation string, problem string")
    shown = spark.createDataFrame(
        sorted((o.detector, o.step, o.state, o.problem) for o in outcomes),
        "detector string, step string, state string, problem string")
    stored = {
        "findings": found,
        "scores": steps.stored("scores", health_scores(found, instances)),
        "counts": steps.stored("counts", category_counts(found)),
        "status": steps.stored("status", status),
        "documents": steps.stored("documents", nested_report(found, instances)),
    }
    steps.resume = False
    return stored | {"problems": steps.stored("problems", noted),
                     "outcomes": steps.stored("outcomes", shown)}
