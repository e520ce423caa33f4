"""Export, staging-table and log sinks.

Every sink writes to a folder of its own beside the target, counts what it finds there, and then renames it: a reader sees
all rows of a write or none, and a job that dies leaves nothing in the target. What is written under a run's name is
written once; writing it again changes nothing. File systems whose rename is not atomic (object stores) need a committer
that makes it so.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from dataclasses import dataclass
from typing import Callable, Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from plumbrule.spec import staging_type

# Identifier limits of a materialized staging table.
MAX_IDENTIFIER = 63
RUN_SUFFIX = 12
NAME_SEPARATOR = "__"


class SinkError(ValueError):
    """A sink refused its target."""


def resolve_target(reference: str, base: str) -> str:
    """A relative target below ``base``; anything that would leave it is refused."""
    if not reference or not reference.strip():
        raise SinkError("the target must not be blank")
    if reference.startswith("/") or "://" in reference:
        raise SinkError("the target must be relative to the export folder")
    flat = posixpath.normpath(reference)
    if flat in (".", "..") or flat.startswith("../"):
        raise SinkError("the target leaves the export folder")
    return base.rstrip("/") + "/" + flat


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = _fs(spark, path)
    return fs.exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    target, fs = _fs(spark, path)
    fs.delete(target, True)


def swap(spark: SparkSession, source: str, path: str) -> None:
    """Put ``source`` at ``path``; what was there before is deleted last and comes back if the new one cannot take its place."""
    target, fs = _fs(spark, path)
    old = _fs(spark, f"{path.rstrip('/')}__old-{uuid.uuid4().hex}")[0]
    there = fs.exists(target)
    if there and not fs.rename(target, old):
        raise SinkError(f"could not move the old copy at {path}")
    if not fs.rename(_fs(spark, source)[0], target):
        if there:
            fs.rename(old, target)
        raise SinkError(f"could not publish {path}")
    if there:
        fs.delete(old, True)


def _pending(path: str) -> str:
    """A folder beside ``path`` that readers of a partitioned table pass over."""
    folder, name = posixpath.split(path.rstrip("/"))
    return f"{folder}/_pending-{name.replace('=', '-')}-{uuid.uuid4().hex}"


def _written(rows: DataFrame, pending: str, write: Callable[[DataFrame, str], None], read: Callable[[str], DataFrame]) -> int:
    """Write to the pending folder and check it against the rows that went in."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows")), pending)
    found, expected = read(pending).count(), seen.get["rows"]
    if found != expected:
        raise SinkError(f"wrote {found} of {expected} rows")
    return found


def _export(rows: DataFrame, path: str, overwrite: bool, write: Callable[[DataFrame, str], None]) -> int:
    spark = rows.sparkSession
    if path_exists(spark, path) and not overwrite:
        raise SinkError(f"{path} exists and overwrite was not requested")
    pending = _pending(path)
    try:
        count = _written(rows, pending, write, spark.read.text)
        swap(spark, pending, path)
    except BaseException:
        delete_path(spark, pending)
        raise
    return count


def export_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> int:
    """Write one JSON object per row with keys in name order; returns the count read back."""
    ordered = rows.select(*sorted(rows.columns))
    return _export(ordered, path, overwrite, lambda df, at: df.write.option("ignoreNullFields", "false").json(at))


def export_snapshots(snapshots: DataFrame, path: str, overwrite: bool = False, column: str = "row_snapshot") -> int:
    """Write ready-made JSON texts, one per line; returns the count read back."""
    return _export(snapshots.select(F.col(column).alias("value")), path, overwrite, lambda df, at: df.write.text(at))


@dataclass(frozen=True)
class Commit:
    """How many rows a target holds, and whether this write put them there."""

    rows: int
    is_new: bool


def commit_once(rows: DataFrame, target: str) -> Commit:
    """Write ``rows`` to a folder that is written once. Of two writers at a time one wins, and both see its rows."""
    spark = rows.sparkSession
    if path_exists(spark, target):
        return Commit(spark.read.parquet(target).count(), False)
    pending = _pending(target)
    try:
        count = _written(rows, pending, lambda df, at: df.write.parquet(at), spark.read.parquet)
        goal, fs = _fs(spark, target)
        fs.mkdirs(goal.getParent())
        # A rename onto a folder that came up meanwhile would move into it.
        won = not fs.exists(goal) and fs.rename(_fs(spark, pending)[0], goal)
    except BaseException:
        delete_path(spark, pending)
        raise
    if not won:
        delete_path(spark, pending)
        if not path_exists(spark, target):
            raise SinkError(f"could not commit {target}")
        return Commit(spark.read.parquet(target).count(), False)
    return Commit(count, True)


class RunTable:
    """A table that grows by runs (validation results, log batches): one folder per run, each committed once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, run_id: str) -> Commit:
        if not run_id:
            raise SinkError("a run needs an id")
        return commit_once(rows, f"{self.path}/run_id={quote(run_id, safe='')}")

    def read(self, schema: T.StructType) -> DataFrame:
        """All committed runs with their ``run_id``."""
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])).parquet(self.path)


def clean_identifier(raw: str) -> str:
    """Lower-case letters, digits and single underscores, never starting with a digit."""
    words = re.findall(r"[a-z0-9]+", raw.strip().lower())
    name = "_".join(words) or "dataset"
    return f"t_{name}" if name[0].isdigit() else name


def staging_table_name(dataset: str, run_id: str) -> str:
    """A name that is unique per run and short enough for any database."""
    suffix = run_id.replace("-", "")[:RUN_SUFFIX]
    room = MAX_IDENTIFIER - len(NAME_SEPARATOR) - len(suffix)
    return (clean_identifier(dataset)[:room].rstrip("_") or "dataset") + NAME_SEPARATOR + suffix


def write_staging_table(rows: DataFrame, base: str, dataset: str, run_id: str) -> tuple[str, Commit]:
    """Write a run's rows, in staging types, as a table of its own below ``base``; returns its path."""
    path = f"{base.rstrip('/')}/{staging_table_name(dataset, run_id)}"
    typed = rows.select(*[F.col(f"`{f.name}`").cast(staging_type(f.dataType)).alias(f.name) for f in rows.schema.fields])
    return path, commit_once(typed, path)


def audit_events(
    spark: SparkSession, actor: str, action: str, entity_type: str, entity_id: str,
    before: Mapping[str, str] | None = None, after: Mapping[str, str] | None = None,
    metadata: Mapping[str, str] | None = None, actor_type: str = "USER",
) -> DataFrame:
    """One audit event. Values describe states and counts; raw cell values do not belong here."""
    row = [(actor, actor_type, action, entity_type, entity_id, dict(before or {}), dict(after or {}),
            dict(metadata or {}))]
    return spark.createDataFrame(
        row, "actor string, actor_type string, action string, entity_type string, entity_id string, "
             "before map<string,string>, after map<string,string>, metadata map<string,string>"
    ).withColumn("created_at", F.current_timestamp())


def append_log(events: DataFrame, path: str, batch_id: str | None = None) -> Commit:
    """Append a batch of events. A batch with an id is appended once, however often a job is run again."""
    return RunTable(events.sparkSession, path).write(events, batch_id or uuid.uuid4().hex)
