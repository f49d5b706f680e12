"""Saved jobs and templates as portable records, their stores, run states and notifications."""

from __future__ import annotations

import fcntl
import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.pipeline import StepError, TransformStep, import_steps
from gleanery.sources.scan import Field

SCHEMA_VERSION = 1
# What a field can read, and the states of a run.
ATTRIBUTES = ("text", "html", "href", "src", "alt", "attr", "structured", "position")
STATUSES = ("idle", "preparing", "running", "waiting", "stopping", "stopped", "paused", "completed", "error")


class ImportFailed(ValueError):
    """A record from outside that cannot be used, and why."""


@dataclass(frozen=True)
class Job:
    """What to scan, how to clean it and how to compare runs."""

    name: str
    container: str | None = None
    fields: tuple[Field, ...] = ()
    steps: tuple[TransformStep, ...] = ()
    hostname: str | None = None
    pathname: str | None = None
    compare_key: str = "entire-row"
    interval_minutes: int | None = None
    notify: bool = True
    description: str = ""


def export_job(job: Job) -> str:
    """Portable JSON: schema version, name, description, container and columns. Cleaning steps stay behind."""
    return json.dumps({"schemaVersion": SCHEMA_VERSION, "name": job.name, "description": job.description, "containerSelector": job.container, "columns": [asdict(f) for f in job.fields]}, indent=2, ensure_ascii=False)


def import_job(text: str) -> Job:
    """A job out of untrusted JSON: known keys only; ImportFailed says what is wrong or too large. Nothing is cut off."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ImportFailed(f"not JSON: {e}") from e
    if not isinstance(raw, dict):
        raise ImportFailed("not a single object")
    version = raw.get("schemaVersion", 1)
    if not isinstance(version, (int, float)) or isinstance(version, bool) or version > SCHEMA_VERSION:
        raise ImportFailed(f"made by a later version ({version})")

    def word(v, most: int = 200) -> str | None:
        if isinstance(v, str) and len(v) > most:
            raise ImportFailed(f"a text of {len(v)} characters, more than {most}")
        return v if isinstance(v, str) and v.strip() else None

    if not word(raw.get("name")):
        raise ImportFailed("no name")
    fields = []
    if isinstance(raw.get("columns"), list) and len(raw["columns"]) > 100:
        raise ImportFailed(f"{len(raw['columns'])} columns, more than 100")
    for c in raw["columns"] if isinstance(raw.get("columns"), list) else []:
        if isinstance(c, dict) and word(c.get("name")) and c.get("attribute", "text") in ATTRIBUTES:
            fields.append(Field(word(c["name"]), word(c.get("selector") or c.get("relativeSelector"), 2000), c.get("attribute", "text"), word(c.get("attribute_name") or c.get("attributeName")), word(c.get("path") or c.get("structuredPath"), 500), c.get("multiple") is True))
    if not fields:
        raise ImportFailed("no usable columns")
    try:
        steps = tuple(import_steps(raw.get("transforms")))
    except StepError as e:
        raise ImportFailed(str(e)) from e
    return Job(word(raw["name"]), word(raw.get("containerSelector"), 2000), tuple(fields), steps, description=word(raw.get("description"), 2000) or "")


def matches_page(jobs: DataFrame, hostname: str, pathname: str) -> DataFrame:
    return jobs.filter((F.col("hostname") == hostname) & (F.col("pathname") == pathname))


class Store:
    """Small records by key, one JSON file on the driver: configuration, not data."""

    def __init__(self, path: str):
        self.path = Path(path)

    def all(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def get(self, key: str, default=None):
        return self.all().get(key, default)

    def set(self, key: str, value) -> None:
        self._change(lambda records: {**records, key: value})

    def remove(self, key: str) -> None:
        self._change(lambda records: {k: v for k, v in records.items() if k != key})

    def _change(self, change) -> None:
        """Read, change and write under a lock, so that no other writer's change is lost."""
        with open(self.path.with_suffix(".lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            self._write(change(self.all()))

    def _write(self, records: dict) -> None:
        new = self.path.with_suffix(".new")
        new.write_text(json.dumps(records, ensure_ascii=False))
        new.replace(self.path)


@dataclass(frozen=True)
class RunState:
    """Where a run stands. Rows and keys are in its sink; pausing and stopping keep them."""

    run_id: str
    status: str = "idle"
    stop_reason: str | None = None
    error: str | None = None
    progress: dict = field(default_factory=dict)

    def to(self, status: str, stop_reason: str | None = None, error: str | None = None) -> RunState:
        return replace(self, status=status, stop_reason=stop_reason or self.stop_reason, error=error or self.error) if status in STATUSES else self

    def pause(self) -> RunState:
        return replace(self, status="paused", stop_reason="user")

    def resume(self) -> RunState:
        """Goes on from a stop or pause; any other state stays."""
        return replace(self, status="running", stop_reason=None, error=None) if self.status in ("stopped", "paused") else self


def notifications(runs: DataFrame) -> DataFrame:
    """Runs worth a message, of (name, notify, status, new_count, removed_count, changed_count, error): changes or an error."""
    changes = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("removed_count", "changed_count")), F.coalesce(F.col("new_count"), F.lit(0)))
    failed: Column = F.col("status") == "error"
    said = F.when(failed, F.coalesce("error", F.lit("run failed"))).otherwise(F.concat_ws(", ", *(F.when(F.col(f"{k}_count") > 0, F.concat(F.col(f"{k}_count").cast("string"), F.lit(f" {k}"))) for k in ("new", "removed", "changed"))))
    return runs.filter(F.coalesce("notify", F.lit(True)) & (failed | (changes > 0))).select("name", failed.alias("is_error"), said.alias("message"))
