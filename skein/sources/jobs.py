"""The log of jobs: what began, how it ended."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from skein.sources.manifests import ManifestLog

SCHEMA = "id bigint, job_type string, entity_type string, entity_id string, status string, message string, error string, started_at timestamp, finished_at timestamp, generation_id bigint"


class JobLog:
    """Jobs as a log of starts and ends; a job that died stays running."""

    def __init__(self, spark: SparkSession, home: str, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.spark, self.log, self.clock = spark, ManifestLog(spark, f"{home.rstrip('/')}/jobs"), clock

    def _append(self, entry: dict) -> int:
        n, _ = self.log.last()
        self.log.append(n, entry)
        return n

    @contextmanager
    def job(self, job_type: str, entity_type: str | None = None, entity_id: str | None = None, generation_id: int | None = None):
        """Logs the start, then success, or failure with the error (which goes on to the caller)."""
        id = self._append({"start": True, "job_type": job_type, "entity_type": entity_type, "entity_id": entity_id, "generation_id": generation_id, "at": self.clock().isoformat()})
        try:
            yield id
        except Exception as e:
            self._append({"end": id, "status": "failed", "error": str(e)[:1000], "at": self.clock().isoformat()})
            raise
        self._append({"end": id, "status": "success", "error": None, "at": self.clock().isoformat()})

    def table(self) -> DataFrame:
        """One row per job, in the shape of index_sync_log."""
        rows, ends = [], {}
        for n, e in enumerate(self.log.all()):
            if "end" in e:
                ends[e["end"]] = e
            else:
                rows.append((n, e))
        at = lambda e: datetime.fromisoformat(e["at"]) if e else None
        out = [(n, e["job_type"], e["entity_type"], e["entity_id"], (x := ends.get(n) or {}).get("status", "running"), "done" if x.get("status") == "success" else "", x.get("error"), at(e), at(x), e["generation_id"]) for n, e in rows]
        return self.spark.createDataFrame(out, SCHEMA)
