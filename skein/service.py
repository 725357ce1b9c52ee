"""One object over a catalogue: what a front end calls."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import metrics
from skein.operators.catalog import Catalog, Moved, index_rows, rebuild, rebuild_entity
from skein.operators.search import Page, search
from skein.operators.tags import tag_page
from skein.operators.writes import tombstone, upsert
from skein.plans.config import Config
from skein.plans.request import Request
from skein.sources.jobs import JobLog
from skein.streaming.outbox import OutboxStream


class SearchService:
    """search, tags, status, upsert, delete, rebuild, rebuild_entity, follow and configure over one catalogue.

    ``source``: adapter rows as they are now; ``events``: the feed as it is now. Writes rewrite only the buckets of the keys
    they touch and go again if another writer came first; jobs are logged. ``timing`` holds the milliseconds of the last
    search by stage. Errors are those of the operators: QueryError, CursorError, IndexUnavailable, RebuildInProgress.
    """

    def __init__(self, spark: SparkSession, home: str, source: Callable[[], DataFrame], events: Callable[[], DataFrame], *, config: Config = Config(), secret: bytes = b"", clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), buckets: int = 16):
        self.spark, self.source, self.events, self.config, self.secret, self.clock = spark, source, events, config, secret, clock
        self.home = home.rstrip("/")
        self.catalog = Catalog(spark, f"{self.home}/index", clock, buckets=buckets)
        self.jobs = JobLog(spark, f"{self.home}/jobs")
        self.timing: dict[str, float] = {}

    def configure(self, config: Config) -> None:
        """Other settings from the next search on; cursors of the former ones are refused."""
        self.config = config

    def search(self, request: Request) -> Page:
        """One page of the active generation; the generation is read once, so items, total and facets agree."""
        began = time.perf_counter()
        g = self.catalog.active()
        opened = time.perf_counter()
        page = search(self.catalog.read(g), replace(request, scoring_time=request.scoring_time or self.clock()), generation=g["id"], config=self.config, secret=self.secret)
        self.timing = {"open_ms": (opened - began) * 1000, "search_ms": (time.perf_counter() - opened) * 1000}
        return page

    def tags(self, text: str = "", sort: str = "count", limit: int = 50, offset: int = 0) -> DataFrame:
        """A page of the tag table."""
        return tag_page(self.catalog.tags(), text, sort, limit, offset)

    def status(self) -> dict:
        """Rows by kind, the active generation, lag of the feed and the summary of the jobs: a handful of numbers."""
        g = self.catalog.active()
        jobs = metrics.job_summary(self.jobs.table()).first()
        return {
            "generation": g["id"],
            "watermark": g["watermark"],
            "documents": g["documents"],
            "by_type": {r.entity_type: r.n for r in metrics.status_counts(self.catalog.read(g)).collect()},
            "lag_seconds": metrics.feed_lag(self.events(), self.clock()).first().lag_seconds,
            "jobs": jobs.asDict() if jobs else {},
        }

    def _write(self, change: Callable[[DataFrame], tuple[DataFrame, DataFrame]], keys: DataFrame) -> DataFrame:
        while True:
            g = self.catalog.active()
            part, report = self.catalog.merge(g, keys, change)
            try:
                self.catalog.put(g["id"], part, seen=g)
                return report
            except Moved:
                continue

    def upsert(self, documents: DataFrame, *, versioned: bool = True) -> DataFrame:
        """Writes built documents (operators.documents); the report of key and applied. ``source_version`` where versioned."""
        versions = documents.select("entity_type", "entity_id", F.col("source_version").alias("version")) if versioned else None
        rows = index_rows(documents.drop("source_version"), self.clock(), versions)
        return self._write(lambda current: upsert(current, rows, self.clock(), versioned=versioned), rows.select("entity_type", "entity_id"))

    def delete(self, keys: DataFrame, *, versioned: bool = True) -> DataFrame:
        """Leaves tombstones for ``keys`` (entity_type, entity_id, source_version, reason); the report of key and applied."""
        return self._write(lambda current: tombstone(current, keys, self.clock(), versioned=versioned), keys.select("entity_type", "entity_id"))

    def rebuild(self) -> int:
        """A full rebuild beside the active generation; the new one's id."""
        with self.jobs.job("full_rebuild"):
            return rebuild(self.catalog, self.source, self.events)

    def rebuild_entity(self, entity_type: str, entity_id: str) -> DataFrame:
        """Re-reads one entity, with the feed's version of it; the report."""
        with self.jobs.job("entity_rebuild", entity_type, entity_id):
            top = self.events().where((F.btrim("entity_type") == entity_type) & (F.btrim("entity_id") == entity_id)).agg(F.max("event_order")).first()[0]
            return rebuild_entity(self.catalog, self.source(), entity_type, entity_id, top or 0)

    def follow(self, stream: DataFrame, **options):
        """Applies a stream of events from now on."""
        return OutboxStream(self.catalog, self.source, f"{self.home}/stream").start(stream, **options)
