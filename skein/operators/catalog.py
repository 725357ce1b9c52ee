"""Index generations as immutable Parquet snapshots behind one atomic switch."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce
from operator import and_
from threading import Event, Thread

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.terms import folded
from skein.operators.documents import build_documents
from skein.operators.metrics import validate_generation
from skein.operators.tags import tag_index
from skein.operators.view import searchable
from skein.operators.writes import tombstone, upsert
from skein.session import materialize
from skein.sources.manifests import ManifestLog
from skein.sources.outbox import by_key, high_mark, latest_per_entity, not_given_up

#: Which status may follow which.
NEXT = {"building": ("active", "failed"), "active": ("retired",), "retired": ("active",), "failed": ()}


#: Version of the layout of snapshots and manifests; a catalogue of a newer one is not opened.
LAYOUT = 1


class LayoutError(RuntimeError):
    """The catalogue was written by a newer version."""


class IndexUnavailable(RuntimeError):
    """No generation is active."""


class Moved(RuntimeError):
    """The catalogue changed since it was read."""


#: Fixed value: a build that has not been heard of for so many seconds is dead.
LEASE_S = 120


class RebuildInProgress(RuntimeError):
    """Another generation is being built."""


def bucket_of(buckets: int) -> Column:
    """The bucket of a row's key."""
    return F.pmod(F.xxhash64("entity_type", "entity_id"), F.lit(buckets)).cast("int")


class Catalog:
    """All generations, their snapshots and the active one.

    The whole catalogue is one small manifest; every change appends the next (compare-and-set by its number), so a reader
    that opened the active generation keeps its snapshot, count, items and facets agree, and two writers cannot both win.

    A snapshot is a folder per bucket of keys. Folders are never changed: a batch of events rewrites the buckets that it
    touches under fresh names (copy on write) and the manifest names which folder holds which bucket, so a small change
    does not rewrite the index. ``buckets`` is fixed per generation; choose it for buckets of about a gigabyte.
    """

    def __init__(self, spark: SparkSession, home: str, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), *, buckets: int = 16):
        self.spark, self.home, self.clock, self.buckets = spark, home.rstrip("/"), clock, buckets
        self.log = ManifestLog(spark, f"{self.home}/catalog")

    def _last(self) -> tuple[int, list[dict]]:
        n, state = self.log.last()
        if state and state.get("layout", 1) > LAYOUT:
            raise LayoutError(f"layout {state['layout']} is newer than {LAYOUT}")
        return n, [dict(g) for g in (state or {"generations": []})["generations"]]

    def generations(self) -> list[dict]:
        return self._last()[1]

    def _change(self, f: Callable[[list[dict]], None], at: int | None = None) -> list[dict]:
        """The next manifest; Moved if another came first (``at``: the number of manifests that there may be)."""
        n, rows = self._last()
        if at is not None and n != at:
            raise Moved(f"{n - at} changes since")
        f(rows)
        try:
            self.log.append(n, {"layout": LAYOUT, "generations": rows})
        except Exception as e:
            if self.log.last()[0] > n:
                raise Moved("another change came first") from e
            raise
        return rows

    def _find(self, rows: list[dict], id: int) -> dict:
        return next(g for g in rows if g["id"] == id)

    def _turn(self, g: dict, status: str, **more) -> None:
        if status not in NEXT[g["status"]]:
            raise ValueError(f"generation {g['id']} cannot turn from {g['status']} to {status}")
        g |= {"status": status, **more}

    def active(self) -> dict:
        g = next((g for g in self.generations() if g["status"] == "active"), None)
        if g is None:
            raise IndexUnavailable("no active generation")
        return g

    def create(self, watermark: int) -> int:
        """A new building generation; only one at a time."""

        def f(rows: list[dict]) -> None:
            if any(g["status"] == "building" for g in rows):
                raise RebuildInProgress("a generation is being built")
            rows.append({"id": max((g["id"] for g in rows), default=0) + 1, "status": "building", "created_at": self.clock().isoformat(), "watermark": watermark, "documents": 0, "buckets": self.buckets, "files": {}, "schema": None, "tags": None, "batch": -1, "failure": None})

        return self._change(f)[-1]["id"]

    def _lease(self, id: int):
        return self.log._path(f"{self.home}/lease={id}")

    def renew(self, id: int) -> None:
        """Says that the build of a generation is alive, by the age of a small file."""
        self.log._fs.create(self._lease(id), True).close()

    @contextmanager
    def building(self, id: int, every: float = LEASE_S / 4):
        """Renews the lease of a build while the block runs."""
        done = Event()

        def beat() -> None:
            while not done.wait(every):
                self.renew(id)

        self.renew(id)
        thread = Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()
            self.log._fs.delete(self._lease(id), False)

    def _write(self, rows: DataFrame, g: dict) -> dict[str, str]:
        """Bucket -> new folder, for the buckets that the rows are in."""
        root = f"{self.home}/generation={g['id']}/{uuid.uuid4().hex}"
        keyed = rows.withColumn("_bucket", bucket_of(g["buckets"]))
        keyed.repartition("_bucket").sortWithinPartitions("_bucket", "entity_type", "entity_id").write.partitionBy("_bucket").parquet(root)
        have = ManifestLog(self.spark, root).folders("_bucket=")
        return {k: f"{root}/_bucket={k}" for k in have}

    def save(self, rows: DataFrame, id: int) -> dict:
        """Writes a whole snapshot and its tag table; what ``put`` needs, and the number of rows that were written."""
        g, seen = self._find(self.generations(), id), Observation()
        part = {"files": self._write(rows.observe(seen, F.count(F.lit(1)).alias("n")), g), "schema": rows.schema.json()}
        part["written"] = seen.get["n"]
        stored = self.read(part)
        tag_index(stored).write.parquet(tags := f"{self.home}/tags={id}/{uuid.uuid4().hex}")
        return part | {"tags": tags, "documents": stored.count()}

    def read(self, g: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        """A snapshot, or some of its buckets; rows lie sorted by type and id, so filters on them skip row groups."""
        schema = T.StructType.fromJson(json.loads(g["schema"]))
        paths = [f for k, f in g["files"].items() if buckets is None or k in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, g: dict, events: DataFrame, source: DataFrame) -> tuple[dict, DataFrame]:
        """(the generation with the events applied, report)."""
        return self.merge(g, events.select("entity_type", "entity_id"), lambda before: apply_events(before, events, source, self.clock()))

    def merge(self, g: dict, keys: DataFrame, change: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[dict, DataFrame]:
        """(the generation with a change to rows of ``keys``, report). ``change``: rows -> (new rows, report). Only buckets of
        the keys are read and written, only their rows are counted, and only tags that a changed row had or has are
        counted anew."""
        keys = by_key(keys).distinct()
        touched = [str(r.b) for r in keys.select(bucket_of(g["buckets"]).alias("b")).distinct().collect()]  # at most all buckets
        before = self.read(g, touched)
        state, report = change(before)
        report = materialize(report, "report")
        new = {"files": g["files"] | self._write(state, g), "schema": g["schema"]}
        after = self.read(new, touched)
        changed = lambda rows: rows.join(keys, ["entity_type", "entity_id"], "left_semi").select(F.explode("tags").alias("tag"))
        anew = materialize(changed(before).unionByName(changed(after)).distinct(), "tags")
        old = self.spark.read.parquet(g["tags"]).join(anew, "tag", "left_anti")
        old.unionByName(tag_index(self.read(new), anew)).write.parquet(tags := f"{self.home}/tags={g['id']}/{uuid.uuid4().hex}")
        return g | new | {"tags": tags, "documents": g["documents"] + after.count() - before.count()}, report

    def rows(self, id: int | None = None) -> DataFrame:
        return self.read(self.active() if id is None else self._find(self.generations(), id))

    def tags(self) -> DataFrame:
        return self.spark.read.parquet(self.active()["tags"])

    def _fill(self, g: dict, part: dict, more: dict) -> None:
        g.update({k: part[k] for k in ("files", "schema", "tags", "documents")}, **more)

    def put(self, id: int, part: dict, *, seen: dict | None = None, **more) -> None:
        """The generation's new snapshot, as ``save`` or ``apply`` gave it. ``seen``: the generation as it was read; Moved
        if it is another by now, so that a change is never put on one that was replaced or retired meanwhile."""

        def f(rows: list[dict]) -> None:
            g = self._find(rows, id)
            if seen is not None and g != seen:
                raise Moved(f"generation {id} changed")
            self._fill(g, part, more)

        self._change(f)

    def _flip(self, rows: list[dict], id: int) -> None:
        self._turn(self._find(rows, id), "active", activated_at=self.clock().isoformat())
        for g in rows:
            if g["status"] == "active" and g["id"] != id:
                self._turn(g, "retired", retired_at=self.clock().isoformat())

    def activate(self, id: int) -> None:
        """The generation becomes active, the one before it retired, in one step. Also brings a retired one back."""
        self._change(lambda rows: self._flip(rows, id))

    def switch(self, id: int, part: dict, at: int, **more) -> None:
        """``put`` and ``activate`` in one manifest; Moved if there are more than the ``at`` manifests of the last look.
        The stream's last batch and dead letters go over from the generation before."""

        def f(rows: list[dict]) -> None:
            kept = next(({k: g[k] for k in ("batch", "dead") if k in g} for g in rows if g["status"] == "active"), {})
            self._fill(self._find(rows, id), part, kept | more)
            self._flip(rows, id)

        self._change(f, at)

    def fail(self, id: int, reason: str) -> None:
        self._change(lambda rows: self._turn(self._find(rows, id), "failed", failure=reason[:1000]))

    def recover(self, lease_s: float = LEASE_S) -> list[int]:
        """Generations left behind by a dead build turn failed: those whose lease was not renewed for ``lease_s`` seconds, or,
        where there is none, that were created so long ago. A living build is left alone."""
        fs, stale = self.log._fs, []
        now = self.clock().timestamp()
        for g in self.generations():
            if g["status"] == "building":
                lease = self._lease(g["id"])
                age = time.time() - fs.getFileStatus(lease).getModificationTime() / 1000 if fs.exists(lease) else now - datetime.fromisoformat(g["created_at"]).timestamp()
                if age > lease_s:
                    self.fail(g["id"], "abandoned")
                    stale.append(g["id"])
        return stale


def index_rows(documents: DataFrame, at: datetime, versions: DataFrame | None = None) -> DataFrame:
    """Snapshot rows (searchable form) of built documents; versions: (entity_type, entity_id, version)."""
    rows = documents
    if versions is not None:
        rows = rows.join(versions, ["entity_type", "entity_id"], "left")
    version = F.coalesce("version", F.lit(0)).cast("bigint") if versions is not None else F.lit(0).cast("bigint")
    now = F.lit(at).cast("timestamp")
    rows = rows.withColumns({"source_version": version, "indexed_at": now, "created_at": F.coalesce("created_at", now), "updated_at": F.coalesce("updated_at", now)})
    kept = [c for c in rows.columns if c not in ("doc_id", "version", "index_text")]
    return searchable(rows.select(*kept, "index_text"), F.col("index_text")).drop("index_text")


def apply_events(current: DataFrame, events: DataFrame, source: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, report) after the last event of every entity.

    A delete, and a write whose source row is gone, leaves a tombstone; any other action writes the document as the
    source has it now, with the event's order as version. Only source rows with events are built (semi join).
    """
    last = latest_per_entity(events.select("entity_type", "entity_id", "event_order", "created_at", "id", "action")).select("entity_type", "entity_id", "event_order", F.coalesce(folded("action") == "delete", F.lit(False)).alias("gone"))
    live = last.where(~F.col("gone"))
    docs = build_documents(source.join(live.select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_semi"))
    rows = materialize(index_rows(docs, at, live.select("entity_type", "entity_id", F.col("event_order").alias("version"))), "changed")
    missing = live.join(rows.select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_anti")
    reason = lambda df, why: df.select("entity_type", "entity_id", F.col("event_order").alias("source_version"), F.lit(why).alias("reason"))
    dead = reason(last.where("gone"), "source_event_deleted").unionByName(reason(missing, "source_missing"))
    first, written = upsert(current, rows, at)
    second, removed = tombstone(first, dead, at)
    return second, written.unionByName(removed)


def rebuild(catalog: Catalog, source: Callable[[], DataFrame], events: Callable[[], DataFrame]) -> int:
    """A full rebuild beside the active generation; its id.

    Watermark first, then build all kinds, validate, apply what the feed got meanwhile, and switch. Rounds of catching up
    go on, without a cap, until a look at the feed finds no event that the build has not seen, late ones below the watermark
    included. The switch holds only if the catalogue is the one from before that look: what the stream put on the
    old generation before it was in the feed then, and what it puts there after it makes the switch fail and the look
    repeat; what comes later finds the new generation active. On any error the new generation turns failed and the
    active one stays. Valid is a snapshot that holds as many rows as were given to the writer, each under a key of its own
    that is not blank. A build holds a lease; a second one is refused while it lives.
    """
    catalog.recover()
    mark = high_mark(events())
    id = catalog.create(mark)
    with catalog.building(id):
        return _build(catalog, id, mark, source, events)


def _build(catalog: Catalog, id: int, mark: int, source: Callable[[], DataFrame], events: Callable[[], DataFrame]) -> int:
    event = ["id", "entity_type", "entity_id", "event_order"]
    try:
        seen = materialize(events().where(F.col("event_order") <= mark).select(*event).distinct(), "seen")
        versions = by_key(seen).groupBy("entity_type", "entity_id").agg(F.max("event_order").alias("version"))
        part = catalog._find(catalog.generations(), id) | catalog.save(index_rows(build_documents(source()), catalog.clock(), versions), id)
        check = validate_generation(catalog.read(part), part["written"]).first()
        if not check.valid or check.rows != check.keys:
            raise ValueError(f"invalid generation: {check.rows} rows, {check.keys} keys, {check.blank_keys} blank keys")
        while True:
            at, _ = catalog.log.last()
            feed = events()
            same = reduce(and_, [feed[c].eqNullSafe(seen[c]) for c in event])
            rest = materialize(not_given_up(feed).where(F.col("event_order").isNotNull()).join(seen, same, "left_anti"), "rest")
            if rest.isEmpty():
                try:
                    catalog.switch(id, part, at, watermark=mark)
                    return id
                except Moved:
                    continue
            part, _ = catalog.apply(part, rest, source())
            seen, mark = materialize(seen.unionByName(rest.select(*event).distinct()), "seen"), max(mark, high_mark(rest))
    except Exception as e:
        catalog.fail(id, str(e))
        raise


def rebuild_entity(catalog: Catalog, source: DataFrame, entity_type: str, entity_id: str, version: int) -> DataFrame:
    """Re-reads one entity into the active generation; the report."""
    event = catalog.spark.createDataFrame([(entity_type, entity_id, "upsert", version, catalog.clock(), "rebuild")], "entity_type string, entity_id string, action string, event_order bigint, created_at timestamp, id string")
    while True:
        g = catalog.active()
        part, report = catalog.apply(g, event, source)
        try:
            catalog.put(g["id"], part, seen=g)
            return report
        except Moved:
            continue
