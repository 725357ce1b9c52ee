"""Queries on the change feed: problems 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.changes import apply_changes
from skein.operators.current import active_generation
from skein.operators.incremental import IncrementalJob, pending_events
from skein.operators.intervals import to_intervals
from skein.session import load, scratch

#: White space as DuckDB's trim takes it; the same set as functions.terms.SPACES.
BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"


#: Columns of the index that a change never carries.
_STORED = ["status", "category_id", "author_id", "tags", "keywords", "weight", "view_count", "like_count", "download_count", "payload", "created_at", "updated_at", "indexed_at"]


def _state(spark: SparkSession, folder: str) -> DataFrame:
    active = active_generation(load(spark, folder, "index_generations"))
    base = load(spark, folder, "search_index").where(F.lit(False) if active is None else F.col("generation_id") == active[0])
    text, stored = F.lit(None).cast("string"), F.struct(*_STORED)
    fields = {
        "title": (F.col("title"), text),
        "origin": (text, F.col("source")),
        "reason": (text, F.get_json_object("payload", "$.reason")),
        "try": (text, F.get_json_object("payload", "$.try")),
        "stored": (stored, F.lit(None).cast(base.select(stored.alias("x")).schema["x"].dataType)),
    }
    return apply_changes(base, load(spark, folder, "search_index_events"), fields)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _state(spark, folder).select("entity_type", "entity_id", "source_version")


def p2_state(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored column of the state; lists joined, times in microseconds."""
    told = lambda c: F.array_join(f"stored.{c}", "|") if c in ("tags", "keywords") else F.unix_micros(f"stored.{c}") if c.endswith("_at") else F.col(f"stored.{c}")
    kept = ["entity_type", "entity_id", "source_version", "title", "origin", "reason", "try"]
    return _state(spark, folder).select(*kept, *[told(c).alias(c) for c in _STORED])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """A run of the incremental job from the active generation's mark on."""
    active = active_generation(load(spark, folder, "index_generations"))
    return pending_events(load(spark, folder, "search_index_events"), active and active[1]).select("event_id")


def _dies(rows: DataFrame) -> DataFrame:
    raise InterruptedError("between the input and the output of a run")


def p3_next(spark: SparkSession, folder: str) -> DataFrame:
    """The pending events as two runs take them: one that sees the even hours only and dies before its commit, is repeated,
    and one that sees all. No event is skipped and none comes twice."""
    active = active_generation(load(spark, folder, "index_generations"))
    feed = load(spark, folder, "search_index_events").select("event_order", "id", "processed_at", "created_at")
    even = F.coalesce(F.pmod(F.hour("created_at"), F.lit(2)), F.lit(0)) == 0
    job = IncrementalJob(spark, scratch(spark, "next"))
    if active:
        job.settle(active[1])
    job.acknowledge(feed.where("processed_at IS NOT NULL"))
    told = lambda rows: rows.select(F.col("id").alias("event_id"))
    first = feed.where(even).select("event_order", "id")
    try:
        job.run(first, _dies)
    except InterruptedError:
        job.run(first, told)
    job.run(feed.select("event_order", "id"), told)
    return job.output()


def p3_processed_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The numbers all of whose events are done, as disjoint intervals."""
    e = load(spark, folder, "search_index_events").where(F.col("event_order").isNotNull())
    each = e.groupBy("id").agg(F.max("event_order").alias("n"), F.max(F.col("processed_at").isNotNull()).alias("done"))
    return to_intervals(each.groupBy("n").agg(F.min("done").alias("done")).where("done"), "n")


def p3_increments(spark: SparkSession, folder: str, runs: int = 3) -> DataFrame:
    """The events as an incremental job takes them, each once, while the feed fills up out of order: run k of ``runs`` also
    sees the hours k - 1 modulo ``runs``, so numbers come late between processed ones and ids under processed numbers."""
    feed = load(spark, folder, "search_index_events")
    hour = F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / 3_600_000_000)
    slot = F.coalesce(F.pmod(hour, F.lit(runs)), F.lit(0))
    job = IncrementalJob(spark, scratch(spark, "increments"))
    for k in range(runs):
        job.run(feed.where(slot <= k), lambda rows: rows.select(F.col("id").alias("event_id"), "event_order").distinct())
    return job.output()


_OWN = ", ".join(_STORED)
_TOLD = ", ".join((f"array_to_string({c}, '|')" if c in ("tags", "keywords") else f"epoch_us({c})" if c.endswith("_at") else c) + f" AS s_{c}" for c in _STORED)
_CHANGES = f"""
WITH g AS (SELECT id, source_high_watermark FROM index_generations WHERE status = 'active'),
base AS (
  SELECT trim(entity_type, {BLANKS}) AS entity_type, trim(entity_id, {BLANKS}) AS entity_id, source_version, lower(trim(status, {BLANKS})) <> 'deleted' AS there, title, {_OWN}
  FROM search_index JOIN g ON generation_id = g.id
  QUALIFY row_number() OVER (PARTITION BY trim(entity_type, {BLANKS}), trim(entity_id, {BLANKS}) ORDER BY source_version DESC, indexed_at DESC) = 1),
feed AS (
  SELECT DISTINCT trim(entity_type, {BLANKS}) AS entity_type, trim(entity_id, {BLANKS}) AS entity_id, event_order, created_at, id, updated_at, lower(trim(action, {BLANKS})) AS action,
    source AS origin, payload->>'$.reason' AS reason, payload->>'$.try' AS "try"
  FROM search_index_events WHERE trim(entity_id, {BLANKS}) <> ''),
valid AS (
  SELECT f.* FROM feed f LEFT JOIN base b USING (entity_type, entity_id) WHERE b.entity_id IS NULL OR f.event_order >= b.source_version),
last AS (
  SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY event_order DESC, created_at DESC, id DESC, updated_at DESC, action <> 'delete' DESC) = 1),
"""

SQL = {
    "p2_found": _CHANGES
    + """ever AS (SELECT entity_type, entity_id FROM base UNION SELECT entity_type, entity_id FROM last)
SELECT entity_type, entity_id, coalesce(l.event_order, b.source_version) AS source_version
FROM ever LEFT JOIN base b USING (entity_type, entity_id) LEFT JOIN last l USING (entity_type, entity_id)
WHERE CASE WHEN l.action IS NOT NULL THEN l.action <> 'delete' ELSE b.there END""",
    "p2_state": _CHANGES
    + f"""steps AS (
  SELECT entity_type, entity_id, event_order, created_at AS t, id, updated_at AS u, 1 AS k, bool_or(action <> 'delete') AS there, bool_or(action IN ('delete', 'insert', 'upsert')) AS wall,
    NULL AS title, max(origin) FILTER (action <> 'delete') AS origin, max(reason) FILTER (action <> 'delete') AS reason, max("try") FILTER (action <> 'delete') AS "try" FROM valid GROUP BY ALL
  UNION ALL SELECT entity_type, entity_id, source_version, NULL, NULL, NULL, 0, there, true, CASE WHEN there THEN title END, NULL, NULL, NULL FROM base),
numbered AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY event_order, k, t NULLS FIRST, id NULLS FIRST, u NULLS FIRST, there) AS n FROM steps),
walls AS (SELECT entity_type, entity_id, max(n) FILTER (wall) AS w, max(n) AS z FROM numbered GROUP BY ALL),
ends AS (SELECT entity_type, entity_id, max(event_order) AS source_version, bool_or(k = 0 AND there) AS own,
  arg_max(title, n) FILTER (title IS NOT NULL) AS title, arg_max(origin, n) FILTER (origin IS NOT NULL) AS origin,
  arg_max(reason, n) FILTER (reason IS NOT NULL) AS reason, arg_max("try", n) FILTER ("try" IS NOT NULL) AS "try"
FROM numbered JOIN walls USING (entity_type, entity_id) WHERE n >= coalesce(w, 0)
GROUP BY entity_type, entity_id HAVING arg_max(there, n))
SELECT e.entity_type, e.entity_id, e.source_version, e.title, origin, reason, "try", {", ".join(f"s_{c} AS {c}" for c in _STORED)}
FROM ends e LEFT JOIN (SELECT entity_type, entity_id, {_TOLD} FROM base) b ON own AND e.entity_type = b.entity_type AND e.entity_id = b.entity_id""",
    "p3_found": """
SELECT id AS event_id FROM search_index_events
WHERE event_order > (SELECT source_high_watermark FROM index_generations WHERE status = 'active')
GROUP BY id HAVING count(processed_at) = 0""",
    "p3_next": """
SELECT id AS event_id FROM search_index_events
WHERE event_order > (SELECT source_high_watermark FROM index_generations WHERE status = 'active')
GROUP BY id HAVING count(processed_at) = 0""",
    "p3_processed_intervals": """
WITH each AS (SELECT id, max(event_order) AS n, count(processed_at) > 0 AS done FROM search_index_events GROUP BY id),
done AS (SELECT n FROM each GROUP BY n HAVING bool_and(done))
SELECT min(n) AS lo, max(n) AS hi FROM (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM done) GROUP BY g""",
    "p3_increments": "SELECT DISTINCT id AS event_id, event_order FROM search_index_events WHERE event_order IS NOT NULL",
}

QUERIES = {"p2_found": p2_found, "p2_state": p2_state, "p3_found": p3_found, "p3_next": p3_next, "p3_processed_intervals": p3_processed_intervals, "p3_increments": p3_increments}
