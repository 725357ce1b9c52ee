"""Counts and checks over an index, its feed and its jobs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.terms import trimmed


def status_counts(view: DataFrame) -> DataFrame:
    """(entity_type, n) of all rows, hidden and deleted ones included."""
    return view.groupBy("entity_type").agg(F.count("*").alias("n"))


def job_summary(log: DataFrame) -> DataFrame:
    """One row: end of the last success, failed and running jobs, message of the latest failure."""
    return log.agg(
        F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last_success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.max_by(F.when(F.col("status") == "failed", F.coalesce("error", "message")), F.when(F.col("status") == "failed", F.struct("started_at", "id"))).alias("last_failure"),
    )


def feed_lag(events: DataFrame, now: datetime) -> DataFrame:
    """One row: seconds since the oldest event that is not processed, 0 if there is none or it lies ahead. One event is one
    id: a row from before it was processed does not make it wait."""
    each = events.groupBy("id").agg(F.max(F.col("processed_at").isNotNull()).alias("done"), F.min(F.unix_micros("created_at")).alias("since"))
    oldest = F.min(F.when(~F.col("done"), F.col("since")))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - oldest) / 1_000_000
    return each.agg(F.greatest(F.coalesce(age, F.lit(0.0)), F.lit(0.0)).alias("lag_seconds"))


def event_stats(events: DataFrame) -> DataFrame:
    """One row of counts: all, processed, failed, locked and waiting events; one event is one id."""
    each = events.groupBy("id").agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in ("processed_at", "failed_at", "locked_at")])
    done, failed, locked = F.col("processed_at"), F.col("failed_at"), F.col("locked_at")
    return each.agg(F.count("*").alias("events"), F.count_if(done).alias("processed"), F.count_if(failed & ~done).alias("failed"), F.count_if(locked & ~done).alias("locked"), F.count_if(~done).alias("backlog"))


def version_per_entity(events: DataFrame) -> DataFrame:
    """(entity_type, entity_id, version): the highest order of each entity."""
    return events.groupBy(trimmed("entity_type").alias("entity_type"), trimmed("entity_id").alias("entity_id")).agg(F.max("event_order").alias("version"))


def expectations(events: DataFrame) -> DataFrame:
    """(entity_type, entity_id, version, only_writes): what the index should hold after the feed."""
    writes = F.lower(trimmed("action")) != "delete"
    return events.groupBy(trimmed("entity_type").alias("entity_type"), trimmed("entity_id").alias("entity_id")).agg(F.max("event_order").alias("version"), F.bool_and(writes).alias("only_writes"))


def validate_generation(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """One row: rows, distinct keys, rows with a blank key, valid."""
    blank = (F.length(F.coalesce(trimmed("entity_type"), F.lit(""))) == 0) | (F.length(F.coalesce(trimmed("entity_id"), F.lit(""))) == 0)
    keys = rows.groupBy("entity_type", "entity_id").agg(F.count("*").alias("n"), F.count_if(blank).alias("b"))
    out = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum("b"), F.lit(0)).alias("blank_keys"))
    want = F.col("keys") if expected is None else F.lit(expected)
    return out.withColumn("valid", (F.col("rows") == want) & (F.col("blank_keys") == 0))


def nearest_rank(df: DataFrame, value: str | Column, percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """One row of percentiles that are values of the data (nearest rank); 0 without values."""
    v = value if isinstance(value, str) else "_v"
    rows = df if isinstance(value, str) else df.select(value.alias("_v"))
    return rows.agg(*[F.expr(f"coalesce(percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {v}), 0)").alias(f"p{p}") for p in percents])


def hit_ratio(calls: DataFrame, kind: str = "kind", hit: str = "hit", failed: str = "failed") -> DataFrame:
    """(kind, calls, failures, hit_ratio) per kind of call and, with kind null, over all; failed calls do not count as hits
    or misses. One pass with grouping sets."""
    ok = ~F.coalesce(F.col(failed), F.lit(False))
    by = calls.rollup(F.col(kind).alias("kind"))
    out = by.agg(F.count("*").alias("calls"), F.count_if(~ok).alias("failures"), F.coalesce(F.avg(F.when(ok, F.col(hit).cast("double"))), F.lit(0.0)).alias("hit_ratio"))
    return out
