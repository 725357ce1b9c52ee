"""The feed as a source: what may be taken, ranges of it, versions of entities."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.terms import folded, trimmed
from skein.operators.current import active_generation
from skein.operators.writes import latest_per_key

#: Events of one take, most in a take, lease, pause after a failure (both seconds), attempts.
BATCH, MOST, LEASE_S, RETRY_S, ATTEMPTS = 200, 500, 120, 30, 10
#: Fixed value: longest error that is kept, in bytes.
ERROR_BYTES = 1000


def latest_look(events: DataFrame) -> DataFrame:
    """One row per event: its state when last seen (by attempts, then updated_at; being processed is final)."""
    e = events.withColumn("_done", F.col("processed_at").isNotNull())
    return latest_per_key(e, ["id"], ["_done", "updated_at", "attempts", "event_order"]).drop("_done")


def eligible(events: DataFrame, now: datetime, *, lease_s: int = LEASE_S, retry_s: int = RETRY_S, attempts: int = ATTEMPTS) -> DataFrame:
    """Events not processed, not locked (or locked too long), with attempts left and their pause after a failure over."""
    t = F.lit(now).cast("timestamp")
    ago = lambda s: t - F.make_interval(secs=F.lit(s).cast("decimal(18,6)"))
    free = F.col("locked_at").isNull() | (F.col("locked_at") < ago(lease_s))
    rested = F.col("failed_at").isNull() | (F.col("failed_at") <= ago(retry_s))
    return events.where(F.col("processed_at").isNull() & free & (F.coalesce("attempts", F.lit(0)) < attempts) & rested)


def claim(events: DataFrame, now: datetime, batch: int = BATCH, **limits: int) -> DataFrame:
    """The next eligible events in order; a top-k, not a sort of the feed."""
    return eligible(events, now, **limits).orderBy("event_order", "id").limit(min(max(batch, 1), MOST))


def marked(events: DataFrame, picked: DataFrame, now: datetime) -> DataFrame:
    """The feed with ``locked_at`` = now on the events of ``picked`` (what ``claim`` gave: at most MOST ids)."""
    mine = F.broadcast(picked.select(F.col("id").alias("_id"), F.lit(now).cast("timestamp").alias("_now")))  # at most MOST rows
    both = events.join(mine, events["id"] == F.col("_id"), "left")
    return both.withColumn("locked_at", F.coalesce("_now", "locked_at")).select(*events.columns)


def _settled(events: DataFrame, ids: DataFrame, lock: datetime, changes: dict) -> tuple[DataFrame, DataFrame]:
    """(the feed with ``changes`` on the events of ``ids`` that still carry this lock, ids that none carries any more)."""
    own = ids.withColumnRenamed("id", "_id").withColumn("_mine", F.lit(True))
    both = events.join(own, events["id"] == F.col("_id"), "left")
    ours = F.coalesce(F.col("_mine") & (F.col("locked_at") == F.lit(lock).cast("timestamp")) & F.col("processed_at").isNull(), F.lit(False))
    table = both.select(*[F.when(ours, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in events.columns])
    held = events.where((F.col("locked_at") == F.lit(lock).cast("timestamp")) & F.col("processed_at").isNull()).select("id")
    return table, ids.select("id").distinct().join(held, "id", "left_anti")


def acknowledged(events: DataFrame, ids: DataFrame, lock: datetime, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(feed, ids whose lock was lost): the events of ``ids`` (id) become processed, without failure and lock, but only
    where they carry the lock that was taken: a worker whose lease ran out cannot acknowledge what another has taken."""
    none = F.lit(None).cast("timestamp")
    return _settled(events, ids, lock, {"processed_at": F.lit(now).cast("timestamp"), "failed_at": none, "locked_at": none, "last_error": F.lit(None).cast("string"), "updated_at": F.lit(now).cast("timestamp")})


def failed(events: DataFrame, errors: DataFrame, lock: datetime, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(feed, ids whose lock was lost): the events of ``errors`` (id, error: one row each) get one try more, the error's
    first ERROR_BYTES bytes, whole characters, and no lock. Failures of the business only: what the infrastructure
    breaks is ``released``."""
    kept = F.expr(f"element_at(filter(transform(sequence(least(length(error), {ERROR_BYTES}), 0, -1), n -> left(error, n)), x -> octet_length(x) <= {ERROR_BYTES}), 1)")
    t = F.lit(now).cast("timestamp")
    return _settled(events, errors, lock, {"failed_at": t, "last_error": kept, "attempts": (F.coalesce("attempts", F.lit(0)) + 1).cast("int"), "locked_at": F.lit(None).cast("timestamp"), "updated_at": t})


def released(events: DataFrame, ids: DataFrame, lock: datetime) -> tuple[DataFrame, DataFrame]:
    """(feed, ids whose lock was lost): the events lose the lock and no try."""
    return _settled(events, ids, lock, {"locked_at": F.lit(None).cast("timestamp")})


def not_given_up(events: DataFrame, *, attempts: int = ATTEMPTS) -> DataFrame:
    """Events without those given up (attempts used up, failed, not processed)."""
    given_up = (F.coalesce("attempts", F.lit(0)) >= attempts) & F.col("failed_at").isNotNull() & F.col("processed_at").isNull()
    return events.where(~given_up)


def outbox_range(events: DataFrame, after: int, upto: int, *, attempts: int = ATTEMPTS) -> DataFrame:
    """Events of (after, upto], without those given up."""
    return not_given_up(events.where((F.col("event_order") > after) & (F.col("event_order") <= upto)), attempts=attempts)


def by_key(events: DataFrame) -> DataFrame:
    """The events with their keys in the one form in which keys count: without outer white space."""
    return events.withColumns({"entity_type": trimmed("entity_type"), "entity_id": trimmed("entity_id")})


def latest_per_entity(events: DataFrame) -> DataFrame:
    """The last event of each entity, by order, time and id. All columns travel: select what is needed first."""
    return latest_per_key(by_key(events), ["entity_type", "entity_id"], ["event_order", "created_at", "id"])


def events_per_entity(events: DataFrame) -> DataFrame:
    """(entity_type, entity_id, id): the different events that are folded into one outcome; as rows, so that an entity may
    have any number of them."""
    return by_key(events.select("entity_type", "entity_id", "id")).distinct()


def versions_of(keys: DataFrame, events: DataFrame) -> DataFrame:
    """``keys`` with the highest event_order of each, 0 where the feed has none."""
    top = by_key(events).groupBy("entity_type", "entity_id").agg(F.max("event_order").alias("version"))
    return keys.join(top, ["entity_type", "entity_id"], "left").withColumn("version", F.coalesce("version", F.lit(0)))


def append_events(events: DataFrame, folder: str) -> None:
    """Adds events to a feed of Parquet files, in bulk; readers of the folder see whole files only."""
    events.write.mode("append").parquet(folder)


def high_mark(events: DataFrame) -> int:
    """The highest order of a feed as read now, 0 if it is empty."""
    return events.agg(F.max("event_order")).first()[0] or 0


def catch_up_bounds(generations: DataFrame, events: DataFrame) -> tuple[int, int]:
    """(after, upto) of what the active generation lacks: from its watermark (0 without one) to that of the generation
    being built, and to the feed's end where none is."""
    active = active_generation(generations)
    building = generations.where(folded("status") == "building").agg(F.max("source_high_watermark")).first()[0]
    return active[1] if active else 0, high_mark(events) if building is None else building
