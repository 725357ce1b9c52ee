"""The feed as a stream: micro-batches folded per entity and merged into the active generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions.terms import folded, trimmed
from skein.operators.catalog import Catalog, Moved
from skein.plans.request import ENTITY_TYPES
from skein.session import materialize
from skein.sources.outbox import ATTEMPTS, RETRY_S

EVENT_SCHEMA = "id string, entity_type string, entity_id string, action string, event_order bigint, created_at timestamp"


class OutboxStream:
    """Applies a stream of events to the active generation.

    At least once becomes once: a batch is committed in the same manifest as the snapshot it made, so a batch that is
    delivered again is skipped, and versions make even a repeated event harmless. Late and swapped events lose against
    higher versions. Events that name no known kind or no id go to ``dead``, with the number of tries, and do not hold up
    their siblings; after a pause they come back into a next batch until their tries are used up, then they stay for a
    replay. What the infrastructure breaks ends the query and uses up no try: the batch is delivered again.
    """

    def __init__(self, catalog: Catalog, source: Callable[[], DataFrame], checkpoint: str, *, attempts: int = ATTEMPTS, retry_s: float = RETRY_S):
        self.catalog, self.source, self.checkpoint, self.attempts, self.retry_s = catalog, source, checkpoint.rstrip("/"), attempts, retry_s

    def _dead(self) -> DataFrame:
        path = self.catalog.active().get("dead")
        spark = self.catalog.spark
        return spark.read.parquet(path) if path else spark.createDataFrame([], EVENT_SCHEMA + ", attempts int, failed_at timestamp, last_error string")

    def dead(self) -> DataFrame:
        """Events that failed so far."""
        return self._dead()

    def apply(self, batch: DataFrame, n: int) -> None:
        """The batch on the active generation, again if that was replaced or changed meanwhile."""
        while True:
            try:
                return self._apply(batch, n)
            except Moved:
                continue

    def _apply(self, batch: DataFrame, n: int) -> None:
        g = self.catalog.active()
        if n <= g["batch"]:
            return
        old = self._dead()
        now = F.lit(self.catalog.clock()).cast("timestamp")
        due = (F.col("attempts") < self.attempts) & (F.col("failed_at") <= now - F.make_interval(secs=F.lit(self.retry_s).cast("decimal(18,6)")))
        again = old.where(due)
        rows = materialize(batch.select("id", "entity_type", "entity_id", "action", "event_order", "created_at").withColumns({"attempts": F.lit(0), "failed_at": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string")}).unionByName(again), "batch")
        fine = folded("entity_type").isin(*ENTITY_TYPES) & (F.length(trimmed("entity_id")) > 0) & F.col("event_order").isNotNull()
        good, bad = rows.where(F.coalesce(fine, F.lit(False))), rows.where(~F.coalesce(fine, F.lit(False)))
        why = F.when(F.col("event_order").isNull(), "no order").when(F.coalesce(F.length(trimmed("entity_id")), F.lit(0)) == 0, "no entity id").otherwise(F.concat(F.lit("unknown entity type "), F.coalesce("entity_type", F.lit(""))))
        failed = bad.withColumns({"attempts": F.col("attempts") + 1, "failed_at": now, "last_error": why}).unionByName(old.where(~due))
        failed.write.mode("overwrite").parquet(dead := f"{self.checkpoint}/dead/{n:012d}")
        part, _ = self.catalog.apply(g, good, self.source())
        self.catalog.put(g["id"], part, seen=g, batch=n, dead=dead)

    def start(self, events: DataFrame, *, available_now: bool = False, every: str = "2 seconds") -> StreamingQuery:
        """Starts the query on a streaming DataFrame of EVENT_SCHEMA; offsets take the place of leases."""
        writer = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.checkpoint}/offsets")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the event files in a folder, in order of arrival."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
