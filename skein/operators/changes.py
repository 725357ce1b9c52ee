"""A feed of inserts, updates and deletes applied in order, column by column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.terms import folded, trimmed

DELETES = ("delete",)
REPLACES = ("insert", "upsert")


def apply_changes(
    base: DataFrame,
    changes: DataFrame,
    fields: Mapping[str, tuple[Column, Column]] = {},
    *,
    key: Sequence[str] = ("entity_type", "entity_id"),
    deletes: Sequence[str] = DELETES,
    replaces: Sequence[str] = REPLACES,
) -> DataFrame:
    """State of every entity that exists after ``changes`` on top of ``base``: key, source_version and one column per field.

    Method: column-wise last writer wins. Each row gets a sequence (version, base before change, time, id,
    time of the last look at the change). The rows of
    ``base`` and the actions in ``replaces`` are replacements, those in ``deletes`` remove (and set nothing), all others set only the fields
    they carry (a field is set where its expression is not null). A field's value is that of the greatest sequence that
    sets it, and it counts only from the latest removal or replacement on. Existence is such a field, set by every write: an
    entity exists if its last write lies at or beyond the barrier, and the version it ends with is that write's. All of it
    is one GROUP BY of maxima over structs: the maximum over all writers lies beyond the barrier exactly if any writer does,
    so no second pass and no join is needed, copies of a hot entity fold before the shuffle, and the order of delivery and
    repeated rows do not matter. Fields that are always set together are better one struct-valued field: its sequence
    travels once.

    base: key, status, source_version, indexed_at. changes: key, action, event_order, created_at, id, updated_at. Others are ignored
    unless a field names them. fields: output name -> (expression on base, expression on changes), of one type.

    Defined cases: keys count without outer white space; null or blank entity ids (the last key column) have no effect, as
    have changes without event_order; a null action writes; a base row of status deleted is gone but keeps its version, so
    older changes cannot revive it; a null source_version is 0; rows of equal (event_order, created_at, id) are one
    change seen at several times, of which the latest updated_at tells (if that is equal too, the greater content); empty inputs give what the other holds.
    """
    keys = [trimmed(k).alias(k) for k in key]
    act = F.coalesce(folded("action"), F.lit(""))
    values = lambda k, there: F.struct(*[F.when(there, v[k]).alias(n) for n, v in fields.items()]) if fields else F.struct(F.lit(None).cast("string").alias("_none"))
    base_there, there = ~(F.coalesce(folded("status"), F.lit("")) == "deleted"), ~act.isin(*deletes)
    a = base.select(
        *keys,
        F.struct(F.coalesce("source_version", F.lit(0)).cast("bigint").alias("v"), F.lit(0).alias("k"), F.col("indexed_at").cast("timestamp").alias("t"), F.lit(None).cast("string").alias("i"), F.lit(None).cast("timestamp").alias("u")).alias("_s"),
        base_there.alias("_there"),
        F.lit(True).alias("_wall"),
        values(0, base_there).alias("_f"),
    )
    b = changes.where(F.col("event_order").isNotNull()).select(
        *keys,
        F.struct(F.col("event_order").cast("bigint").alias("v"), F.lit(1).alias("k"), F.col("created_at").cast("timestamp").alias("t"), F.col("id").cast("string").alias("i"), F.col("updated_at").cast("timestamp").alias("u")).alias("_s"),
        there.alias("_there"),
        act.isin(*deletes, *replaces).alias("_wall"),
        values(1, there).alias("_f"),
    )
    rows = a.unionByName(b).where(F.length(F.col(key[-1])) > 0)
    written = F.max(F.when(F.col("_there"), F.col("_s"))).alias("_written")
    wall = F.max(F.when(F.col("_wall"), F.col("_s"))).alias("_wall")
    writes = [F.max(F.when(F.col(f"_f.{n}").isNotNull(), F.struct(F.col("_s").alias("s"), F.col(f"_f.{n}").alias("x")))).alias(f"_w_{n}") for n in fields]
    beyond = lambda s: F.col("_wall").isNull() | (s >= F.col("_wall"))
    state = rows.groupBy(*key).agg(written, wall, *writes).where(F.col("_written").isNotNull() & beyond(F.col("_written")))
    kept = [F.when(beyond(F.col(f"_w_{n}.s")), F.col(f"_w_{n}.x")).alias(n) for n in fields]
    return state.select(*key, F.col("_written.v").alias("source_version"), *kept)
