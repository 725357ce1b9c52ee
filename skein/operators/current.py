"""The active generation and its current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.terms import folded

HIDDEN = ("hidden", "deleted")


def active_generation(generations: DataFrame) -> tuple[int, int] | None:
    """(id, source_high_watermark) of the active generation, None where there is none.

    The catalogue has at most one active row by design; of several the highest id is taken. One row reaches the driver.
    """
    r = (
        generations.where(folded("status") == "active")
        .orderBy(F.desc("id"))
        .select("id", F.coalesce("source_high_watermark", F.lit(0).cast("bigint")).alias("mark"))
        .limit(1)
        .collect()
    )
    return (r[0].id, r[0].mark) if r else None


def current_rows(index: DataFrame, generation: int | None, columns: list[str]) -> DataFrame:
    """One row per (entity_type, entity_id) of the generation: highest source_version, then latest indexed_at.

    The generation is a literal, so it prunes partitions or row groups of the scan. Copies of a hot entity fold before
    the shuffle (max is a partial aggregate). Rows that agree in both order columns but not in content are decided by the
    content, so the result does not depend on the plan. Null versions and times come last. ``generation`` None: no rows.
    """
    rows = index.where(F.lit(False) if generation is None else F.col("generation_id") == generation)
    rest = [c for c in columns if c not in ("entity_type", "entity_id")]
    best = F.max(F.struct("source_version", "indexed_at", *[c for c in rest if c not in ("source_version", "indexed_at")]))
    return rows.groupBy("entity_type", "entity_id").agg(best.alias("_r")).select("entity_type", "entity_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def is_listed(status: str = "status"):
    """Neither hidden nor deleted, whatever the spelling; a null status is listed."""
    return ~F.coalesce(folded(status), F.lit("")).isin(*HIDDEN)


def listed_rows(index: DataFrame, generation: int | None, columns: list[str]) -> DataFrame:
    """Current rows that are neither hidden nor deleted."""
    want = list(dict.fromkeys([*columns, "status"]))
    return current_rows(index, generation, want).where(is_listed()).select("entity_type", "entity_id", *[c for c in columns if c not in ("entity_type", "entity_id")])
