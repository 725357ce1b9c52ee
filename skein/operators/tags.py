"""The tag table: one row per tag of a generation with its counts, and pages over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.terms import folded
from skein.functions.text import OPAQUE_ID
from skein.plans.request import ENTITY_TYPES

ORDERS = {"count": [F.desc, F.asc], "name": [None, F.asc], "latest": [F.desc, F.asc]}


def tag_uses(view: DataFrame) -> DataFrame:
    """One row per use of a tag by a listed row that is not itself a tag; blank and opaque tags are left out."""
    open_rows = view.where(~F.col("status").isin("hidden", "deleted") & ~F.col("entity_type").isin("tag", "official_tag"))
    rows = open_rows.select("entity_type", "category_id", F.coalesce("updated_at", "created_at", "indexed_at").alias("time"), F.explode("tags").alias("tag"))
    return rows.withColumn("tag", folded("tag")).where((F.length("tag") > 0) & ~F.col("tag").rlike(OPAQUE_ID))


def tag_index(view: DataFrame, only: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """tag, entity_types (sorted), total_count, a count per entity type, category_counts (map), updated_at.

    One shuffle by tag: uses fold by (tag, category) first, so a tag that a third of the rows carry arrives as one row per
    category and task. ``only`` (a list, or a table with a column tag) restricts it to some tags (after a small change); an empty one gives
    no rows.
    """
    if isinstance(only, DataFrame):
        rows = tag_uses(view).join(only.select("tag").distinct(), "tag", "left_semi")
    elif only is not None:
        rows = tag_uses(view.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in only]).cast("array<string>")))).where(F.col("tag").isin(list(only)))
    else:
        rows = tag_uses(view)
    counts = [F.count_if(F.col("entity_type") == t).alias(f"{t}_count") for t in ENTITY_TYPES]
    by_category = rows.groupBy("tag", F.coalesce("category_id", F.lit("")).alias("category")).agg(F.max("time").alias("time"), F.collect_set("entity_type").alias("types"), F.count("*").alias("n"), *counts)
    per = F.collect_list(F.when(F.col("category") != "", F.struct("category", "n")))
    whole = by_category.groupBy("tag").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("entity_types"),
        F.sum("n").alias("total_count"),
        *[F.sum(f"{t}_count").alias(f"{t}_count") for t in ENTITY_TYPES],
        F.map_from_entries(per).alias("category_counts"),
        F.max("time").alias("updated_at"),
    )
    return whole


def category_counts(view: DataFrame) -> DataFrame:
    """(tag, category_id, n) for uses in a category."""
    return tag_uses(view).where(F.coalesce("category_id", F.lit("")) != "").groupBy("tag", "category_id").agg(F.count("*").alias("n"))


def contains_text(c: Column | str, text: str) -> Column:
    """The text occurs literally, in any case; %, _ and backslash mean themselves."""
    return F.contains(F.lower(F.col(c) if isinstance(c, str) else c), F.lower(F.lit(text)))


def tag_page(tags: DataFrame, text: str = "", sort: str = "count", limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of the tag table: limit 1..200 (50), offset 0..10,000."""
    if sort not in ("count", "name", "latest"):
        raise ValueError("invalid_sort")
    rows = tags.where(contains_text("tag", text.strip())) if text.strip() else tags
    by = {"count": [F.desc("total_count"), F.asc("tag")], "name": [F.asc("tag")], "latest": [F.desc("updated_at"), F.asc("tag")]}[sort]
    return rows.orderBy(*by).offset(min(max(offset, 0), 10_000)).limit(50 if limit == 0 else min(max(limit, 1), 200))
