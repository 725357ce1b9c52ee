"""Writes to an index snapshot, gated by source versions. Each gives the new snapshot; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.terms import folded, trimmed
from skein.functions.text import document_id, sorted_strings

KEY = ["entity_type", "entity_id"]


def prepared(docs: DataFrame) -> DataFrame:
    """Documents ready to be written: keys trimmed, a missing id taken from doc_id, a blank type is document, status
    folded (blank: active), lists sorted and distinct, blank category and author null. Rows without any id: error."""
    kind = folded("entity_type")
    own = F.coalesce(trimmed("entity_id"), F.lit(""))
    other = F.coalesce(trimmed("doc_id"), F.lit("")) if "doc_id" in docs.columns else F.lit("")
    id = F.when(F.length(own) > 0, own).otherwise(other)
    return docs.withColumns(
        {
            "entity_type": F.when(F.length(kind) > 0, kind).otherwise("document"),
            "entity_id": F.when(F.length(id) > 0, id).otherwise(F.raise_error(F.lit("entityId or docId is required")).cast("string")),
            "status": F.when(F.length(folded("status")) > 0, folded("status")).otherwise("active"),
            "tags": sorted_strings("tags"),
            "keywords": sorted_strings("keywords"),
            "category_id": F.nullif(F.btrim("category_id"), F.lit("")),
            "author_id": F.nullif(F.btrim("author_id"), F.lit("")),
        }
    )


def latest_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``order``; one aggregation that folds before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]]).select(*rows.columns)


def _merge(current: DataFrame, incoming: DataFrame, passes: Column, values: dict[str, Column], at: datetime) -> DataFrame:
    """Full outer join by key: (all columns of current, _applied: null for rows that nothing came in for)."""
    cur = current.select(F.struct(*current.columns).alias("c"))
    new = incoming.select(F.struct(*incoming.columns).alias("n"))
    both = cur.join(new, (F.col("c.entity_type") == F.col("n.entity_type")) & (F.col("c.entity_id") == F.col("n.entity_id")), "full_outer")
    gone = F.col("n.entity_id").isNull()
    fresh = F.col("c.entity_id").isNull()
    ok = ~gone & (fresh | passes)
    cols = [F.when(ok, values[c]).otherwise(F.col(f"c.{c}")).alias(c) if c in values else F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in current.columns]
    return both.select(*cols, F.when(~gone, ok).alias("_applied"), F.coalesce("n.entity_type", "c.entity_type").alias("_type"), F.coalesce("n.entity_id", "c.entity_id").alias("_id"))


def _split(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    told = merged.where(F.col("_applied").isNotNull()).select(F.col("_type").alias("entity_type"), F.col("_id").alias("entity_id"), F.col("_applied").alias("applied"))
    return merged.drop("_applied", "_type", "_id"), told


def upsert(current: DataFrame, docs: DataFrame, at: datetime, *, versioned: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, report of key and applied).

    Versioned: a document replaces a row of the same or a lower source_version (so a replay is harmless) and sets it.
    Unversioned: it replaces only rows of version 0; new rows get version 0. created_at: given, else stored, else ``at``;
    updated_at: given, else ``at``; indexed_at: ``at``. Several documents of one key: the highest version, then the
    latest updated_at counts. ``docs`` must have the columns of ``current`` (indexed_at aside).
    """
    now = F.lit(at).cast("timestamp")
    ready = prepared(docs)
    version = F.coalesce("source_version", F.lit(0)).cast("bigint") if versioned else F.lit(0).cast("bigint")
    ready = ready.withColumn("source_version", F.when(version < 0, F.raise_error(F.lit("sourceVersion must not be negative")).cast("bigint")).otherwise(version))
    ready = latest_per_key(ready, KEY, ["source_version", "updated_at"]).withColumn("indexed_at", now)
    values = {c: F.col(f"n.{c}") for c in current.columns if c in ready.columns}
    values["created_at"] = F.coalesce("n.created_at", "c.created_at", now)
    values["updated_at"] = F.coalesce("n.updated_at", now)
    passes = F.col("c.source_version") <= F.col("n.source_version") if versioned else F.col("c.source_version") == 0
    return _split(_merge(current, ready, passes, values, at))


def tombstone(current: DataFrame, keys: DataFrame, at: datetime, *, versioned: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, report): rows of ``keys`` (entity_type, entity_id, source_version, reason) become deleted.

    Title, tags, keywords and times stay, the reason goes into the payload; an unknown key gets an empty deleted row, so
    that older writes cannot bring it back. The same gate as upsert.
    """
    now = F.lit(at).cast("timestamp")
    version = F.coalesce("source_version", F.lit(0)).cast("bigint") if versioned else F.lit(0).cast("bigint")
    note = F.to_json(F.struct(F.coalesce("reason", F.lit("")).alias("reason")))
    ready = latest_per_key(keys.select(trimmed("entity_type").alias("entity_type"), trimmed("entity_id").alias("entity_id"), version.alias("source_version"), note.alias("note")), KEY, ["source_version"])
    empty = F.array().cast("array<string>")
    blank = {"title": F.lit(""), "tags": empty, "keywords": empty, "weight": F.lit(0), "view_count": F.lit(0), "like_count": F.lit(0), "download_count": F.lit(0)}
    fresh = F.col("c.entity_id").isNull()
    old = F.col("c.payload")
    # a stored reason gives way to the new one
    merged = F.when(fresh | F.coalesce(F.btrim(old), F.lit("")).isin("", "{}"), F.col("n.note")).otherwise(
        F.to_json(F.map_concat(F.map_filter(F.from_json(old, "map<string,string>"), lambda k, _: k != "reason"), F.from_json("n.note", "map<string,string>")))
    )
    values = {}
    for c, kind in current.dtypes:
        values[c] = F.when(fresh, blank[c].cast(kind)).otherwise(F.col(f"c.{c}")) if c in blank else F.when(~fresh, F.col(f"c.{c}"))
    values |= {k: F.col(f"n.{k}") for k in KEY}
    values |= {"status": F.lit("deleted"), "payload": merged, "source_version": F.col("n.source_version"), "indexed_at": now}
    values["created_at"] = F.coalesce("c.created_at", now)
    values["updated_at"] = F.coalesce("c.updated_at", now)
    passes = F.col("c.source_version") <= F.col("n.source_version") if versioned else F.col("c.source_version") == 0
    return _split(_merge(current, ready.select(*KEY, "source_version", "note", *[F.lit(None).cast(k).alias(c) for c, k in current.dtypes if c not in (*KEY, "source_version")]), passes, {c: v for c, v in values.items() if c in current.columns}, at))
