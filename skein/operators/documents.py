"""Source rows turned into index documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.terms import folded, trimmed
from skein.functions.text import document_id, keyword_tokens, merged_strings, parse_strings


def normal_status(status: Column | str, visibility: Column | str) -> Column:
    """deleted and removed: deleted; not public: hidden; approved, published and active: active; else hidden."""
    s, v = F.coalesce(folded(status), F.lit("")), F.coalesce(folded(visibility), F.lit(""))
    return F.when(s.isin("deleted", "removed"), "deleted").when((v != "") & (v != "public"), "hidden").when(s.isin("approved", "published", "active"), "active").otherwise("hidden")


def weight(status: Column | str, views: str = "view_count", likes: str = "like_count", downloads: str = "download_count", favorites: str = "favorite_count") -> Column:
    """Counters in one number; 0 for rows that are not shown."""
    n = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.isin("hidden", "deleted"), 0).otherwise(n(views) + n(likes) * 5 + n(downloads) * 3 + n(favorites) * 2)


def build_documents(rows: DataFrame) -> DataFrame:
    """Index documents of adapter rows (sources.adapters.ROW).

    Extra tags become tags of resources only; for all types they are keywords, with the source's keywords, the tags, the
    words of title and description, the category and the type. A post's body stays out of keywords and payload: it is
    only in the private ``index_text``, which is searched and never returned. The payload also tells the source status.
    """
    extra, resource, post = parse_strings("extra_tags_json"), F.col("entity_type") == "resource", F.col("entity_type") == "post"
    none = F.array().cast("array<string>")
    tags = merged_strings(parse_strings("tags_json"), F.when(resource, extra).otherwise(none))
    status = normal_status("status", "visibility")
    keywords = merged_strings(
        parse_strings("keywords_json"), tags, extra, keyword_tokens("title"), F.when(post, none).otherwise(keyword_tokens("description")), F.array(F.coalesce("category_id", F.lit("")), F.col("entity_type"))
    )
    told = F.to_json(F.struct(F.coalesce("status", F.lit("")).alias("statusSource"), F.coalesce("visibility", F.lit("")).alias("visibility")))
    own = F.when(F.coalesce(F.btrim("payload"), F.lit("")).isin("", "{}"), F.lit("{")).otherwise(F.concat(F.regexp_replace(F.btrim("payload"), r"\}$", ""), F.lit(",")))
    return rows.withColumn("_told", told).select(
        document_id("entity_type", "entity_id").alias("doc_id"),
        "entity_type",
        trimmed("entity_id").alias("entity_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        status.alias("status"),
        F.nullif("category_id", F.lit("")).alias("category_id"),
        F.nullif("author_id", F.lit("")).alias("author_id"),
        tags.alias("tags"),
        keywords.alias("keywords"),
        weight(status).alias("weight"),
        "view_count",
        "like_count",
        "download_count",
        F.concat(own, F.expr("substring(_told, 2)")).alias("payload"),
        "created_at",
        "updated_at",
        F.when(post, F.coalesce("description", F.lit(""))).otherwise("").alias("index_text"),
    )
