"""The star-schema test tables in the shape of the source tables, so that the adapters run on real joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.terms import folded
from skein.session import load


def source_tables(spark: SparkSession, folder: str) -> Mapping[str, DataFrame]:
    """part: Resource, orders: Post, customer: User, supplier: Organization, nation: OfficialTag of a region's group,
    part types: Tag, documents: CustomPage, those of two sources
    also PlayerServer and Video, with their languages as categories. Keys become strings; orders have no text, parts no time but a fixed one."""
    t = {n: load(spark, folder, n) for n in ("part", "lineitem", "orders", "customer", "nation", "region", "supplier", "documents")}
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    none, text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    uses = t["lineitem"].groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"), F.count_if(F.col("l_returnflag") == "R").alias("returns"))
    words = F.to_json(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")))
    group = F.pmod("p_partkey", F.lit(25)).cast("string")
    out = {
        "Resource": t["part"].join(uses, "p_partkey", "left").select(text("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("Published").alias("status"), F.when(F.col("p_size") < 3, "private").otherwise("public").alias("visibility"), F.col("p_brand").alias("category"), none.alias("authorId"), words.alias("tags"), F.concat(F.lit('["'), group, F.lit('"]')).alias("officialTags"), none.alias("mcVersions"), F.col("p_type").alias("description"), F.col("uses").alias("views"), F.col("p_size").alias("likeCount"), F.col("returns").alias("downloadCount"), F.lit(0).alias("favoriteCount"), at.alias("createdAt"), at.alias("updatedAt"), F.lit("java").alias("platform")),
        "Category": t["part"].select(F.col("p_brand").alias("slug")).distinct().select(F.concat(F.lit("id-"), "slug").alias("id"), F.upper("slug").alias("name"), "slug"),
        "Post": t["orders"].select(text("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("published").alias("status"), F.lit("public").alias("visibility"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp")).alias("publishedAt"), F.when(F.col("o_totalprice") > 300_000, "paid").otherwise("none").alias("accessMode"), F.col("o_orderstatus").alias("boardId"), text("o_custkey").alias("authorId"), F.col("o_orderpriority").alias("tags"), none.alias("topicTags"), none.alias("content"), F.lit(0).alias("views"), F.lit(0).alias("likeCount"), F.lit(0).alias("favoriteCount"), F.col("o_orderdate").cast("timestamp").alias("createdAt"), F.col("o_orderdate").cast("timestamp").alias("updatedAt")),
        "Board": t["orders"].select(F.col("o_orderstatus").alias("id")).distinct().select("id", F.concat(F.lit("board "), "id").alias("name"), F.lower("id").alias("slug")),
        "User": t["customer"].select(text("c_custkey").alias("id"), F.col("c_custkey").alias("uid"), F.col("c_name").alias("username"), F.lower("c_name").alias("slug"), none.alias("avatar"), F.lower("c_mktsegment").alias("role"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("hidden").alias("status"), none.alias("bio"), none.alias("profileReadme"), at.alias("createdAt"), at.alias("updatedAt")),
        "Organization": t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"), "left").select(text("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("active").alias("status"), F.lit("public").alias("visibility"), F.col("n_name").alias("category"), text("s_nationkey").alias("ownerId"), F.lower("s_name").alias("slug"), none.alias("tagline"), none.alias("description"), none.alias("homepageContent"), F.lit(1).alias("memberCount"), at.alias("createdAt"), at.alias("updatedAt")),
        "OfficialTagGroup": t["region"].select(text("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lower("r_name").alias("slug"), none.alias("description"), (F.col("r_regionkey") != 4).alias("enabled")),
        "OfficialTag": t["nation"].select(text("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"), none.alias("description"), F.col("n_nationkey").alias("sortOrder"), F.lit(True).alias("enabled"), text("n_regionkey").alias("groupId"), at.alias("createdAt"), at.alias("updatedAt")),
        "Tag": t["part"].groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("count")).select(F.md5("name").alias("id"), "name", F.lower("name").alias("slug"), "count", at.alias("createdAt")),
        "CustomPage": t["documents"].select(text("doc_id").alias("id"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("source").isNotNull().alias("published"), F.lower("source").alias("category"), none.alias("description"), F.col("text").alias("content"), F.col("created_at").alias("createdAt"), F.col("created_at").alias("updatedAt"), F.col("source").alias("slug")),
    }
    first, lang = F.element_at(F.split("text", "\n"), 1), F.lower("lang")
    page = lambda kind: t["documents"].where(folded("source") == kind).withColumns({"id": text("doc_id"), "title": first, "status": F.lit("Published"), "authorId": F.col("author_id"), "views": F.col("n_chars"), "likeCount": F.lit(0), "favoriteCount": F.lit(0), "createdAt": F.col("created_at"), "updatedAt": F.col("created_at")})
    common = ["id", "title", "status", "authorId", "views", "likeCount", "favoriteCount", "createdAt", "updatedAt"]
    languages = t["documents"].select(lang.alias("id")).where("id IS NOT NULL").distinct()
    out |= {
        "PlayerServer": page("server-page").select(*common, F.lit("public").alias("visibility"), lang.alias("category"), none.alias("tags"), F.when(lang.isNotNull(), F.to_json(F.array(lang))).alias("versions"), F.lit('["public"]').alias("networkEnvironments"), none.alias("description"), F.lit("java").alias("platform")),
        "PlayerServerCategory": languages.select(F.concat(F.lit("id-"), "id").alias("id"), F.upper("id").alias("name"), F.col("id").alias("slug")),
        "Video": page("video-notes").select(*common, F.when(F.col("lang").isNull(), "private").otherwise("public").alias("visibility"), lang.alias("categoryId"), F.col("lang").alias("tags"), none.alias("description"), F.lit("upload").alias("sourceType")),
        "VideoCategory": languages.select("id", F.upper("id").alias("name"), F.col("id").alias("slug")),
    }
    return out
